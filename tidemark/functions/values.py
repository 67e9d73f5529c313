"""What the types of a contract allow: one rule a type, shared by the checks of events and of defaults."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime
from decimal import Decimal, InvalidOperation
from typing import Any

_DECIMAL = re.compile(r"decimal\(([0-9]+),([0-9]+)\)")

# fixed values: the messages of the validator, {0} is the field
MESSAGES = {
    "object": "Event must be a JSON object",
    "unexpected": "Unexpected field '{0}'",
    "required": "Field '{0}' is required",
    "string": "Field '{0}' must be string",
    "decimal": "Field '{0}' must be decimal",
    "finite": "Field '{0}' must be a finite decimal",
    "whole": "Field '{0}' exceeds {1} integer digits",
    "scale": "Field '{0}' exceeds scale {1}",
    "iso": "Field '{0}' must be an ISO timestamp string",
    "timestamp": "Field '{0}' must be a valid ISO timestamp",
    "timezone": "Field '{0}' must include a timezone",
    "type": "Unsupported type '{1}' for field '{0}'",
    "decimal type": "Unsupported decimal type '{1}'",
    "enum": "Field '{0}' has value '{1}'. Allowed values: {2}",
}

#: A problem: the key of its message, and what the message names besides the field.
Problem = tuple[Any, ...]
Rule = Callable[[Any], Iterator[Problem]]


class ContractError(ValueError):
    """A contract, or a set of contracts, is not valid."""


def decimal_parameters(kind: str) -> tuple[int, int]:
    """(precision, scale); scale may not exceed precision, nor precision Spark's 38."""
    found = _DECIMAL.fullmatch(kind)
    precision, scale = map(int, found.groups()) if found else (0, 1)
    if scale > precision or precision > 38:
        raise ContractError(MESSAGES["decimal type"].format("", kind))
    return precision, scale


def text_rule(kind: str) -> Rule:
    def problems(value: Any) -> Iterator[Problem]:
        if type(value) is not str:
            yield ("string",)

    return problems


def number_of(value: Any) -> Decimal | None:
    """The exact decimal that a number's shortest form states."""
    if type(value) not in (int, float, Decimal):
        return None
    try:
        return Decimal(str(value))
    except InvalidOperation:
        return None


def decimal_rule(kind: str) -> Rule:
    precision, scale = decimal_parameters(kind)
    room = precision - scale

    def problems(value: Any) -> Iterator[Problem]:
        number = number_of(value)
        if number is None:
            yield ("decimal",)
        elif not number.is_finite():
            yield ("finite",)
        else:
            # the place of the first digit; zero takes one place before the point
            if (number.adjusted() + 1 if number else 1) > room:
                yield "whole", room
            if number.as_tuple().exponent + scale < 0:
                yield "scale", scale

    return problems


def timestamp_rule(kind: str) -> Rule:
    def problems(value: Any) -> Iterator[Problem]:
        if type(value) is not str:
            yield ("iso",)
            return
        try:
            at = None if "Z" in value[:-1] else datetime.fromisoformat(value)
        except ValueError:
            at = None
        if at is None:
            yield ("timestamp",)
        elif at.utcoffset() is None:
            yield ("timezone",)

    return problems


#: Rules by the name of a type, without its parameters.
RULES: dict[str, Callable[[str], Rule]] = {"string": text_rule, "decimal": decimal_rule, "timestamp": timestamp_rule}


def rule_of(kind: str) -> Rule:
    """The rule of a type; a type that is not known, or not well formed, is a problem of every value."""
    made = RULES.get(kind.partition("(")[0])
    try:
        return made(kind) if made else lambda _: iter([("type", kind)])
    except ContractError:
        return lambda _: iter([("decimal type", kind)])


def default_problem(kind: str, value: Any) -> bool:
    """Whether a value cannot stand as the default of a type: decimals may be given as text there."""
    if kind.startswith("decimal") and type(value) is str:
        try:
            value = Decimal(value)
        except InvalidOperation:
            return True
    return any(rule_of(kind)(value))

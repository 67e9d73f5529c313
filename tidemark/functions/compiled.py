"""Contracts compiled to columns: ordinary JSON messages are judged by expressions, without Python.

``judged`` decides a message only where it is certain that the rules of ``validation.judge`` find nothing, and then gives the same
event JSON and values; every other message (errors, escapes, exponents, Avro, nesting) is null, undecided, and goes to
the rules themselves. One regular expression says what is ordinary: a flat object of at most the contract's number of fields, of strings
without escapes, null, and plain numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.contracts import Contract, by_topic
from tidemark.functions.values import ContractError, decimal_parameters

_GAP = r"[ \t\n\r]*+"
_TEXT = r'[^"\\\x00-\x1F]*+'
#: A number as its shortest form writes it: zeros at the end of a fraction stay outside the group.
_NUMBER = r"-?(?:0|[1-9][0-9]{0,14})(?:\.(?:[0-9]{0,14}[1-9]|0)(?![0-9]*[1-9]))?"
_PAIR = rf'"({_TEXT})"{_GAP}:{_GAP}("{_TEXT}"|null|{_NUMBER})(?:(?<=\.[0-9]{{1,15}})0++)?+(?![0-9.eE+-])'
_MOMENT = r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,6})?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])\z"
#: Digits that a double keeps as they are written.
_DIGITS = 15


def _checked(kind: str, value: Column, text: Column) -> Column | None:
    """Whether a given value is right; None for types that are left to the rules. ``value`` is as written, ``text`` without quotes."""
    quoted = value.startswith('"')
    if kind == "string":
        return quoted
    if kind == "timestamp":
        return quoted & text.rlike(_MOMENT) & F.substring(text, 1, 10).try_cast("date").isNotNull()
    try:
        precision, scale = decimal_parameters(kind)
    except ContractError:
        return None
    room = precision - scale
    if precision > _DIGITS or not room:
        return None
    fraction = rf"(?:\.[0-9]{{1,{scale}}})?" if scale else ""
    # below a ten-thousandth a double is written with an exponent; -0 is written 0
    return value.rlike(rf"\A-?[0-9]{{1,{room}}}{fraction}\z") & ~value.rlike(r"\A-?0\.0000") & (value != "-0")


#: Columns of the first step, the judgement, and a number that keeps Spark from evaluating a step again for each use of it.
_KEYS, _WRITTEN, _PAYLOAD, _SHAPED, JUDGED, _TURN = (f"tidemark_{n}" for n in ("keys", "written", "payload", "shaped", "judged", "turn"))


def _of(contract: Contract, place: dict[str, int]) -> Column | None:
    """The judgement of an ordinary message of a contract, null where it is undecided; None if the contract's types are not compiled."""
    fields = contract["schema"]["fields"]
    names = [f["name"] for f in fields]
    keys = F.col(_KEYS)
    sound = [F.col(_SHAPED), F.size(F.array_distinct(keys)) == F.size(keys), F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0]
    values: list[Column] = []
    for f in fields:
        value, shown = F.col(f"tidemark_value_{place[f['name']]}"), F.col(f"tidemark_shown_{place[f['name']]}")
        absent, null = value.isNull(), value == "null"
        right = _checked(f["type"], value, shown)
        if right is None or f.get("default") is not None and type(f["default"]) is not str:
            return None
        if f.get("enum") is not None:
            right &= value.startswith('"') & shown.isin(*f["enum"])
        default = f.get("default")
        # a default is checked with its contract; it stands in for an absent key only
        empty = F.lit(bool(f.get("nullable", True)))
        sound.append(F.when(absent, F.lit(True) if default is not None else empty).when(null, empty).otherwise(right))
        values += [F.lit(f["name"]), F.when(absent, F.lit(default).cast("string")).when(~null, shown)]
    made = F.struct(F.lit(contract["name"]).alias("contract_name"), F.lit(contract["version"]).cast("int").alias("contract_version"), F.col(_PAYLOAD).alias("event_payload"), F.create_map(*values).alias("values"), F.lit(None).cast("string").alias("error_message"))
    return F.when(reduce(lambda a, b: a & b, sound), made)


def judged(messages: DataFrame, contracts: list[Contract]) -> DataFrame | None:
    """Columns of ``messages`` (topic, value, ...) and ``tidemark_judged``: for an ordinary message contract_name, contract_version,
    event_payload, values and (null) error_message; null where it is undecided. None where no contract can be compiled.
    Messages are matched in one step and judged by what was matched in the next."""
    text, turn = F.col("value").cast("string"), F.monotonically_increasing_id().alias(_TURN)
    place = {n: i for i, n in enumerate(dict.fromkeys(f["name"] for c in contracts for f in c["schema"]["fields"]))}
    cases = [(topic, own) for topic, contract in by_topic(contracts).items() if (own := _of(contract, place)) is not None]
    if not cases:
        return None
    most = max(len(c["schema"]["fields"]) for c in contracts)
    shape = rf"\A{_GAP}\{{{_GAP}{_PAIR}(?:{_GAP},{_GAP}{_PAIR}){{0,{most - 1}}}{_GAP}\}}{_GAP}\z"
    one = F.regexp_replace(text, rf"{_PAIR}{_GAP}(,|\}}){_GAP}", '"$1": $2$3 ')
    payload = F.regexp_replace(F.rtrim(one), rf"\A{_GAP}\{{{_GAP}", "{")
    matched = messages.select("*", F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1)).alias(_KEYS), F.regexp_extract_all(text, F.lit(_PAIR), F.lit(2)).alias(_WRITTEN), payload.alias(_PAYLOAD), (text.rlike(shape) & F.is_valid_utf8(text)).alias(_SHAPED), turn)
    # the value of each field by name, as written and without quotes: the contracts' conditions stay small
    value = {i: F.get(F.col(_WRITTEN), (F.array_position(F.col(_KEYS), n) - 1).cast("int")) for n, i in place.items()}
    named = matched.select(*messages.columns, _KEYS, _PAYLOAD, _SHAPED, *[v.alias(f"tidemark_value_{i}") for i, v in value.items()], turn)
    quoted = {i: F.col(f"tidemark_value_{i}") for i in value}
    shown = [F.when(v.startswith('"'), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v).alias(f"tidemark_shown_{i}") for i, v in quoted.items()]
    plain, passed = named.select("*", *shown), [*messages.columns, _KEYS, _PAYLOAD, _SHAPED, *[f"tidemark_{k}_{i}" for k in ("value", "shown") for i in value]]
    # a step for each contract, so that Spark compiles each to code of its own
    for i, (topic, own) in enumerate(cases):
        plain = plain.select(*passed, *[f"{JUDGED}_{j}" for j in range(i)], F.when((F.col("topic") == topic) & (F.col(_TURN) >= 0), own).alias(f"{JUDGED}_{i}"), turn)
    return plain.select(*messages.columns, F.coalesce(*[f"{JUDGED}_{i}" for i in range(len(cases))]).alias(JUDGED), turn)


def decided(marked: DataFrame, so: bool = True) -> DataFrame:
    """The rows of judged() messages that are decided, or those that are not."""
    own = F.col(JUDGED).isNotNull() if so else F.col(JUDGED).isNull()
    return marked.where(own & (F.col(_TURN) >= 0)).drop(_TURN)

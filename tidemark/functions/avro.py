"""Avro for contracts: schemas, the framed binary form, and a registry of schemas in memory.

A framed message is a zero byte, the schema id (4 bytes, big-endian) and the binary record. Only what contracts need is
here: string, enum, decimal in bytes, microsecond timestamps, and unions with null.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from typing import Any

from tidemark.functions.contracts import Contract, decimal_parameters

#: Default namespace of schemas; pass that of an existing registry to match its subjects.
NAMESPACE = "tidemark.events"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def is_framed(payload: bytes | None) -> bool:
    return bool(payload) and payload[0] == 0


def subject(contract: Contract, namespace: str = NAMESPACE) -> str:
    """All versions of a contract share a subject."""
    return f"{namespace}.{contract['name']}"


def _unscaled(value: Any, scale: int) -> bytes:
    number = int(Decimal(str(value)).scaleb(scale).to_integral_exact())
    return number.to_bytes((number + (number < 0)).bit_length() // 8 + 1, "big", signed=True)


def _micros(text: str) -> int:
    return (datetime.fromisoformat(text.replace("Z", "+00:00")) - _EPOCH) // timedelta(microseconds=1)


def _base(field: dict[str, Any]) -> Any:
    kind = field["type"]
    if "enum" in field:
        return {"type": "enum", "name": f"{field['name']}_enum", "symbols": list(field["enum"])}
    if kind == "string":
        return "string"
    if kind == "timestamp":
        return {"type": "long", "logicalType": "timestamp-micros"}
    precision, scale = decimal_parameters(kind)
    return {"type": "bytes", "logicalType": "decimal", "precision": precision, "scale": scale}


def _field(field: dict[str, Any]) -> dict[str, Any]:
    base, made = _base(field), {"name": field["name"]}
    default = field.get("default")
    if field.get("nullable", True):
        made["type"] = [base, "null"] if default is not None else ["null", base]
        made["default"] = None
    else:
        made["type"] = base
    if default is not None:
        kind = field["type"]
        made["default"] = default if kind == "string" else _micros(default) if kind == "timestamp" else _unscaled(default, decimal_parameters(kind)[1]).decode("latin-1")
    return made


def schema_of(contract: Contract, namespace: str = NAMESPACE) -> dict[str, Any]:
    return {"type": "record", "name": contract["name"], "namespace": namespace, "fields": [_field(f) for f in contract["schema"]["fields"]]}


def schema_json(contract: Contract, namespace: str = NAMESPACE) -> str:
    return json.dumps(schema_of(contract, namespace), sort_keys=True, separators=(",", ":"))


def _zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _write(kind: Any, value: Any) -> bytes:
    if isinstance(kind, list):
        for i, branch in enumerate(kind):
            if (branch == "null") == (value is None):
                return _zigzag(i) + (b"" if value is None else _write(branch, value))
        raise ValueError("null in a required field")
    if kind == "string":
        raw = value.encode()
        return _zigzag(len(raw)) + raw
    if kind["type"] == "enum":
        return _zigzag(kind["symbols"].index(value))
    if kind["type"] == "long":
        return _zigzag(_micros(value) if isinstance(value, str) else (value - _EPOCH) // timedelta(microseconds=1))
    raw = _unscaled(value, kind["scale"])
    return _zigzag(len(raw)) + raw


def encode(event: dict[str, Any], schema: dict[str, Any], schema_id: int) -> bytes:
    """A framed message; absent fields take their default."""
    made = []
    for f in schema["fields"]:
        if f["name"] in event:
            made.append(_write(f["type"], event[f["name"]]))
        else:
            kind, default = f["type"], f.get("default")
            branch = kind[0] if isinstance(kind, list) else kind
            if isinstance(branch, dict) and branch["type"] == "bytes" and default is not None:
                raw = default.encode("latin-1")
                made.append((_zigzag(0) if isinstance(kind, list) else b"") + _zigzag(len(raw)) + raw)
            elif isinstance(branch, dict) and branch["type"] == "long" and default is not None:
                made.append((_zigzag(0) if isinstance(kind, list) else b"") + _zigzag(default))
            else:
                made.append(_write(kind, default))
    return b"\0" + struct.pack(">I", schema_id) + b"".join(made)


class _Input:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("the record ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)
            if shift > 63:
                raise ValueError("a number is too long")


def _read(kind: Any, source: _Input) -> Any:
    if isinstance(kind, list):
        i = source.number()
        if not 0 <= i < len(kind):
            raise ValueError("no such branch of a union")
        return None if kind[i] == "null" else _read(kind[i], source)
    if kind == "string":
        return source.take(source.number()).decode()
    if kind["type"] == "enum":
        i = source.number()
        if not 0 <= i < len(kind["symbols"]):
            raise ValueError("no such symbol of an enum")
        return kind["symbols"][i]
    if kind["type"] == "long":
        try:
            return (_EPOCH + timedelta(microseconds=source.number())).isoformat()
        except OverflowError as e:
            raise ValueError("a timestamp is out of range") from e
    raw = source.take(source.number())
    return Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-kind["scale"])


def decode(payload: bytes, schemas: dict[int, dict[str, Any]]) -> dict[str, Any]:
    """The event of a framed message, timestamps as ISO text. Unknown ids raise LookupError, bad bytes ValueError."""
    if len(payload) < 5:
        raise ValueError("the frame ends early")
    number = struct.unpack(">I", payload[1:5])[0]
    if number not in schemas:
        raise LookupError(f"unknown schema id {number}")
    source = _Input(payload[5:])
    event = {f["name"]: _read(f["type"], source) for f in schemas[number]["fields"]}
    if source.at != len(source.raw):
        raise ValueError("bytes are left over")
    return event


def unreadable(old: dict[str, Any], new: dict[str, Any]) -> list[str]:
    """Why a reader of ``new`` cannot read what was written under ``old``: a field that is new needs a default, and one that
    stays must take every branch that the old one could have."""
    branches = lambda kind: {json.dumps(b, sort_keys=True) for b in (kind if isinstance(kind, list) else [kind])}
    before = {f["name"]: f["type"] for f in old["fields"]}
    found = [f"field {f['name']} is new and has no default" for f in new["fields"] if f["name"] not in before and "default" not in f]
    return found + [f"field {f['name']} has another type" for f in new["fields"] if f["name"] in before and not branches(before[f["name"]]) <= branches(f["type"])]


class Registry:
    """Schemas by subject and id; ``save`` and ``load`` keep them as JSON."""

    def __init__(self, namespace: str = NAMESPACE):
        self.namespace = namespace
        self.subjects: dict[str, list[tuple[int, str]]] = {}

    def register(self, contract: Contract) -> int:
        """The id of the contract's schema; versions of a subject come in contract order."""
        known = self.subjects.setdefault(subject(contract, self.namespace), [])
        text = schema_json(contract, self.namespace)
        for number, old in known:
            if old == text:
                return number
        if len(known) != contract["version"] - 1:
            raise ValueError(f"{subject(contract, self.namespace)} has {len(known)} versions, version {contract['version']} cannot follow")
        if known and (why := unreadable(json.loads(known[-1][1]), json.loads(text))):
            raise ValueError(f"{subject(contract, self.namespace)} version {contract['version']} is not compatible: {'; '.join(why)}")
        number = 1 + sum(map(len, self.subjects.values()))
        known.append((number, text))
        return number

    def check(self, contracts: list[Contract]) -> list[str]:
        """Contracts whose schema is not registered at their version, and versions that no contract has."""
        found = []
        for name in sorted({subject(c, self.namespace) for c in contracts}):
            own = sorted((c for c in contracts if subject(c, self.namespace) == name), key=lambda c: c["version"])
            have = [text for _, text in self.subjects.get(name, [])]
            if have != [schema_json(c, self.namespace) for c in own]:
                found.append(f"{name}: registered versions do not match the contracts")
        return found

    def save(self) -> str:
        return json.dumps({"namespace": self.namespace, "subjects": self.subjects})

    @classmethod
    def load(cls, text: str) -> Registry:
        found = json.loads(text)
        made = cls(found["namespace"])
        made.subjects = {k: [(n, t) for n, t in v] for k, v in found["subjects"].items()}
        return made

    def schemas(self) -> dict[int, dict[str, Any]]:
        return {n: json.loads(t) for known in self.subjects.values() for n, t in known}

    def decoder(self) -> Callable[[bytes], dict[str, Any]]:
        """For judge_messages: a picklable function of the schemas known now."""
        schemas = self.schemas()
        return lambda payload: decode(payload, schemas)

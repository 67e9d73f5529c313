"""Compilers from contracts: Spark types, RAW table definitions, schema files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

from tidemark.functions.avro import schema_of
from tidemark.functions.contracts import Contract, ContractError, decimal_parameters

IDENTIFIER = re.compile(r"[a-z_][a-z0-9_]*")
_RAW = (("raw_id", "long", False), ("kafka_topic", "string", False), ("kafka_partition", "int", False), ("kafka_offset", "long", False), ("kafka_load_dttm", "timestamp", False), ("contract_name", "string", False), ("contract_version", "int", False), ("original_payload", "string", False))


def spark_type(kind: str) -> T.DataType:
    if kind == "string":
        return T.StringType()
    if kind == "timestamp":
        return T.TimestampType()
    return T.DecimalType(*decimal_parameters(kind))


def event_schema(contract: Contract) -> T.StructType:
    return T.StructType([T.StructField(f["name"], spark_type(f["type"]), f.get("nullable", True)) for f in contract["schema"]["fields"]])


def raw_schema(contract: Contract) -> T.StructType:
    """The RAW table of a contract's latest version: coordinates and provenance, then the fields."""
    simple = {"long": T.LongType(), "string": T.StringType(), "int": T.IntegerType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(n, simple[t], null) for n, t, null in _RAW] + list(event_schema(contract).fields))


def sql_literal(value: Any, kind: str) -> str:
    if value is None:
        return "NULL"
    quoted = "'" + str(value).replace("'", "''") + "'"
    return str(value) if kind.startswith("decimal") else f"TIMESTAMP {quoted}" if kind == "timestamp" else quoted


def raw_ddl(contract: Contract, provider: str = "parquet") -> str:
    """CREATE TABLE text for Spark SQL. The identity of raw_id and the uniqueness of coordinates are kept by the writer."""
    names = [contract["name"], *[f["name"] for f in contract["schema"]["fields"]]]
    for n in names:
        if not IDENTIFIER.fullmatch(n):
            raise ContractError(f"Unsafe identifier: {n}")
    columns = [f"{n} {t if t != 'long' else 'bigint'}{'' if null else ' NOT NULL'}" for n, t, null in _RAW]
    for f in contract["schema"]["fields"]:
        default = f" DEFAULT {sql_literal(f['default'], f['type'])}" if "default" in f else ""
        columns.append(f"{f['name']} {spark_type(f['type']).simpleString()}{'' if f.get('nullable', True) else ' NOT NULL'}{default}")
    body = ",\n  ".join(columns)
    return f"-- {contract['name']} v{contract['version']}\nCREATE TABLE IF NOT EXISTS raw_{contract['name']} (\n  {body}\n) USING {provider}\n"


def schema_files(contracts: Iterable[Contract]) -> dict[str, str]:
    """File name -> Avro schema text."""
    return {f"{c['name']}.v{c['version']}.avsc": json.dumps(schema_of(c), indent=2) + "\n" for c in contracts}


def write_files(files: dict[str, str], folder: str | Path) -> list[Path]:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    return [folder / n for n in sorted(files)]


def check_files(files: dict[str, str], folder: str | Path, pattern: str = "*.avsc") -> list[str]:
    """Files that are missing, stale or unexpected."""
    folder = Path(folder)
    found = [f"missing: {n}" if not (folder / n).exists() else f"stale: {n}" for n, text in sorted(files.items()) if not (folder / n).exists() or (folder / n).read_text(encoding="utf-8") != text]
    return found + [f"unexpected: {p.name}" for p in sorted(folder.glob(pattern)) if p.name not in files]

"""Demo events and Kafka-shaped messages: builders, deliberate faults, keys, topics."""

from __future__ import annotations

import struct
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.avro import encode, schema_of
from tidemark.functions.contracts import Contract, ContractError
from tidemark.functions.validation import to_json
from tidemark.streaming.ingest import MESSAGES

# fixed value: a schema id that no registry has (the greatest of 31 bits)
UNKNOWN_SCHEMA_ID = 2147483647


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def build_event(contract: Contract, order_id: str, source_channel: str | None = None, at: str | None = None) -> dict[str, Any]:
    """A valid event of an order contract, with the fields that its version has."""
    at = at or _now()
    values = {
        "order_id": order_id, "customer_id": "demo_customer", "amount": 249.90, "paid_amount": 249.90, "currency": "EUR", "created_at": at, "paid_at": at, "cancelled_at": at,
        "payment_id": f"payment_{order_id}", "cancellation_id": f"cancellation_{order_id}", "cancellation_reason": "customer_request", "source_channel": source_channel,
    }
    names = [f["name"] for f in contract["schema"]["fields"]]
    if source_channel is not None and "source_channel" not in names:
        raise ContractError(f"{contract['name']} v{contract['version']} has no source_channel")
    return {n: values[n] for n in names}


def spoil(contract: Contract, event: dict[str, Any]) -> dict[str, Any]:
    """The event with a value that its contract does not allow."""
    for f in contract["schema"]["fields"]:
        if "enum" in f:
            return event | {f["name"]: "NOT_ALLOWED"}
    return {k: v for k, v in event.items() if k != contract["key"][0]}


def message_key(contract: Contract, event: dict[str, Any]) -> str:
    return "|".join(str(event[k]) for k in contract["key"])


def to_message(contract: Contract, event: dict[str, Any], offset: int, schema_id: int | None = None, corrupt: bool = False) -> tuple[str, int, int, bytearray]:
    """(topic, partition, offset, value): JSON, or framed Avro where a schema id is given."""
    if schema_id is None:
        value = to_json(event).encode()
    else:
        value = encode(event, schema_of(contract), schema_id)
        if corrupt:
            value = b"\0" + struct.pack(">I", UNKNOWN_SCHEMA_ID) + value[5:]
    return contract["topic"], 0, offset, bytearray(value)


def write_messages(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Append Kafka-shaped rows as files that file_stream() reads."""
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(path)


def write_kafka(events: DataFrame, servers: str, key: list[str]) -> None:
    """Send (topic, event columns) rows to Kafka (needs Spark's Kafka package)."""
    rows = events.select("topic", F.concat_ws("|", *key).alias("key"), F.to_json(F.struct(*[c for c in events.columns if c != "topic"])).alias("value"))
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def missing_topics(contracts: list[Contract], root: str | Path) -> list[str]:
    """Topics without a folder under ``root``, created on the way; existing ones are left alone."""
    made = []
    for topic in sorted(c["topic"] for c in contracts):
        folder = Path(root) / topic
        if not folder.exists():
            folder.mkdir(parents=True, exist_ok=True)
            made.append(topic)
    return made



"""Message ingestion: Kafka-shaped rows to RAW tables and dead letters, in batches or streams.

RAW and dead-letter tables are append-only tables of one catalog. A batch is judged once and all sinks get their part of it in one
commit. Each sink keeps a ledger of the offsets it covers and the greatest id it has given, so a batch of new offsets
reads nothing of what is stored; where offsets overlap, the rows of the files in question are left out by an exact join. A batch that
is replayed after a failure changes nothing. A stream hands its micro-batches to the same function and keeps its offsets
in the checkpoint folder.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.contracts import Contract, get_contract
from tidemark.functions.schemas import raw_schema, spark_type
from tidemark.functions.validation import judge_messages
from tidemark.operators.incremental import surrogate_ids
from tidemark.sources.catalog import Catalog, Conflict
from tidemark.sources.tables import AppendTable
from tidemark.sources.work import scratch

MESSAGES = T.StructType([T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("value", T.BinaryType())])
DEAD_LETTERS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("kafka_topic", T.StringType()), T.StructField("kafka_partition", T.IntegerType()), T.StructField("kafka_offset", T.LongType())]
    + [T.StructField("contract_name", T.StringType()), T.StructField("contract_version", T.IntegerType()), T.StructField("raw_payload", T.BinaryType()), T.StructField("event_payload", T.StringType())]
    + [T.StructField("error_message", T.StringType()), T.StructField("load_dttm", T.TimestampType())]
)
COORDINATES = ["kafka_topic", "kafka_partition", "kafka_offset"]


def new_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each coordinate that ``known`` does not have; of that only the offsets of ``rows`` are read."""
    low, high = rows.agg(F.min("kafka_offset"), F.max("kafka_offset")).first()
    near = known.where(F.col("kafka_offset").between(low, high)) if low is not None else known.limit(0)
    return rows.dropDuplicates(COORDINATES).join(near.select(*COORDINATES), COORDINATES, "left_anti")


def numbered(rows: DataFrame, table: AppendTable, name: str) -> DataFrame:
    """Ids that go on from the greatest one of the table, in the order of coordinates."""
    return surrogate_ids(rows, COORDINATES, table.greatest(name) or 0, name)


class Ingest:
    """Sinks under ``root``: raw_<name> for each contract name, dead_letter_events. ``snapshot`` (a catalog's number) fixes what is read."""

    def __init__(self, spark: SparkSession, contracts: list[Contract], root: str, decoder=None, snapshot: int | None = None):
        self.spark, self.contracts, self.root, self.decoder = spark, contracts, root.rstrip("/"), decoder
        self.latest = {n: get_contract(contracts, n) for n in sorted({c["name"] for c in contracts})}
        self.catalog = Catalog(spark, self.root, snapshot)
        self.tables = {n: AppendTable(self.catalog, f"raw_{n}", raw_schema(c), ("raw_id", "kafka_load_dttm", "kafka_offset"), tuple(COORDINATES)) for n, c in self.latest.items()}
        self.dead = AppendTable(self.catalog, "dead_letter_events", DEAD_LETTERS, ("id", "load_dttm", "kafka_offset"), tuple(COORDINATES))

    def at(self, snapshot: int) -> Ingest:
        return Ingest(self.spark, self.contracts, self.root, self.decoder, snapshot)

    def raw(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def slice(self, name: str, above: int, upto: int) -> DataFrame:
        """Rows of raw_id in (above, upto]; other files are not opened."""
        return self.tables[name].read(raw_id=(above + 1, upto))

    def dead_letters(self) -> DataFrame:
        return self.dead.read()

    def watermarks(self) -> dict[str, int]:
        """The greatest raw_id of each table, 0 if it is empty; nothing is scanned."""
        return {n: t.greatest("raw_id") or 0 for n, t in self.tables.items()}

    def loaded_at(self, name: str) -> datetime | None:
        """When the last row of a table was loaded; nothing is scanned."""
        micros = self.tables[name].greatest("kafka_load_dttm")
        return None if micros is None else datetime.fromtimestamp(micros / 1e6, timezone.utc)

    def process(self, messages: DataFrame, at: datetime | None = None) -> None:
        """Judge a batch and append what is new to the sinks."""
        at = F.lit((at or datetime.now(timezone.utc)).isoformat()).cast("timestamp")
        judged = judge_messages(messages.select("topic", "partition", "offset", "value"), self.contracts, self.decoder)
        named = judged.withColumnRenamed("topic", COORDINATES[0]).withColumnRenamed("partition", COORDINATES[1]).withColumnRenamed("offset", COORDINATES[2]).persist()
        try:
            # a value that passes the rules but not the column's type is a dead letter, not a stopped stream
            problem = F.col("error_message")
            for contract in self.contracts:
                for f in contract["schema"]["fields"]:
                    if f["type"] != "string":
                        value = F.col("values")[f["name"]]
                        bad = (F.col("contract_name") == contract["name"]) & (F.col("contract_version") == contract["version"]) & value.isNotNull() & F.expr(f"try_cast(values['{f['name']}'] AS {spark_type(f['type']).simpleString()})").isNull()
                        problem = F.coalesce(problem, F.when(bad, F.lit(f"Field '{f['name']}' cannot be stored")))
            routed = named.withColumn("error_message", problem)
            # of two writers the one that commits second judges what is new once more
            for left in range(2, -1, -1):
                try:
                    with scratch(self.spark), self.catalog.transaction():
                        self._route(routed, at)
                    return
                except Conflict:
                    if not left:
                        raise
        finally:
            named.unpersist()

    def _route(self, routed: DataFrame, at) -> None:
        for name, contract in self.latest.items():
            table, schema = self.tables[name], raw_schema(contract)
            fresh = table.unseen(routed.where(F.col("error_message").isNull() & (F.col("contract_name") == name)))
            fields = [F.col("values")[f["name"]].cast(spark_type(f["type"])).alias(f["name"]) for f in contract["schema"]["fields"]]
            rows = numbered(fresh, table, "raw_id").select("raw_id", *COORDINATES, at.alias("kafka_load_dttm"), "contract_name", "contract_version", F.col("event_payload").alias("original_payload"), *fields)
            table.append(rows.select(*schema.names))
        dead = self.dead.unseen(routed.where(F.col("error_message").isNotNull())).withColumnRenamed("value", "raw_payload")
        self.dead.append(numbered(dead, self.dead, "id").withColumn("load_dttm", at).select(*DEAD_LETTERS.names))

    def stream(self, source: DataFrame, checkpoint: str, available_now: bool = True):
        """Start a query that hands the micro-batches of a streaming ``source`` (topic, partition, offset, value) to process()."""
        writer = source.writeStream.foreachBatch(lambda df, _: self.process(df)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def consume(self, source: DataFrame, checkpoint: str, once: bool = False, timeout: float | None = None, idle_timeout: float | None = None) -> int:
        """Run a stream until it is done by one of the bounds, and return the rows it took: ``once`` ends with the first
        micro-batch that has rows, ``timeout`` after so many seconds in all, ``idle_timeout`` after so many without rows.
        Without any bound it runs until it fails."""
        started = last = time.monotonic()
        taken, seen = 0, -1
        query = self.stream(source, checkpoint, available_now=False)
        try:
            while not query.awaitTermination(0.2):
                for p in query.recentProgress:
                    if p.batchId > seen and p.numInputRows:
                        taken, seen, last = taken + p.numInputRows, p.batchId, time.monotonic()
                now = time.monotonic()
                if once and taken or timeout is not None and now - started >= timeout or idle_timeout is not None and now - last >= idle_timeout:
                    return taken
        finally:
            query.stop()
        return taken


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Kafka-shaped Parquet files as a stream. With Spark's Kafka package the same columns come from format('kafka')."""
    return spark.readStream.schema(MESSAGES).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """All contract topics from the earliest offset (needs Spark's Kafka package on the class path)."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load()
    return rows.select("topic", "partition", "offset", "value")


def hourly_stream(source: DataFrame, at: str = "kafka_load_dttm", late: str = "1 hour") -> DataFrame:
    """Hourly counts of a streaming RAW table; hours close ``late`` after the latest event, and what comes later is dropped
    (``volume.HourlyVolume`` keeps it)."""
    return source.withWatermark(at, late).groupBy(F.window(at, "1 hour")).agg(F.count("*").alias("events_cnt")).select(F.col("window.start").alias("event_hour"), "events_cnt")

"""Queries through the engine's own tables: buckets, appended files with statistics, ledger, history, facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import lifecycle as life
from tidemark.operators import parity
from tidemark.plans import orders as plans
from tidemark.plans.sql import oracle
from tidemark.sources.adapters import dead_letters, raw_tables
from tidemark.sources.catalog import Catalog
from tidemark.sources.tables import AppendTable, BucketTable, History
from tidemark.sources.work import work_folder
from tidemark.streaming.volume import HourlyVolume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NAMES = ("created", "paid", "cancelled")
COORDINATES = ("kafka_topic", "kafka_partition", "kafka_offset")


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def _catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, work_folder(spark, "tables"))


def _parts(sources, low: int) -> list[list[DataFrame]]:
    """The events up to the last watermark, and those after it."""
    return [[s.where(F.col("raw_id") <= low) for s in sources], [s.where(F.col("raw_id") > low) for s in sources]]


def _facts(spark, sf_dir) -> DataFrame:
    """Facts that two runs keep in buckets: the second reads the new events and the kept facts of their orders."""
    sources = raw_tables(spark, sf_dir)
    table = None
    catalog = _catalog(spark)
    for events in _parts(sources, plans._marks(sources)[0]):
        fresh = life.facts(*events)
        table = table or BucketTable(catalog, "facts", fresh.schema, ["order_id"])
        table.merge(life.merge_facts(table.read_for(fresh), fresh))
    return table.read()


@query(oracle(f"SELECT {', '.join(life.COLUMNS)} FROM orders_all", "orders_all"))
def orders_from_facts(spark, sf_dir):
    return life.finish(_facts(spark, sf_dir))


@query(oracle("SELECT * FROM orphan", "orphan"))
def orphans_from_facts(spark, sf_dir):
    return life.unfounded(_facts(spark, sf_dir))


@query(oracle(f"SELECT {', '.join(life.COLUMNS)} FROM orders_all", "orders_all"))
def upsert_orders_by_bucket(spark, sf_dir):
    before, _, changes = steps = plans._steps(spark, sf_dir)
    table = BucketTable(_catalog(spark), "orders", before.schema, ["order_id"])
    table.replace(before)
    table.merge(steps[1].join(changes.select("order_id"), "order_id", "left_semi").select(*before.columns))
    return table.read()


@query(plans.ORACLE["scd2_history"])
def scd2_history_by_bucket(spark, sf_dir):
    """Open and closed versions kept apart: the second run closes and opens those of changed orders only."""
    sources = raw_tables(spark, sf_dir)
    low, _ = plans._marks(sources)
    # one row: the times of the two runs
    t0, t1 = life.union_events(*sources).agg(F.max(F.when(F.col("raw_id") <= low, F.col("kafka_load_dttm"))), F.max("kafka_load_dttm") + F.expr("INTERVAL 1 SECOND")).first()
    before, fresh, changes = plans._steps(spark, sf_dir)
    at = lambda df, t: df.select("order_id", "status", F.col("created_at").cast("date").alias("order_dt"), F.lit(str(t)).cast("timestamp_ntz").alias("processed_dttm"))
    schema = T.StructType([*at(before, t0).schema.fields, *[T.StructField(n, T.TimestampNTZType()) for n in ("valid_from", "valid_to")]])
    history = History(_catalog(spark), "history", schema, "order_id")
    history.advance(at(before, t0), "processed_dttm")
    history.advance(at(fresh.join(changes.select("order_id"), "order_id", "left_semi"), t1), "processed_dttm")
    return history.read().drop("processed_dttm")


def _appended(spark, sf_dir) -> list[AppendTable]:
    """RAW tables that two batches have been appended to."""
    sources, catalog = raw_tables(spark, sf_dir), _catalog(spark)
    tables = [AppendTable(catalog, n, df.schema, ("raw_id", "kafka_load_dttm")) for n, df in zip(NAMES, sources, strict=True)]
    for events in _parts(sources, plans._marks(sources)[0]):
        for table, df in zip(tables, events, strict=True):
            table.append(df.repartitionByRange(4, "raw_id"))
    return tables


@query(plans.ORACLE["high_watermarks"])
def watermarks_from_statistics(spark, sf_dir):
    tables = _appended(spark, sf_dir)
    return spark.createDataFrame([(n, t.greatest("raw_id") or 0) for n, t in zip(NAMES, tables, strict=True)], "source string, last_raw_id long")


@query(plans.ORACLE["incremental_slice"])
def slice_from_statistics(spark, sf_dir):
    """The new events, from the files that hold them."""
    low, high = plans._marks(raw_tables(spark, sf_dir))
    return _appended(spark, sf_dir)[0].read(raw_id=(low + 1, high)).select("raw_id", "order_id", "created_at")


@query(oracle("SELECT kafka_topic, kafka_partition, kafka_offset FROM dead WHERE kafka_offset % 3 <> 0", "dead"))
def unseen_by_ledger(spark, sf_dir):
    """A batch that comes twice, against a table that has a third of its offsets: they overlap, so an exact join decides."""
    dead = dead_letters(spark, sf_dir).drop("raw_payload")
    table = AppendTable(_catalog(spark), "dead", dead.schema, ("kafka_offset",), COORDINATES)
    table.append(dead.where("kafka_offset % 3 = 0"))
    return table.unseen(dead.union(dead)).select(*COORDINATES)


@query(oracle("SELECT event_type, max(raw_id) AS last_raw_id, count(*) AS events_cnt FROM lifecycle GROUP BY event_type", "lifecycle"))
def append_after_replay(spark, sf_dir):
    """Each batch is handed in twice; the second time adds nothing."""
    out = []
    for name, df in zip(NAMES, raw_tables(spark, sf_dir), strict=True):
        table = AppendTable(_catalog(spark), name, df.schema, ("raw_id", "kafka_offset"), COORDINATES)
        for _ in range(2):
            table.append(table.unseen(df))
        out.append((name, table.greatest("raw_id"), table.rows()))
    return spark.createDataFrame(out, "event_type string, last_raw_id long, events_cnt long")


@query(oracle("SELECT o.order_id, o.created_at::DATE AS order_dt, o.status FROM old_orders_all o", **plans._old("orders_all")))
def history_as_of(spark, sf_dir):
    """The orders as they were at the first of two runs, from the history that the second has moved on."""
    before, fresh, changes = plans._steps(spark, sf_dir)
    at = lambda df, k: df.select("order_id", F.col("created_at").cast("date").alias("order_dt"), "status", F.timestamp_seconds(F.lit(k)).cast("timestamp_ntz").alias("processed_dttm"))
    schema = T.StructType([*at(before, 1).schema.fields, *[T.StructField(n, T.TimestampNTZType()) for n in ("valid_from", "valid_to")]])
    history = History(_catalog(spark), "history", schema, "order_id")
    history.advance(at(before, 10), "processed_dttm")
    history.advance(at(fresh.join(changes.select("order_id"), "order_id", "left_semi"), 20), "processed_dttm")
    return history.as_of(15_000_000).select("order_id", "order_dt", "status")


@query(oracle("SELECT date_trunc('hour', kafka_load_dttm)::TIMESTAMP AS event_hour, event_type, count(*) AS events_cnt FROM lifecycle GROUP BY 1, 2", "lifecycle"))
def event_volume_by_increments(spark, sf_dir):
    """Three batches, the second of them a second time; the third has the first days, so it is late and is corrected in."""
    events = life.union_events(*raw_tables(spark, sf_dir))
    volume = HourlyVolume(_catalog(spark))
    third = F.pmod("raw_id", F.lit(3))
    for number, part in ((0, third == 1), (1, third == 2), (1, third == 2), (2, third == 0)):
        volume.add(events.where(part), number)
    volume.correct()
    return volume.read()


@query(oracle(f"SELECT flag, stored_cnt, stored_cnt AS computed_cnt, 0::BIGINT AS differing_cnt FROM (SELECT unnest({list(life.FLAGS)}) AS flag, unnest([{', '.join(f'count(*) FILTER (WHERE {f})' for f in life.FLAGS)}]) AS stored_cnt FROM orders_all)", "orders_all"))
def parity_dq_flags(spark, sf_dir):
    """The flags of the stored orders against those computed by windows from all events."""
    return parity.flag_parity(upsert_orders_by_bucket(spark, sf_dir), life.enrich_windowed(*raw_tables(spark, sf_dir)), "order_id", list(life.FLAGS))


@query(oracle("SELECT 'digests' AS test, 0::BIGINT AS differences, count(*) AS rows_compared FROM orders_all", "orders_all"))
def parity_by_digests(spark, sf_dir):
    stored, computed = upsert_orders_by_bucket(spark, sf_dir).select(*life.COLUMNS), plans.all_orders(spark, sf_dir).select(*life.COLUMNS)
    found = parity.differences(stored, computed, ["order_id"]).agg(F.count("*").alias("differences")).crossJoin(computed.agg(F.count("*").alias("rows_compared")))  # single rows
    return found.select(F.lit("digests").alias("test"), "differences", "rows_compared")

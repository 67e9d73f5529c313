"""Watermarks, affected keys and dates, keyed upserts, change log, slowly changing history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.work import written


def high_watermarks(sources: dict[str, DataFrame]) -> DataFrame:
    """source, last_raw_id: the greatest raw_id of each source, 0 if it is empty."""
    return reduce(DataFrame.unionByName, [df.agg(F.coalesce(F.max("raw_id"), F.lit(0)).cast("long").alias("last_raw_id")).select(F.lit(n).alias("source"), "last_raw_id") for n, df in sources.items()])


def sliced(df: DataFrame, above: int | Column, upto: int | Column) -> DataFrame:
    """Rows of (above, upto]; both bounds reach the Parquet scan."""
    return df.where((F.col("raw_id") > above) & (F.col("raw_id") <= upto))


def affected_orders(sources: list[DataFrame], above: int, upto: int) -> DataFrame:
    """Distinct order_id with events in the slice."""
    return reduce(DataFrame.union, [sliced(df, above, upto).select("order_id") for df in sources]).distinct()


def restrict(sources: list[DataFrame], keys: DataFrame) -> list[DataFrame]:
    """Full history of the affected orders: late and disordered events need no time bound."""
    return [df.join(keys, "order_id", "left_semi") for df in sources]


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new over old by key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def merge_watermarks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Watermarks never go back."""
    return old.unionByName(new).groupBy("source").agg(F.max("last_raw_id").alias("last_raw_id"))


def change_log(old: DataFrame, new: DataFrame, compared: list[str]) -> DataFrame:
    """order_id, operation, old_order_dt, new_order_dt of inserted and changed orders. Orders are never deleted."""
    a = old.select("order_id", F.struct(*compared).alias("was"), F.col("created_at").cast("date").alias("old_order_dt"))
    b = new.select("order_id", F.struct(*compared).alias("now"), F.col("created_at").cast("date").alias("new_order_dt"))
    both = b.join(a, "order_id", "left").where(F.col("was").isNull() | ~F.col("was").eqNullSafe(F.col("now")))
    return both.select("order_id", F.when(F.col("was").isNull(), "INSERT").otherwise("UPDATE").alias("operation"), "old_order_dt", "new_order_dt")


def affected_dates(changes: DataFrame, bootstrap: DataFrame | None = None) -> DataFrame:
    """Old and new dates of changed orders, and those of ``bootstrap`` where everything is to be computed anew."""
    # the changes are made once, not once for each date
    dates = changes.select(F.explode(F.array("old_order_dt", "new_order_dt")).alias("order_dt"))
    if bootstrap is not None:
        dates = dates.union(bootstrap.select("order_dt"))
    return dates.where("order_dt IS NOT NULL").distinct()


def snapshot(history: DataFrame, current: DataFrame, key: str, updated_at: str) -> DataFrame:
    """Slowly changing history (type 2, timestamp strategy): versions whose key has a later row, or has gone, are
    closed; later rows and new keys open a version. Columns of ``history``: those of current, valid_from, valid_to.
    A key that has gone closes at the latest ``updated_at`` of ``current``."""
    run_at, new_key, new_at = "snapshot_run_at", "snapshot_key", "snapshot_at"
    now = current.agg(F.max(updated_at).alias(run_at))
    live, closed = history.where("valid_to IS NULL"), history.where("valid_to IS NOT NULL")
    fresh = current.select(F.col(key).alias(new_key), F.col(updated_at).alias(new_at))
    met = live.join(fresh, F.col(key) == F.col(new_key), "left").join(F.broadcast(now))  # one row
    ended = F.when(F.col(new_key).isNull(), F.col(run_at)).when(F.col(new_at) > F.col(updated_at), F.col(new_at))
    kept = met.withColumn("valid_to", ended).select(*history.columns)
    known = live.select(F.col(key).alias(new_key), F.col(updated_at).alias(new_at))
    opened = current.join(known, (F.col(key) == F.col(new_key)) & (F.col(updated_at) <= F.col(new_at)), "left_anti")
    opened = opened.withColumn("valid_from", F.col(updated_at)).withColumn("valid_to", F.lit(None).cast(dict(history.dtypes)["valid_to"]))
    return closed.unionByName(kept).unionByName(opened.select(*history.columns))


def surrogate_ids(df: DataFrame, order: list[str], start: int = 0, name: str = "change_id") -> DataFrame:
    """Consecutive ids in the given order, without gathering the rows in one task: rows are sorted across partitions and
    written once with their partition and their place in it, and each partition's ids begin where those before it end
    (one count a partition is collected)."""
    part, place = "tidemark_part", "tidemark_place"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits of this id count the rows of the partition
    placed = written(ranged.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    sizes = placed.groupBy(part).agg(F.max(place).alias("last")).orderBy(part).collect()
    begins, total = [], start
    for r in sizes:
        begins.append((r[part], total))
        total += r["last"] + 1
    first = df.sparkSession.createDataFrame(begins, f"{part} int, tidemark_first long")
    # one row a partition
    return placed.join(F.broadcast(first), part).withColumn(name, F.col("tidemark_first") + F.col(place) + 1).select(*[c for c in df.columns if c != name], name)

"""Whether two tables of one key are equal, at size: digests by bucket of the key first, rows of differing buckets only.

The digest of a bucket does not depend on order: the number of its rows and the sums of two hashes of each. Tables whose
digests agree are equal but for a chance of 2^-100 or so; where some differ, only their buckets are compared row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def bucket_of(key: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def row_hashes(columns: list[str]) -> tuple[Column, Column]:
    """Two hashes of a row that tell null from every value and one column from another."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *reversed(parts))


def digests(df: DataFrame, key: list[str], columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """bucket, rows, first, second: one row a bucket, made by partial sums."""
    first, second = (h.cast("decimal(20,0)") for h in row_hashes(columns))
    return df.groupBy(bucket_of(key, buckets).alias("bucket")).agg(F.count("*").alias("rows"), F.sum(first).alias("first"), F.sum(second).alias("second"))


def differing_buckets(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], buckets: int = BUCKETS) -> list[int]:
    """The buckets whose digests differ; at most ``buckets`` numbers are collected."""
    x, y = digests(a, key, columns, buckets).alias("x"), digests(b, key, columns, buckets).alias("y")
    same = F.struct("x.rows", "x.first", "x.second").eqNullSafe(F.struct("y.rows", "y.first", "y.second"))
    found = x.join(y, F.col("x.bucket") == F.col("y.bucket"), "full").where(~same)
    return sorted(r[0] for r in found.select(F.coalesce("x.bucket", "y.bucket")).collect())


def differences(a: DataFrame, b: DataFrame, key: list[str], columns: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows of one side only, with ``side`` (left, right), as often as that side has more of them."""
    columns = columns or a.columns
    found = differing_buckets(a, b, key, columns, buckets)
    mine = bucket_of(key, buckets).isin(found) if found else F.lit(False)
    left, right = a.where(mine).select(*columns), b.where(mine).select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def flag_parity(stored: DataFrame, computed: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """flag, stored_cnt, computed_cnt, differing_cnt: how many rows have each flag on either side, and on how many rows the sides
    disagree (a row that one side lacks disagrees on all). One join on the key."""
    a = stored.select(F.col(key).alias("k"), F.struct(*[F.col(f).cast("boolean").alias(f) for f in flags]).alias("a"))
    b = computed.select(F.col(key).alias("l"), F.struct(*[F.col(f).cast("boolean").alias(f) for f in flags]).alias("b"))
    both = a.join(b, F.col("k") == F.col("l"), "full")
    lone = F.col("a").isNull() | F.col("b").isNull()
    counts = [c for f in flags for c in (F.count_if(F.col(f"a.{f}")).alias(f"s_{f}"), F.count_if(F.col(f"b.{f}")).alias(f"c_{f}"), F.count_if(lone | ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f"d_{f}"))]
    pairs = ", ".join(f"'{f}', `s_{f}`, `c_{f}`, `d_{f}`" for f in flags)
    return both.agg(*counts).select(F.expr(f"stack({len(flags)}, {pairs}) AS (flag, stored_cnt, computed_cnt, differing_cnt)"))

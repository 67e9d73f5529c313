"""Mixing sources to target weights, with DataFrame functions only.

Size of a document: its words ``[^\\x20\\x09-\\x0D]+`` (null text: 0). Sources are taken by code point, null last,
and weigh 3, 1, 2, 3, ... They share ``total`` times all sizes by weight; a target stops at ``most`` times its
source's size, and the excess is shared again by weight until no target is above. A document is taken
floor(rate) times, plus once more with probability rate - floor(rate), drawn from a hash of seed and id, so
reruns agree and no document is taken more than ``most`` times.

Defined results: an empty table gives an empty table; a source without words has target 0 and takes nothing;
a null id draws as the text "null"; repeated rows are documents of their own that draw alike; other columns, of any name,
are ignored by ``mix`` and kept as they are by ``emit``. The windows over sources are one task: one row a source; where
sources are web hosts, group them first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.shared import saved, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Sources up to which the table of targets (about 60 bytes a row) is broadcast; beyond, a skew-split join is used.
BROADCAST_ROWS = 100_000


def size_of(text: Column) -> Column:
    """Number of words: the characters that start one are those left when a word becomes one character."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target for a table of (source, size). The capped sources are those with the least size
    for their weight, so with sources in that order one running sum shows where the level stops."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows without a key: one row a source, not a document
    ranked = per.withColumn("i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights)).cast("int") + 1))
    cap = F.col("source_size").cast("double") * most
    up = W.orderBy("reach", "i")
    level = (
        weighted.withColumn("cap", cap)
        .withColumn("reach", F.col("cap") / F.col("w"))
        .withColumn("below", F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(W.partitionBy()) * total)
        .withColumn("level", (F.col("all") - F.col("below")) / F.col("open"))
        # the first source, from the least reach, that its share does not fill sets the level for itself and all after it
        .withColumn("fits", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "i", "level"))).over(W.partitionBy()))
    )
    target = F.when(F.col("fits").isNull() | (F.struct("reach", "i") < F.struct("fits.reach", "fits.i")), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("fits.level")))
    return level.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0, seed: int = 17, keep: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (``keep``: and every column of docs, as the struct row)."""
    row = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if keep else []
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), *row)
    goal = saved(targets(sized.select("source", "size"), weights, total, most), "mix-targets")
    side = goal.select(F.col("source").alias("goal_source"), "source_size", "target")
    if goal.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    joined = sized.join(side, sized["source"].eqNullSafe(F.col("goal_source"))).drop("goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + F.when(draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def emit(docs: DataFrame, **how) -> DataFrame:
    """Each document as many times as the mix takes it, with the columns of ``docs``."""
    mixed = mix(docs, keep=True, **how).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op5_mixing": op5_mixing}

ORACLE = {
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM p),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, source_size::DOUBLE * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, cap / w AS reach,
        coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE) AS below,
        sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
        sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM w),
v AS (SELECT *, (total - below) / open AS level FROM l),
f AS (SELECT reach AS f_reach, i AS f_i, level AS f_level FROM v WHERE level <= reach ORDER BY reach, i LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN f_i IS NULL OR reach < f_reach OR (reach = f_reach AND i < f_i) THEN cap ELSE least(cap, w * f_level) END AS target
      FROM v LEFT JOIN f ON TRUE),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0::DOUBLE END AS rate,
        ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies FROM q)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, source, copies FROM c
""",
}

"""A bounded training sample of labelled documents.

The bounds are documented parameters: at most ``rows`` documents of each class, in the order of a hash of
the id, and of those only as many as have ``max_bytes`` of text together; a document that alone has more
than a class's half of them is left out. Whole texts are used. The sample
of ids (a known number of 8-byte values) is broadcast, so the texts of the corpus are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int = 2000, max_bytes: int = 12 << 20) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of the sample; rows whose crc32(doc_id as text) mod ``modulus`` is ``held_out`` are left out.

    Null ids, null labels and labels other than 0 and 1 are ignored; a document labelled both ways is too, and
    repeated labels or documents count once.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .where(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out)
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .where("y = top")
        .select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    )
    picked = ids.where("y = 0").orderBy("h", "doc_id").limit(rows).union(ids.where("y = 1").orderBy("h", "doc_id").limit(rows))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    sized = texts.select("doc_id", "y", "h", F.octet_length("text").alias("b"))
    # at most 2 * rows ids reach this window, whatever the corpus
    kept = sized.groupBy("doc_id", "y", "h").agg(F.max("b").alias("b")).where(F.col("b") <= max_bytes // 2).withColumn("sum", F.sum("b").over(W.partitionBy("y").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)))
    chosen = {r.doc_id: r.y for r in kept.where(F.col("sum") <= max_bytes // 2).select("doc_id", "y").collect()}
    if not chosen:
        return []
    small = docs.sparkSession.createDataFrame(sorted(chosen.items()), "doc_id long, y int")
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(small), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")).collect()
    return sorted((r.doc_id, r.text, chosen[r.doc_id]) for r in got)

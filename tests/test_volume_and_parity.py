"""Hourly volumes by increments with late rows, and parity by digests."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import lifecycle as life
from tidemark.operators import parity
from tidemark.sources.catalog import Catalog
from tidemark.streaming.volume import HourlyVolume

EVENTS = "event_type string, kafka_load_dttm timestamp"


def counts(df):
    return Counter({(r.event_hour, r.event_type): r.events_cnt for r in df.collect()})


def test_stream_and_batch_agree_with_rows_a_day_late(spark, tmp_path):
    start, rng, every = datetime(2026, 8, 1), random.Random(1), []
    volume = HourlyVolume(Catalog(spark, str(tmp_path / "v")))
    for i in range(4):
        rows = [(rng.choice("ab"), start + timedelta(hours=i, minutes=rng.randrange(180))) for _ in range(30)]
        if i == 3:
            rows += [("a", start - timedelta(days=1)), ("b", start)]
        every += rows
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = volume.stream(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "c"))
        query.awaitTermination(120)
        assert query.exception() is None
    want = Counter((t.replace(minute=0), k) for k, t in every)
    outside = sum(r.events_cnt for r in volume.late.read().collect())
    assert outside >= 2 and sum(counts(volume.read()).values()) == len(every) - outside
    assert counts(volume.read(True)) == want
    assert volume.correct() == outside and volume.correct() == 0
    assert counts(volume.read()) == counts(volume.read(True)) == want


def test_batches_count_once(spark, tmp_path):
    volume = HourlyVolume(Catalog(spark, str(tmp_path)), buckets=8)
    at = datetime(2026, 8, 1, 5)
    rows = spark.createDataFrame([("a", at), ("a", at), (None, at)], EVENTS)
    assert volume.add(rows, 0) and not volume.add(rows, 0) and volume.add(rows.limit(0), 1)
    before = volume.hours.state()["parts"]
    assert volume.add(spark.createDataFrame([("z", at + timedelta(hours=1))], EVENTS), 2)
    # only the bucket of the new hour is rewritten
    assert sum(before.get(b) != p for b, p in volume.hours.state()["parts"].items()) == 1
    assert counts(volume.read()) == {(at, "a"): 2, (at, None): 1, (at + timedelta(hours=1), "z"): 1}


def many(spark, n):
    flags = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(5)).eqNullSafe(0).alias(f) for i, f in enumerate(life.FLAGS)]
    return spark.range(n).select(F.concat(F.lit("o"), "id").alias("order_id"), *flags)


def test_one_changed_flag_among_many_is_found(spark):
    rows = many(spark, 1_000_000)
    other = rows.withColumn(life.FLAGS[3], F.when(F.col("order_id") == "o777777", ~F.col(life.FLAGS[3])).otherwise(F.col(life.FLAGS[3])))
    key = ["order_id"]
    buckets = parity.differing_buckets(rows, other, key, rows.columns)
    assert len(buckets) == 1 and rows.where(parity.bucket_of(key) == buckets[0]).count() < 1000
    found = parity.differences(rows, other, key).collect()
    assert {(r.order_id, r.side) for r in found} == {("o777777", "left"), ("o777777", "right")}
    told = {r.flag: r.differing_cnt for r in parity.flag_parity(rows, other, "order_id", list(life.FLAGS)).collect()}
    assert told == {f: int(f == life.FLAGS[3]) for f in life.FLAGS}


def test_digests_see_nulls_repeats_and_order(spark):
    rows = spark.createDataFrame([("a", 1, None), ("b", None, 1), ("b", None, 1)], "k string, x int, y int")
    key = ["k"]
    same = spark.createDataFrame(rows.collect()[::-1], rows.schema).repartition(3)
    assert parity.differing_buckets(rows, same, key, rows.columns) == [] and parity.differences(rows, same, key).isEmpty()
    for changed in ([("a", None, 1), ("b", None, 1), ("b", None, 1)], [("a", 1, None), ("b", None, 1)], [("a", 1, None)] + [("b", None, 1)] * 3, []):
        other = spark.createDataFrame(changed, rows.schema)
        assert parity.differing_buckets(rows, other, key, rows.columns, 16)
        assert not parity.differences(rows, other, key, buckets=16).isEmpty()
    assert {r.flag: r.differing_cnt for r in parity.flag_parity(rows.selectExpr("k", "x = 1 AS f"), rows.selectExpr("k", "true AS f").limit(1), "k", ["f"]).collect()} == {"f": 2}

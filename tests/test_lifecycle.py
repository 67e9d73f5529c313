import random
from datetime import datetime, timedelta
from decimal import Decimal

from tidemark.operators import incremental as inc
from tidemark.operators import lifecycle as life
from tidemark.operators import mart as marts
from tidemark.operators.quality import differences

COORD = "raw_id long, kafka_topic string, kafka_partition int, kafka_offset long, kafka_load_dttm timestamp, order_id string"
CREATED = f"{COORD}, customer_id string, amount decimal(12,2), currency string, created_at timestamp, source_channel string"
PAID = f"{COORD}, payment_id string, paid_amount decimal(12,2), currency string, paid_at timestamp"
CANCELLED = f"{COORD}, cancellation_id string, cancellation_reason string, cancelled_at timestamp"


def at(text):
    return datetime.fromisoformat(f"2026-08-01T{text}")


def tables(spark, created, paid, cancelled):
    return spark.createDataFrame(created, CREATED), spark.createDataFrame(paid, PAID), spark.createDataFrame(cancelled, CANCELLED)


def test_golden_case(spark):
    raw = tables(
        spark,
        [(1, "c", 0, 1, at("12:00:01"), "order_1", "customer_first", Decimal("100.00"), "RUB", at("12:00:00"), "web"), (2, "c", 0, 2, at("12:01:01"), "order_1", "customer_duplicate", Decimal("200.00"), "USD", at("12:01:00"), "mobile")],
        [(1, "p", 0, 1, at("12:02:00"), "order_1", "payment_early", Decimal("90.00"), "USD", at("11:59:00")), (2, "p", 0, 2, at("12:10:01"), "order_1", "payment_latest", Decimal("100.00"), "RUB", at("12:10:00"))],
        [(1, "x", 0, 1, at("12:05:01"), "order_1", "cancellation_1", "customer_request", at("12:05:00"))],
    )
    for form in (life.enrich, life.enrich_windowed):
        (row,) = form(*raw).collect()
        assert (row.customer_id, row.order_amount, row.currency, row.status, row.payment_id) == ("customer_first", Decimal("100.00"), "RUB", "cancelled", "payment_latest")
        assert (row.payments_cnt, row.cancellations_cnt, row.duplicate_created_events_cnt) == (2, 1, 1)
        assert [row[f] for f in life.FLAGS] == [True, False, True, True, True, False, True]


def random_events(seed, orders=12, n=90):
    r = random.Random(seed)
    created, paid, cancelled = [], [], []
    for i in range(1, n + 1):
        order = f"o{r.randrange(orders)}"
        when = at("00:00:00") + timedelta(minutes=r.randrange(3 * 24 * 60))
        load = at("00:00:00") + timedelta(days=5, seconds=i)
        money, currency = Decimal(r.choice((100, 200))), r.choice(("RUB", "USD"))
        kind = r.random()
        if kind < 0.4:
            created.append((i, "c", r.randrange(2), i, load, order, f"customer_{i}", money, currency, when, r.choice(("web", None))))
        elif kind < 0.75:
            paid.append((i, "p", 0, i, load, order, f"p{i}", money, currency, when))
        else:
            cancelled.append((i, "x", 0, i, load, order, f"x{i}", "out_of_stock", when))
    return created, paid, cancelled


def test_forms_agree_and_empty_tables(spark):
    raw = tables(spark, *random_events(1))
    assert differences(life.enrich(*raw).select(*life.COLUMNS), life.enrich_windowed(*raw)).isEmpty()
    empty = tables(spark, [], [], [])
    assert life.enrich(*empty).isEmpty() and life.orphans(*empty).isEmpty() and marts.daily_orders(life.enrich(*empty)).isEmpty()
    only_paid = tables(spark, [], random_events(2)[1], [])
    assert life.enrich(*only_paid).isEmpty() and life.orphans(*only_paid).count() > 0


def test_any_batching_gives_the_same_tables(spark):
    """Events arrive in three batches by raw_id; orders, mart and dates move along and end as the full computation."""
    events = random_events(3)
    orders = mart = None
    for low, high in ((0, 30), (30, 60), (60, 90)):
        raw = tables(spark, *[[e for e in part if e[0] <= high] for part in events])
        keys = inc.affected_orders(list(raw), low, high)
        fresh = life.enrich(*inc.restrict(list(raw), keys)).select(*life.COLUMNS)
        if orders is None:
            orders = fresh.limit(0)
            mart = marts.daily_orders(orders)
        changes = inc.change_log(orders, fresh, list(life.COLUMNS[1:]))
        after = inc.upsert(orders, fresh, ["order_id"])
        mart = marts.refresh_dates(mart, after, inc.affected_dates(changes))
        orders = spark.createDataFrame(after.collect(), after.schema)
        mart = spark.createDataFrame(mart.collect(), mart.schema)
        assert differences(orders, life.enrich(*raw).select(*life.COLUMNS)).isEmpty()
        assert differences(mart, marts.daily_orders(orders)).isEmpty()


def test_surrogate_ids_are_consecutive(spark):
    df = spark.range(100).selectExpr("(id * 37) % 100 AS v")
    got = sorted((r.v, r.change_id) for r in inc.surrogate_ids(df, ["v"], 5).collect())
    assert got == [(i, i + 6) for i in range(100)]
    assert inc.surrogate_ids(df.limit(0), ["v"]).isEmpty()


def test_surrogate_ids_at_any_partitioning(spark):
    """Default partitions and a million rows; many partitions that adaptive execution would coalesce."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}
    for n, more in ((1_000_000, {"spark.sql.shuffle.partitions": "200"}), (200_000, conf)):
        old = {k: spark.conf.get(k, None) for k in more}
        try:
            for k, v in more.items():
                spark.conf.set(k, v)
            got = inc.surrogate_ids(spark.range(n).select(F.xxhash64("id").alias("v")), ["v"])
            assert got.agg(F.count("change_id"), F.countDistinct("change_id"), F.min("change_id"), F.max("change_id")).first() == (n, n, 1, n)
            wrong = got.withColumn("after", F.lag("v").over(W.partitionBy(F.lit(1)).orderBy("change_id"))).where("after >= v")
            assert wrong.isEmpty()
        finally:
            for k, v in old.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_snapshot_closes_opens_and_keeps(spark):
    t = lambda d: datetime(2026, 1, d)
    schema = "k string, v int, u timestamp"
    history = spark.createDataFrame([("a", 1, t(1), t(1), None), ("b", 1, t(1), t(1), None), ("gone", 1, t(1), t(1), None)], f"{schema}, valid_from timestamp, valid_to timestamp")
    now = spark.createDataFrame([("a", 2, t(3)), ("b", 1, t(1)), ("new", 1, t(3))], schema)
    got = sorted((r.k, r.v, r.valid_from.day, r.valid_to.day if r.valid_to else None) for r in inc.snapshot(history, now, "k", "u").collect())
    assert got == [("a", 1, 1, 3), ("a", 2, 3, None), ("b", 1, 1, None), ("gone", 1, 1, 3), ("new", 1, 3, None)]

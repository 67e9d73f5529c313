"""Queries of the data tests: one row a test, with its count of violations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import lifecycle as life
from tidemark.operators import mart as marts
from tidemark.operators import quality
from tidemark.plans.orders import all_orders
from tidemark.plans.sql import oracle
from tidemark.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def check(body: str, *reads: str):
    """Register a test under its function's name; ``body`` counts the violations in SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: quality.summary(f(spark, sf_dir), f.__name__)
        ORACLE[f.__name__] = oracle(f"SELECT '{f.__name__}' AS test, ({body})::BIGINT AS violations", *reads)
        return f

    return register


@check("SELECT count(*) FROM (SELECT order_id FROM created GROUP BY order_id HAVING count(*) > 1)", "created")
def test_unique(spark, sf_dir):
    """Sign-ups repeat orders, so this test has something to find."""
    return quality.not_unique(adapters.raw_created(spark, sf_dir), "order_id")


@check("SELECT count(*) FROM orders_all WHERE payment_id IS NULL", "orders_all")
def test_not_null(spark, sf_dir):
    return quality.is_null(all_orders(spark, sf_dir), "payment_id")


@check("SELECT count(*) FROM orders_all WHERE status IS NOT NULL AND status NOT IN ('created', 'paid')", "orders_all")
def test_accepted_values(spark, sf_dir):
    return quality.not_accepted(all_orders(spark, sf_dir), "status", ["created", "paid"])


@check("SELECT count(*) FROM orders_all WHERE status <> CASE WHEN cancellation_id IS NOT NULL THEN 'cancelled' WHEN payment_id IS NOT NULL THEN 'paid' ELSE 'created' END", "orders_all")
def test_status_precedence(spark, sf_dir):
    return quality.status_violations(all_orders(spark, sf_dir))


@check("SELECT count(*) FROM orphan o JOIN created c ON o.order_id = c.order_id", "orphan", "created")
def test_no_orphan_with_created(spark, sf_dir):
    raw = adapters.raw_tables(spark, sf_dir)
    return quality.orphans_with_order(life.orphans(*raw), raw[0])


@check("SELECT 0")
def test_mart_matches_dds(spark, sf_dir):
    orders = all_orders(spark, sf_dir)
    return quality.mart_differs(marts.daily_orders(orders), life.enrich_windowed(*adapters.raw_tables(spark, sf_dir)))


@check("SELECT count(*) FROM mart WHERE least(created_orders_cnt, paid_orders_cnt, cancelled_orders_cnt, created_status_orders_cnt, orders_with_dq_cnt) < 0", "mart")
def test_counts_non_negative(spark, sf_dir):
    return quality.negative_counts(marts.daily_orders(all_orders(spark, sf_dir)), "created_orders_cnt", "paid_orders_cnt", "cancelled_orders_cnt", "created_status_orders_cnt", "orders_with_dq_cnt")


@check("SELECT count(*) FROM (SELECT kafka_topic, kafka_partition, kafka_offset % 1000 AS o FROM created GROUP BY 1, 2, 3 HAVING count(*) > 1)", "created")
def test_duplicate_coordinates(spark, sf_dir):
    """Offsets are folded to 1000, as replayed topics would have them."""
    return quality.not_unique(adapters.raw_created(spark, sf_dir).withColumn("kafka_offset", adapters.F.col("kafka_offset") % 1000), "kafka_topic", "kafka_partition", "kafka_offset")


@check("SELECT CASE WHEN count(*) = 1 THEN 0 ELSE 1 END FROM (SELECT max(ts) AS m FROM ev)", "ev")
def test_single_row(spark, sf_dir):
    """The health view has one row."""
    from tidemark.plans.monitoring import health_classification

    return health_classification(spark, sf_dir).groupBy().count().where("count <> 1")



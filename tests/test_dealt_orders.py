"""Steps on orders are dealt to as many tasks as their events need, whatever the session's number of shuffle partitions."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import incremental as inc
from tidemark.operators import lifecycle as life
from tidemark.plans import orders as plans
from tidemark.sources.adapters import raw_tables

SF = "/root/testdata/sf0.01"


@pytest.fixture
def few_events_a_task(monkeypatch):
    monkeypatch.setattr(life, "EVENTS_A_TASK", 500, raising=False)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_a_task_gets_a_bounded_part_of_the_upsert(spark, few_events_a_task):
    events = sum(s.count() for s in raw_tables(spark, SF))
    assert events > 5000
    stepped = plans.upsert_orders(spark, SF)
    assert most_in_a_task(stepped) <= 500
    whole = plans.all_orders(spark, SF).select(*life.COLUMNS)
    assert whole.count() == stepped.count() and whole.exceptAll(stepped).isEmpty()


def test_parity_deals_both_sides_by_the_key(spark):
    full = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 3)], "order_id string, x int")
    step = spark.createDataFrame([(1, "a"), (None, "b"), (4, "c"), (5, "d")], "x int, order_id string")
    assert [tuple(r) for r in plans._parity("t", full, step, "order_id", 3).collect()] == [("t", 4, 4)]
    assert [tuple(r) for r in plans._parity("t", full, full).collect()] == [("t", 0, 4)]
    assert [tuple(r) for r in plans._parity("t", full.limit(0), full.limit(0)).collect()] == [("t", 0, 0)]


def test_affected_dates_read_the_changes_once(spark):
    changes = spark.sql("SELECT * FROM VALUES (DATE'2024-01-01', DATE'2024-01-02'), (NULL, DATE'2024-01-02'), (DATE'2024-01-03', NULL) AS t(old_order_dt, new_order_dt)").repartition(2)
    found = inc.affected_dates(changes, spark.sql("SELECT DATE'2024-02-01' AS order_dt"))
    assert sorted(str(r[0]) for r in found.collect()) == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-02-01"]
    assert inc.affected_dates(changes)._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1

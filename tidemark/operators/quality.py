"""Declarative data tests: each returns the rows that violate it, and ``summary`` counts them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lifecycle import order_status
from tidemark.operators.mart import daily_orders


def summary(violations: DataFrame, name: str) -> DataFrame:
    """test, violations: one row also where nothing is wrong."""
    return violations.agg(F.count("*").alias("violations")).select(F.lit(name).alias("test"), "violations")


def not_unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).count().where("count > 1")


def is_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def not_accepted(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values))


def status_violations(orders: DataFrame) -> DataFrame:
    """Orders whose status is not what their payment and cancellation say."""
    return orders.where(F.col("status") != order_status(F.col("cancellation_id"), F.col("payment_id")))


def orphans_with_order(orphans: DataFrame, created: DataFrame) -> DataFrame:
    return orphans.join(created.select("order_id"), "order_id", "left_semi")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with ``side``."""
    columns = sorted(a.columns)
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def mart_differs(mart: DataFrame, orders: DataFrame) -> DataFrame:
    return differences(mart, daily_orders(orders))


def negative_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(F.least(*columns, F.lit(0)) < 0)


def exposes_payload(df: DataFrame, hidden: tuple[str, ...]) -> list[str]:
    """Columns that a monitoring view must not show."""
    return sorted(set(df.columns) & set(hidden))

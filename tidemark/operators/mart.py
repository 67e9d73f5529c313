"""The daily order mart and its upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lifecycle import dq_any

MONEY = "decimal(14,2)"


def _sum(amount, of=None):
    return F.coalesce(F.sum(amount if of is None else F.when(of, amount)), F.lit(0)).cast(MONEY)


def daily_orders(orders: DataFrame) -> DataFrame:
    """Counts and sums by day of creation (UTC). Revenue is of paid orders; gross is of all."""
    status = F.col("status")
    return orders.groupBy(F.col("created_at").cast("date").alias("order_dt")).agg(
        F.count("order_id").cast("int").alias("created_orders_cnt"),
        F.count_if(status == "paid").cast("int").alias("paid_orders_cnt"),
        F.count_if(status == "cancelled").cast("int").alias("cancelled_orders_cnt"),
        F.count_if(status == "created").cast("int").alias("created_status_orders_cnt"),
        _sum(F.col("order_amount")).alias("gross_order_amount"),
        _sum(F.col("paid_amount"), status == "paid").alias("paid_revenue"),
        F.count_if(dq_any()).cast("int").alias("orders_with_dq_cnt"),
    )


def refresh_dates(mart: DataFrame, orders: DataFrame, dates: DataFrame) -> DataFrame:
    """The mart after recomputing ``dates`` (order_dt): dates that have no orders left disappear."""
    fresh = daily_orders(orders.join(dates.select(F.col("order_dt").alias("dt")), F.col("created_at").cast("date") == F.col("dt"), "left_semi"))
    return mart.join(dates, "order_dt", "left_anti").unionByName(fresh)


def dates_of_history(history: DataFrame, since) -> DataFrame:
    """Dates of order versions that opened or closed after ``since`` (null: ever): what a mart as of then must recompute."""
    later = F.lit(since).isNull() | (F.col("valid_from") > F.lit(since)) | (F.col("valid_to") > F.lit(since))
    return history.where(later).select(F.col("created_at").cast("date").alias("order_dt")).where("order_dt IS NOT NULL").distinct()


def dates_with_zeros(orders: DataFrame, dates: DataFrame) -> DataFrame:
    """Counts for the given dates, 0 where there are no orders."""
    joined = dates.join(orders.withColumn("order_day", F.col("created_at").cast("date")), F.col("order_dt") == F.col("order_day"), "left")
    return joined.groupBy("order_dt").agg(F.count("order_id").cast("int").alias("created_orders_cnt"), _sum(F.col("order_amount")).alias("gross_order_amount"))


def revenue_by_currency(orders: DataFrame) -> DataFrame:
    paid = orders.where("status = 'paid'")
    return paid.groupBy(F.col("created_at").cast("date").alias("order_dt"), "currency").agg(F.count("*").cast("int").alias("paid_orders_cnt"), _sum(F.col("paid_amount")).alias("paid_revenue"))

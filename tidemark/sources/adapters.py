"""Order-lifecycle tables out of the star-schema test tables.

``events`` carries sign-ups, purchases and errors: they stand for created, paid and cancelled orders. Clicks stand for
pipeline runs and views for dead letters, so that the monitoring operators have input of some size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENCIES = ("RUB", "USD", "EUR")
REASONS = ("customer_request", "payment_failed", "out_of_stock", "fraud_rejected")


def _choose(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events of one kind, the number in ``props`` as ``k``."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == kind)
    return rows.select("event_id", "ts", "user_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _coordinates(topic: str) -> list[Column]:
    return [
        F.col("event_id").alias("raw_id"),
        F.lit(topic).alias("kafka_topic"),
        F.lit(0).alias("kafka_partition"),
        F.col("event_id").alias("kafka_offset"),
        F.col("ts").alias("kafka_load_dttm"),
        F.concat_ws("-", "user_id", F.col("k") % 10).alias("order_id"),
    ]


def raw_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "signup").select(
        *_coordinates("ecommerce.order_created.v2"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("value").cast("decimal(12,2)").alias("amount"),
        _choose(F.col("event_id"), CURRENCIES).alias("currency"),
        F.col("ts").alias("created_at"),
        F.when(F.col("k") % 2 == 0, "web").otherwise("mobile").alias("source_channel"),
    )


def raw_paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "purchase").select(
        *_coordinates("ecommerce.order_paid.v1"),
        F.col("event_id").cast("string").alias("payment_id"),
        F.col("value").cast("decimal(12,2)").alias("paid_amount"),
        _choose(F.col("event_id"), CURRENCIES).alias("currency"),
        F.col("ts").alias("paid_at"),
    )


def raw_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "error").select(
        *_coordinates("ecommerce.order_cancelled.v1"),
        F.col("event_id").cast("string").alias("cancellation_id"),
        _choose(F.col("event_id"), REASONS).alias("cancellation_reason"),
        F.col("ts").alias("cancelled_at"),
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Created, paid and cancelled RAW tables."""
    return raw_created(spark, sf_dir), raw_paid(spark, sf_dir), raw_cancelled(spark, sf_dir)


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir, "view")
        .select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("ecommerce."), _choose(F.col("event_id"), ("order_created", "order_paid", "order_cancelled")), F.lit(".v1")).alias("kafka_topic"),
            F.lit(0).alias("kafka_partition"),
            F.col("event_id").alias("kafka_offset"),
            _choose(F.col("event_id"), ("order_created", "order_paid", "order_cancelled")).alias("contract_name"),
            F.lit(1).alias("contract_version"),
            F.encode(F.concat(F.lit('{"k": '), "k", F.lit("}")), "UTF-8").alias("raw_payload"),
            F.concat(F.lit("Field 'f"), F.col("k") % 7, F.lit("' is required")).alias("error_message"),
            F.col("ts").alias("load_dttm"),
        )
    )


def analytics_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "click").select(
        F.col("event_id").cast("string").alias("run_id"),
        _choose(F.col("k"), ("manual", "scheduled", "ci", "airflow")).alias("trigger_type"),
        F.when(F.col("k") % 13 == 0, "running").when(F.col("k") % 11 == 0, "error").when(F.col("k") % 7 == 0, "warning").otherwise("success").alias("status"),
        F.col("ts").alias("started_at"),
        F.when(F.col("k") % 13 != 0, F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("finished_at"),
        F.col("value").alias("duration_seconds"),
        F.when(F.col("k") % 17 == 0, "warn").otherwise("pass").alias("freshness_status"),
        F.when(F.col("k") % 11 == 0, "error").otherwise("success").alias("build_status"),
    )

"""Monitoring views: health, volumes, data-quality report, runs, dead letters, freshness, alert."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lifecycle import FLAGS, dq_any

# fixed values: names of the nine reported issues, in report order
ISSUES = ("multiple_payments", "multiple_cancellations", "payment_amount_mismatch", "payment_currency_mismatch", "payment_before_creation", "cancellation_before_creation", "payment_after_cancellation", "duplicate_created_events", "orphan_events")
PAYLOAD_COLUMNS = ("raw_payload", "event_payload", "original_payload")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Age in seconds, never negative, 0 where unknown (greatest skips null)."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.greatest(micros / 1e6, F.lit(0.0))


def in_range(df: DataFrame, at: str, begin: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows of a dashboard's time range, both ends included; the bounds reach the scan."""
    bounds = [F.col(at) >= begin] * (begin is not None) + [F.col(at) <= end] * (end is not None)
    return df.where(reduce(lambda a, b: a & b, bounds)) if bounds else df


def relation_columns(spark: SparkSession, relations: dict[str, DataFrame]) -> DataFrame:
    """relation, position, column_name, data_type, exposes_payload: the catalog of what monitoring shows (schemas only)."""
    rows = [(n, i, f.name, f.dataType.simpleString(), f.name in PAYLOAD_COLUMNS) for n, df in relations.items() for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, "relation string, position int, column_name string, data_type string, exposes_payload boolean")


def volume_hourly(sources: dict[str, DataFrame], at: str = "kafka_load_dttm") -> DataFrame:
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("event_type"), F.date_trunc("hour", at).cast("timestamp_ntz").alias("event_hour")) for n, df in sources.items()])
    return rows.groupBy("event_hour", "event_type").agg(F.count("*").alias("events_cnt"))


def dead_letter_hourly(dead: DataFrame) -> DataFrame:
    return dead.groupBy(F.date_trunc("hour", "load_dttm").cast("timestamp_ntz").alias("event_hour"), "contract_name").agg(F.count("*").alias("dead_letters_cnt"))


def dq_report(orders: DataFrame, orphans: DataFrame) -> DataFrame:
    """sort_order, issue, orders_cnt: one pass over orders, one over orphans."""
    counts = [F.count_if(F.col(f)).alias(i) for f, i in zip(FLAGS, ISSUES, strict=False)] + [F.count_if(F.col("duplicate_created_events_cnt") > 0).alias(ISSUES[7])]
    one = orders.agg(*counts).crossJoin(orphans.agg(F.count("*").alias(ISSUES[8])))  # two single rows
    pairs = ", ".join(f"{k}, '{i}', `{i}`" for k, i in enumerate(ISSUES, 1))
    return one.select(F.expr(f"stack({len(ISSUES)}, {pairs}) AS (sort_order, issue, orders_cnt)"))


def recent(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n latest rows, without payloads."""
    return df.drop(*PAYLOAD_COLUMNS).orderBy(*order).limit(n)


def run_history(runs: DataFrame, n: int = 20) -> DataFrame:
    """The n latest runs, newest first."""
    return recent(runs, [F.desc("started_at"), F.desc("run_id")], n).select("run_id", "trigger_type", "status", "freshness_status", "build_status", "duration_seconds", "started_at")


def run_window(runs: DataFrame, as_of: Column) -> DataFrame:
    """One row: completed runs and successful builds started within 24 hours before ``as_of``, and runs still going."""
    lately = F.col("started_at") >= as_of - F.expr("INTERVAL 24 HOURS")
    ended = F.col("status") != "running"
    return runs.agg(
        F.count_if(lately & ended).alias("run_count_24h"),
        F.count_if(lately & ended & (F.col("build_status") == "success")).alias("successful_build_count_24h"),
        F.count_if(~ended).alias("active_run_count"),
    )


def success_rate() -> Column:
    """Share of successful builds in a run_window() row; 0 without runs."""
    runs = F.col("run_count_24h")
    return F.when(runs == 0, F.lit(0.0)).otherwise(F.col("successful_build_count_24h").cast("double") / runs.cast("double"))


# fixed values: the reasons of the health view; the first that applies decides, up to STALE_REASON critically
HEALTHY_REASON = "Pipeline is healthy"
_ARMS: tuple[tuple[int, str, str], ...] = (
    (2, "latest_completed_status IS NULL", "No completed analytics run"),
    (2, "latest_completed_status = 'error' OR build_status = 'error'", "Latest dbt build failed"),
    (2, "last_success_age_seconds IS NULL", "No successful dbt build"),
    (2, "last_success_age_seconds > 900", "No successful dbt build within 15 minutes"),
    (2, "latest_raw_created_at IS NULL", "No order_created events in RAW"),
    (2, "source_freshness_age_seconds > 3600", "RAW order_created is more than 60 minutes stale"),
    (1, "latest_completed_status = 'warning'", "Latest analytics run completed with a warning"),
    (1, "freshness_status IN ('warn', 'error')", "Latest dbt source freshness check did not pass"),
    (1, "source_freshness_age_seconds > 900", "RAW order_created is more than 15 minutes stale"),
    (1, "dead_letter_count_24h > 0", "Dead-letter events were recorded in the last 24 hours"),
    (1, "dq_affected_orders > 0", "Current DDS orders contain data-quality issues"),
    (1, "orphan_order_count > 0", "Orphan payment or cancellation events are present"),
)


def classify(metrics: DataFrame) -> DataFrame:
    """health_code (0 to 2), overall_health and health_reason by the first arm that holds."""
    code, reason = F.lit(0), F.lit(HEALTHY_REASON)
    for level, test, why in reversed(_ARMS):
        code, reason = F.when(F.expr(test), level).otherwise(code), F.when(F.expr(test), why).otherwise(reason)
    coded = metrics.withColumn("health_code", code).withColumn("health_reason", reason)
    return coded.withColumn("overall_health", F.when(F.col("health_code") == 0, "healthy").when(F.col("health_code") == 1, "warning").otherwise("critical"))


def pipeline_health(runs: DataFrame, created: DataFrame, dead: DataFrame, orders: DataFrame, orphans: DataFrame, as_of: Column) -> DataFrame:
    """A single row: metrics and their classification. Every input is reduced to one row before they meet, and the latest
    runs come from max_by, so that nothing is sorted."""
    key = F.struct("started_at", "run_id")
    ended = F.col("status") != "running"

    def latest(name: str, only: Column | None = None) -> Column:
        return F.max_by(name, key if only is None else F.when(only, key))

    given = {c: F.col(c) if c in runs.columns else F.lit(None).cast(kind) for c, kind in (("duration_seconds", "double"), ("error_message", "string"))}
    runs = runs.withColumns(given)
    built = (F.col("build_status") == "success") & F.col("status").isin("success", "warning")
    one = runs.agg(
        latest("status").alias("latest_run_status"),
        latest("trigger_type").alias("latest_run_trigger"),
        F.max("started_at").alias("latest_run_started_at"),
        F.when(F.count_if(ended) > 0, latest("status", ended)).alias("latest_completed_status"),
        F.when(F.count_if(ended) > 0, latest("freshness_status", ended)).alias("freshness_status"),
        F.when(F.count_if(ended) > 0, latest("build_status", ended)).alias("build_status"),
        F.when(F.count_if(ended) > 0, latest("duration_seconds", ended)).alias("latest_duration_seconds"),
        F.when(F.count_if(ended) > 0, latest("error_message", ended)).alias("latest_error_message"),
        F.max(F.when(built, F.col("finished_at"))).alias("last_successful_build_at"),
    )
    parts = [
        run_window(runs, as_of).withColumn("build_success_rate_24h", success_rate()),
        created.agg(F.max("kafka_load_dttm").alias("latest_raw_created_at")),
        dead.agg(F.count_if(F.col("load_dttm") >= as_of - F.expr("INTERVAL 24 HOURS")).alias("dead_letter_count_24h")),
        orders.agg(F.count_if(dq_any()).alias("dq_affected_orders")),
        orphans.agg(F.count("*").alias("orphan_order_count")),
    ]
    for part in parts:
        one = one.crossJoin(part)  # single rows
    aged = one.withColumn("last_success_age_seconds", seconds_between(as_of, F.col("last_successful_build_at")))
    return classify(aged.withColumn("source_freshness_age_seconds", seconds_between(as_of, F.col("latest_raw_created_at"))))


def freshness(df: DataFrame, as_of: Column, at: str = "kafka_load_dttm", warn_s: int = 900, error_s: int = 3600) -> DataFrame:
    """max_loaded_at, age_seconds and status (pass, warn, error) of a source."""
    row = df.agg(F.max(at).alias("max_loaded_at")).withColumn("age_seconds", seconds_between(as_of, F.col("max_loaded_at")))
    return row.withColumn("status", F.when(F.col("max_loaded_at").isNull() | (F.col("age_seconds") > error_s), "error").when(F.col("age_seconds") > warn_s, "warn").otherwise("pass"))


def freshness_of(loaded_at: datetime | None, as_of: datetime, warn_s: int = 900, error_s: int = 3600) -> str:
    """The status of freshness() for a time of loading that is known without a scan."""
    age = None if loaded_at is None else (as_of - loaded_at).total_seconds()
    return "error" if age is None or age > error_s else "warn" if age > warn_s else "pass"


def alert(history: DataFrame, hold_minutes: int = 2, level: int = 1) -> DataFrame:
    """Whether the last codes have been above ``level`` for the hold time; no history alerts too. Columns: at, health_code."""
    last = history.agg(F.max("at").alias("last_at"), F.max_by("health_code", "at").alias("last_code"), F.max(F.when(F.col("health_code") <= level, F.col("at"))).alias("last_good"), F.min("at").alias("first_at"))
    since = F.coalesce("last_good", "first_at")
    held = seconds_between(F.col("last_at"), since) >= 60 * hold_minutes
    return last.select("last_at", "last_code", F.when(F.col("last_at").isNull(), "alerting").when((F.col("last_code") > level) & held, "alerting").when(F.col("last_code") > level, "pending").otherwise("normal").alias("state"))

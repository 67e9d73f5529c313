"""Queries of the monitoring views. ``as_of`` is the latest event time, so results do not depend on the clock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lifecycle as life
from tidemark.operators import monitor
from tidemark.plans.orders import all_orders
from tidemark.plans.sql import oracle
from tidemark.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def as_of(spark: SparkSession, sf_dir: str) -> Column:
    """The latest event time as a literal (one row is read)."""
    return F.lit(str(spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts")).first()[0])).cast("timestamp_ntz")


_NOW = {"clock": ("SELECT max(ts) AS now FROM ev", ("ev",))}


@query(oracle("SELECT date_trunc('hour', kafka_load_dttm)::TIMESTAMP AS event_hour, event_type, count(*) AS events_cnt FROM lifecycle GROUP BY 1, 2", "lifecycle"))
def event_volume_hourly(spark, sf_dir):
    return monitor.volume_hourly(dict(zip(("created", "paid", "cancelled"), adapters.raw_tables(spark, sf_dir), strict=True)))


@query(oracle("SELECT date_trunc('hour', load_dttm)::TIMESTAMP AS event_hour, contract_name, count(*) AS dead_letters_cnt FROM dead GROUP BY 1, 2", "dead"))
def dead_letter_volume_hourly(spark, sf_dir):
    return monitor.dead_letter_hourly(adapters.dead_letters(spark, sf_dir))


_ISSUES = {
    "issues": (
        " UNION ALL ".join([f"SELECT {k} AS sort_order, '{i}' AS issue, (SELECT count(*) FROM orders_all WHERE {f}) AS orders_cnt" for k, (i, f) in enumerate(zip(monitor.ISSUES, life.FLAGS, strict=False), 1)] + ["SELECT 8, 'duplicate_created_events', (SELECT count(*) FROM orders_all WHERE duplicate_created_events_cnt > 0)", "SELECT 9, 'orphan_events', (SELECT count(*) FROM orphan)"]),
        ("orders_all", "orphan"),
    )
}


@query(oracle("SELECT * FROM issues", **_ISSUES))
def dq_issue_breakdown(spark, sf_dir):
    return monitor.dq_report(all_orders(spark, sf_dir), life.orphans(*adapters.raw_tables(spark, sf_dir)))


@query(oracle("SELECT " + ", ".join(f"(SELECT orders_cnt FROM issues WHERE issue = '{i}') AS {i}" for i in monitor.ISSUES), **_ISSUES))
def dq_issue_pivot(spark, sf_dir):
    report = monitor.dq_report(all_orders(spark, sf_dir), life.orphans(*adapters.raw_tables(spark, sf_dir)))
    return report.groupBy().pivot("issue", list(monitor.ISSUES)).agg(F.first("orders_cnt"))


@query(oracle("SELECT id, kafka_topic, kafka_partition, kafka_offset, contract_name, contract_version, error_message, load_dttm FROM dead ORDER BY load_dttm DESC, id DESC LIMIT 50", "dead"))
def recent_dead_letters(spark, sf_dir):
    return monitor.recent(adapters.dead_letters(spark, sf_dir), [F.desc("load_dttm"), F.desc("id")], 50)


@query(oracle("SELECT run_id, trigger_type, status, started_at, finished_at, round(duration_seconds::DECIMAL(18,6), 2)::DOUBLE AS duration_seconds, freshness_status, build_status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 50", "runs"))
def recent_runs_top50(spark, sf_dir):
    rows = monitor.recent(adapters.analytics_runs(spark, sf_dir), [F.desc("started_at"), F.desc("run_id")], 50)
    return rows.withColumn("duration_seconds", F.round(F.col("duration_seconds").cast("decimal(18,6)"), 2).cast("double"))


@query(oracle("SELECT run_id, status, started_at FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1", "runs"))
def latest_run(spark, sf_dir):
    return adapters.analytics_runs(spark, sf_dir).agg(F.max_by(F.struct("run_id", "status", "started_at"), F.struct("started_at", "run_id")).alias("r")).select("r.*")


_WINDOW = {"win": ("SELECT count(*) FILTER (WHERE started_at >= now - INTERVAL 24 HOUR AND status <> 'running') AS run_count_24h, count(*) FILTER (WHERE started_at >= now - INTERVAL 24 HOUR AND status <> 'running' AND build_status = 'success') AS successful_build_count_24h, count(*) FILTER (WHERE status = 'running') AS active_run_count FROM runs, clock", ("runs", "clock"))}


@query(oracle("SELECT * FROM win", **_NOW, **_WINDOW))
def run_window_24h(spark, sf_dir):
    return monitor.run_window(adapters.analytics_runs(spark, sf_dir), as_of(spark, sf_dir))


@query(oracle("SELECT round(CASE WHEN run_count_24h = 0 THEN 0 ELSE successful_build_count_24h::DOUBLE / run_count_24h::DOUBLE END, 6) AS build_success_rate_24h FROM win", **_NOW, **_WINDOW))
def build_success_rate(spark, sf_dir):
    return monitor.run_window(adapters.analytics_runs(spark, sf_dir), as_of(spark, sf_dir)).select(F.round(monitor.success_rate(), 6).alias("build_success_rate_24h"))


@query(oracle("SELECT event_type, count(*) AS events_cnt FROM lifecycle, clock WHERE kafka_load_dttm >= now - INTERVAL 24 HOUR GROUP BY event_type", "lifecycle", **_NOW))
def recent_24h_count(spark, sf_dir):
    events = life.union_events(*adapters.raw_tables(spark, sf_dir))
    return events.where(F.col("kafka_load_dttm") >= as_of(spark, sf_dir) - F.expr("INTERVAL 24 HOURS")).groupBy("event_type").agg(F.count("*").alias("events_cnt"))


@query(oracle("SELECT run_id, round(greatest(epoch_us(now) - epoch_us(finished_at), 0) / 1000000.0, 3)::DOUBLE AS age_seconds FROM runs, clock", "runs", **_NOW))
def age_seconds(spark, sf_dir):
    age = monitor.seconds_between(as_of(spark, sf_dir), F.col("finished_at"))
    return adapters.analytics_runs(spark, sf_dir).select("run_id", F.round(age, 3).alias("age_seconds"))


_AGES = {"fresh": ("SELECT max(kafka_load_dttm) AS max_loaded_at, round((epoch_us(max(now)) - epoch_us(max(kafka_load_dttm))) / 1000000.0, 3)::DOUBLE AS age_seconds FROM created, clock", ("created", "clock"))}


@query(oracle("SELECT max_loaded_at, age_seconds, CASE WHEN max_loaded_at IS NULL OR age_seconds > 3600 THEN 'error' WHEN age_seconds > 900 THEN 'warn' ELSE 'pass' END AS status FROM fresh", **_NOW, **_AGES))
def source_freshness(spark, sf_dir):
    return monitor.freshness(adapters.raw_created(spark, sf_dir), as_of(spark, sf_dir)).withColumn("age_seconds", F.round("age_seconds", 3))


_HEALTH = {
    "m": (
        """SELECT (SELECT status FROM runs WHERE status <> 'running' ORDER BY started_at DESC, run_id DESC LIMIT 1) AS latest_completed_status,
  (SELECT freshness_status FROM runs WHERE status <> 'running' ORDER BY started_at DESC, run_id DESC LIMIT 1) AS freshness_status,
  (SELECT build_status FROM runs WHERE status <> 'running' ORDER BY started_at DESC, run_id DESC LIMIT 1) AS build_status,
  round(greatest(epoch_us(now) - (SELECT epoch_us(max(finished_at)) FROM runs WHERE build_status = 'success' AND status IN ('success', 'warning')), 0) / 1000000.0, 3)::DOUBLE AS last_success_age_seconds,
  (SELECT max(kafka_load_dttm) FROM created) AS latest_raw_created_at,
  round(greatest(epoch_us(now) - (SELECT epoch_us(max(kafka_load_dttm)) FROM created), 0) / 1000000.0, 3)::DOUBLE AS source_freshness_age_seconds,
  (SELECT count(*) FROM dead WHERE load_dttm >= now - INTERVAL 24 HOUR) AS dead_letter_count_24h,
  (SELECT count(*) FROM orders_dq WHERE dq) AS dq_affected_orders, (SELECT count(*) FROM orphan) AS orphan_order_count FROM clock""",
        ("runs", "created", "dead", "orders_dq", "orphan", "clock"),
    )
}
_CASES = "CASE " + " ".join(f"WHEN {test} THEN {{{i}}}" for i, (_, test, _) in enumerate(monitor._ARMS)) + " ELSE {n} END"
_CODE = _CASES.format(*[level for level, _, _ in monitor._ARMS], n=0)
_REASON = _CASES.format(*[f"'{why}'" for *_, why in monitor._ARMS], n=f"'{monitor.HEALTHY_REASON}'")


@query(oracle(f"SELECT *, {_CODE} AS health_code, {_REASON} AS health_reason, CASE {_CODE} WHEN 0 THEN 'healthy' WHEN 1 THEN 'warning' ELSE 'critical' END AS overall_health FROM m", **_NOW, **_HEALTH))
def health_classification(spark, sf_dir):
    raw = adapters.raw_tables(spark, sf_dir)
    row = monitor.pipeline_health(adapters.analytics_runs(spark, sf_dir), raw[0], adapters.dead_letters(spark, sf_dir), all_orders(spark, sf_dir), life.orphans(*raw), as_of(spark, sf_dir))
    ages = ("last_success_age_seconds", "source_freshness_age_seconds")
    return row.select("latest_completed_status", "freshness_status", "build_status", *[F.round(a, 3).alias(a) for a in ages], "latest_raw_created_at", "dead_letter_count_24h", "dq_affected_orders", "orphan_order_count", "health_code", "health_reason", "overall_health")


@query(oracle("SELECT lower(coalesce(status, 'unknown')) AS status, CASE WHEN lower(status) IN ('success', 'pass') THEN 'successful' WHEN lower(status) IN ('warn', 'warning') THEN 'warned' WHEN lower(status) IN ('error', 'fail', 'runtime error', 'skipped') THEN 'failed' ELSE 'other' END AS outcome, count(*) AS runs_cnt FROM runs GROUP BY 1, 2", "runs"))
def run_status_counts(spark, sf_dir):
    status = F.lower(F.coalesce("status", F.lit("unknown")))
    outcome = F.when(status.isin("success", "pass"), "successful").when(status.isin("warn", "warning"), "warned").when(status.isin("error", "fail", "runtime error", "skipped"), "failed").otherwise("other")
    return adapters.analytics_runs(spark, sf_dir).select(status.alias("status"), outcome.alias("outcome")).groupBy("status", "outcome").agg(F.count("*").alias("runs_cnt"))


_CODES = {"hist": ("SELECT started_at AS seen, CASE status WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS health_code FROM (SELECT *, row_number() OVER (PARTITION BY started_at ORDER BY run_id DESC) AS rn FROM runs) WHERE rn = 1", ("runs",))}


@query(oracle("SELECT max(seen) AS last_at, max_by(health_code, seen) AS last_code, CASE WHEN max(seen) IS NULL THEN 'alerting' WHEN max_by(health_code, seen) > 1 AND epoch_us(max(seen)) - epoch_us(coalesce(max(CASE WHEN health_code <= 1 THEN seen END), min(seen))) >= 120000000 THEN 'alerting' WHEN max_by(health_code, seen) > 1 THEN 'pending' ELSE 'normal' END AS state FROM hist", **_CODES))
def alert_last_value(spark, sf_dir):
    code = F.when(F.col("status") == "error", 2).when(F.col("status") == "warning", 1).otherwise(0)
    history = adapters.analytics_runs(spark, sf_dir).groupBy(F.col("started_at").alias("at")).agg(F.max_by(code, "run_id").alias("health_code"))
    return monitor.alert(history)


@query(oracle("SELECT date_trunc('hour', kafka_load_dttm)::TIMESTAMP AS event_hour, event_type, count(*) AS events_cnt FROM lifecycle, clock WHERE kafka_load_dttm >= now - INTERVAL 7 DAY AND kafka_load_dttm <= now - INTERVAL 1 DAY GROUP BY 1, 2", "lifecycle", **_NOW))
def event_volume_in_range(spark, sf_dir):
    """The volume panel over a dashboard's time range."""
    now = as_of(spark, sf_dir)
    sources = {n: monitor.in_range(df, "kafka_load_dttm", now - F.expr("INTERVAL 7 DAYS"), now - F.expr("INTERVAL 1 DAY")) for n, df in zip(("created", "paid", "cancelled"), adapters.raw_tables(spark, sf_dir), strict=True)}
    return monitor.volume_hourly(sources)


@query(oracle("SELECT date_trunc('hour', started_at)::TIMESTAMP AS run_hour, count(*) AS runs_cnt, count(*) FILTER (WHERE status = 'error') AS failed_cnt, round(avg(duration_seconds)::DECIMAL(24,8), 4)::DOUBLE AS mean_seconds FROM runs, clock WHERE started_at >= now - INTERVAL 24 HOUR AND started_at <= now AND status <> 'running' GROUP BY 1", "runs", **_NOW))
def run_duration_panel(spark, sf_dir):
    """Runs, failures and mean duration by hour of the last day."""
    now = as_of(spark, sf_dir)
    rows = monitor.in_range(adapters.analytics_runs(spark, sf_dir), "started_at", now - F.expr("INTERVAL 24 HOURS"), now).where("status <> 'running'")
    hour = F.date_trunc("hour", "started_at").cast("timestamp_ntz").alias("run_hour")
    return rows.groupBy(hour).agg(F.count("*").alias("runs_cnt"), F.count_if(F.col("status") == "error").alias("failed_cnt"), F.round(F.avg("duration_seconds").cast("decimal(24,8)"), 4).cast("double").alias("mean_seconds"))


@query(oracle("SELECT contract_name, error_message, count(*) AS dead_letters_cnt FROM dead, clock WHERE load_dttm >= now - INTERVAL 24 HOUR AND load_dttm <= now GROUP BY 1, 2", "dead", **_NOW))
def dead_letters_by_error(spark, sf_dir):
    """Dead letters of the last day by contract and error."""
    now = as_of(spark, sf_dir)
    rows = monitor.in_range(adapters.dead_letters(spark, sf_dir), "load_dttm", now - F.expr("INTERVAL 24 HOURS"), now)
    return rows.groupBy("contract_name", "error_message").agg(F.count("*").alias("dead_letters_cnt"))


@query(oracle("SELECT run_id, started_at, duration_seconds FROM runs, clock WHERE started_at >= now - INTERVAL 7 DAY AND started_at <= now - INTERVAL 1 DAY AND status <> 'running'", "runs", **_NOW))
def run_duration_series(spark, sf_dir):
    """The duration panel: each completed run of a dashboard's time range."""
    now = as_of(spark, sf_dir)
    rows = monitor.in_range(adapters.analytics_runs(spark, sf_dir), "started_at", now - F.expr("INTERVAL 7 DAYS"), now - F.expr("INTERVAL 1 DAY"))
    return rows.where("status <> 'running'").select("run_id", "started_at", "duration_seconds")


@query(oracle("SELECT date_trunc('hour', load_dttm)::TIMESTAMP AS event_hour, contract_name, count(*) AS dead_letters_cnt FROM dead, clock WHERE load_dttm >= now - INTERVAL 7 DAY AND load_dttm <= now - INTERVAL 1 DAY GROUP BY 1, 2", "dead", **_NOW))
def dead_letter_volume_in_range(spark, sf_dir):
    """The dead-letter panel over a dashboard's time range."""
    now = as_of(spark, sf_dir)
    return monitor.dead_letter_hourly(monitor.in_range(adapters.dead_letters(spark, sf_dir), "load_dttm", now - F.expr("INTERVAL 7 DAYS"), now - F.expr("INTERVAL 1 DAY")))


@query(oracle("SELECT id, kafka_topic, kafka_partition, kafka_offset, contract_name, contract_version, error_message, load_dttm FROM dead, clock WHERE load_dttm >= now - INTERVAL 7 DAY AND load_dttm <= now - INTERVAL 1 DAY ORDER BY load_dttm DESC, id DESC LIMIT 50", "dead", **_NOW))
def recent_dead_letters_in_range(spark, sf_dir):
    """The dead-letter table of a dashboard's time range."""
    now = as_of(spark, sf_dir)
    rows = monitor.in_range(adapters.dead_letters(spark, sf_dir), "load_dttm", now - F.expr("INTERVAL 7 DAYS"), now - F.expr("INTERVAL 1 DAY"))
    return monitor.recent(rows, [F.desc("load_dttm"), F.desc("id")], 50)


@query(oracle("SELECT run_id, trigger_type, status, freshness_status, build_status, duration_seconds, started_at FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 20", "runs"))
def run_history(spark, sf_dir):
    return monitor.run_history(adapters.analytics_runs(spark, sf_dir))

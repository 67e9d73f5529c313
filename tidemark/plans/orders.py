"""Queries on orders: lifecycle, incremental steps, mart, history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import incremental as inc
from tidemark.operators import lifecycle as life
from tidemark.operators import mart as marts
from tidemark.plans.sql import oracle
from tidemark.sources.adapters import raw_tables
from tidemark.sources.work import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Slice of raw_id that the incremental queries treat as new: the upper part of the greatest raw_id.
CUT = 0.7


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return life.enrich(*raw_tables(spark, sf_dir))


def _marks(sources) -> tuple[int, int]:
    """(last watermark, high watermark) of the simulated run: one row is collected."""
    top = inc.high_watermarks(dict(zip(("created", "paid", "cancelled"), sources, strict=True))).agg(F.max("last_raw_id")).first()[0]
    return int(top * CUT), top


def _upto(sources, mark: int) -> list[DataFrame]:
    return [s.where(F.col("raw_id") <= mark) for s in sources]


_BOUNDS = {"bounds": (f"SELECT CAST(floor(max(m) * {CUT}) AS BIGINT) AS low, max(m) AS high FROM (SELECT max(raw_id) AS m FROM created UNION ALL SELECT max(raw_id) FROM paid UNION ALL SELECT max(raw_id) FROM cancelled)", ("created", "paid", "cancelled"))}
_TOUCHED = _BOUNDS | {"touched": ("SELECT DISTINCT order_id FROM lifecycle, bounds WHERE raw_id > low AND raw_id <= high", ("lifecycle", "bounds"))}


def _old(sql_name: str) -> dict:
    """Parts that recompute orders as they were at the last watermark, under other names."""
    from tidemark.plans.sql import PARTS

    made = dict(_BOUNDS)
    names = ("created", "paid", "cancelled", "first_created", "last_paid", "last_cancelled", "orders_all", "orders_dq", "mart")
    for n in ("created", "paid", "cancelled"):
        made[f"old_{n}"] = (f"SELECT t.* FROM {n} t, bounds WHERE raw_id <= low", (n, "bounds"))
    for n in names[3 : names.index(sql_name) + 1]:
        text, reads = PARTS[n]
        for r in names:
            for lead in ("FROM ", "JOIN "):
                text = text.replace(f"{lead}{r} ", f"{lead}old_{r} ").replace(f"{lead}{r})", f"{lead}old_{r})")
            if text.endswith(f" {r}"):
                text = text[: -len(r)] + f"old_{r}"
        made[f"old_{n}"] = (text, tuple(f"old_{r}" if r in names else r for r in reads))
    return made


_COLUMNS = ", ".join(life.COLUMNS)


@query(oracle(f"SELECT {_COLUMNS} FROM orders_all", "orders_all"))
def orders_enriched(spark, sf_dir):
    return all_orders(spark, sf_dir)


@query(oracle(f"SELECT {_COLUMNS} FROM orders_all", "orders_all"))
def orders_enriched_windowed(spark, sf_dir):
    return life.enrich_windowed(*raw_tables(spark, sf_dir))


@query(oracle("SELECT order_id, status FROM orders_all", "orders_all"))
def order_status(spark, sf_dir):
    return all_orders(spark, sf_dir).select("order_id", "status")


@query(oracle(f"SELECT order_id, {', '.join(life.FLAGS)} FROM orders_all", "orders_all"))
def dq_flags(spark, sf_dir):
    return all_orders(spark, sf_dir).select("order_id", *life.FLAGS)


@query(oracle("SELECT order_id, status, duplicate_created_events_cnt FROM orders_dq WHERE dq", "orders_dq"))
def dq_any_filter(spark, sf_dir):
    return all_orders(spark, sf_dir).where(life.dq_any()).select("order_id", "status", "duplicate_created_events_cnt")


@query(oracle("SELECT p.order_id, p.payment_id, p.paid_amount, c.amount AS order_amount, p.paid_amount <> c.amount AS amount_differs, p.currency <> c.currency AS currency_differs, p.paid_at < c.created_at AS paid_before_creation FROM paid p JOIN first_created c ON p.order_id = c.order_id", "paid", "first_created"))
def join_payment_to_created(spark, sf_dir):
    created, paid, _ = raw_tables(spark, sf_dir)
    first = created.groupBy("order_id").agg(F.min(F.struct(F.col("created_at").alias("at"), *life.ORDER, "amount", "currency")).alias("c"))
    return paid.join(first, "order_id").select("order_id", "payment_id", "paid_amount", F.col("c.amount").alias("order_amount"), (F.col("paid_amount") != F.col("c.amount")).alias("amount_differs"), (F.col("currency") != F.col("c.currency")).alias("currency_differs"), (F.col("paid_at") < F.col("c.at")).alias("paid_before_creation"))


@query(oracle("SELECT order_id, raw_id, customer_id, amount, currency, created_at, source_channel FROM first_created", "first_created"))
def first_created_event(spark, sf_dir):
    created = raw_tables(spark, sf_dir)[0]
    # a rank alone, so that Spark keeps only each partition's first rows before the shuffle
    own = W.partitionBy("order_id").orderBy("created_at", *life.ORDER)
    return created.withColumn("rn", F.row_number().over(own)).where("rn = 1").select("order_id", "raw_id", "customer_id", "amount", "currency", "created_at", "source_channel")


def _latest(df: DataFrame, at: str) -> DataFrame:
    own = W.partitionBy("order_id").orderBy(*[F.col(c).desc() for c in (at, *life.ORDER)])
    return df.withColumn("rn", F.row_number().over(own)).where("rn = 1")


@query(oracle("SELECT order_id, raw_id, payment_id, paid_amount, currency, paid_at FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY paid_at DESC, raw_id DESC) AS rn FROM paid) WHERE rn = 1", "paid"))
def latest_payment(spark, sf_dir):
    return _latest(raw_tables(spark, sf_dir)[1], "paid_at").select("order_id", "raw_id", "payment_id", "paid_amount", "currency", "paid_at")


@query(oracle("SELECT order_id, raw_id, cancellation_id, cancellation_reason, cancelled_at FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY cancelled_at DESC, raw_id DESC) AS rn FROM cancelled) WHERE rn = 1", "cancelled"))
def latest_cancellation(spark, sf_dir):
    return _latest(raw_tables(spark, sf_dir)[2], "cancelled_at").select("order_id", "raw_id", "cancellation_id", "cancellation_reason", "cancelled_at")


@query(oracle("SELECT order_id, min(cancelled_at) AS first_cancelled_at FROM cancelled GROUP BY order_id", "cancelled"))
def first_cancellation(spark, sf_dir):
    return raw_tables(spark, sf_dir)[2].groupBy("order_id").agg(F.min("cancelled_at").alias("first_cancelled_at"))


@query(oracle("SELECT raw_id, order_id, count(*) OVER (PARTITION BY order_id) AS events_cnt, max(raw_id) OVER (PARTITION BY order_id) AS max_raw_id FROM created", "created"))
def window_event_counts(spark, sf_dir):
    own = W.partitionBy("order_id")
    return raw_tables(spark, sf_dir)[0].select("raw_id", "order_id", F.count("*").over(own).alias("events_cnt"), F.max("raw_id").over(own).alias("max_raw_id"))


@query(oracle("SELECT order_id, event_type, event_at, raw_id, kafka_load_dttm FROM lifecycle", "lifecycle"))
def union_lifecycle_events(spark, sf_dir):
    return life.union_events(*raw_tables(spark, sf_dir))


@query(oracle("SELECT * FROM orphan", "orphan"))
def orphan_events(spark, sf_dir):
    return life.orphans(*raw_tables(spark, sf_dir))


@query(oracle("SELECT DISTINCT order_id FROM lifecycle l WHERE event_type <> 'created' AND NOT EXISTS (SELECT 1 FROM created c WHERE c.order_id = l.order_id)", "lifecycle", "created"))
def orphan_not_exists(spark, sf_dir):
    created, paid, cancelled = raw_tables(spark, sf_dir)
    return paid.select("order_id").union(cancelled.select("order_id")).join(created.select("order_id"), "order_id", "left_anti").distinct()


@query(oracle("SELECT order_id, created_at::DATE AS order_dt FROM orders_all", "orders_all"))
def order_date_cast(spark, sf_dir):
    return all_orders(spark, sf_dir).select("order_id", F.col("created_at").cast("date").alias("order_dt"))


@query(oracle("SELECT * FROM mart", "mart"))
def mart_daily_orders(spark, sf_dir):
    return marts.daily_orders(all_orders(spark, sf_dir))


@query(oracle("SELECT created_at::DATE AS order_dt, currency, count(*)::INTEGER AS paid_orders_cnt, coalesce(sum(paid_amount), 0)::DECIMAL(14,2) AS paid_revenue FROM orders_all WHERE status = 'paid' GROUP BY 1, 2", "orders_all"))
def daily_revenue_by_currency(spark, sf_dir):
    return marts.revenue_by_currency(all_orders(spark, sf_dir))


_DATES = {"dates": ("SELECT unnest(generate_series(min(ts)::DATE - 2, max(ts)::DATE + 2, INTERVAL 1 DAY))::DATE AS order_dt FROM ev", ("ev",))}


@query(oracle("SELECT d.order_dt, count(o.order_id)::INTEGER AS created_orders_cnt, coalesce(sum(o.order_amount), 0)::DECIMAL(14,2) AS gross_order_amount FROM dates d LEFT JOIN orders_all o ON o.created_at::DATE = d.order_dt GROUP BY d.order_dt", "orders_all", **_DATES))
def mart_left_join_zero_dates(spark, sf_dir):
    span = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b"))
    dates = span.select(F.explode(F.sequence(F.date_sub("a", 2), F.date_add("b", 2))).alias("order_dt"))
    return marts.dates_with_zeros(all_orders(spark, sf_dir), dates)


@query(oracle("SELECT 'created' AS source, coalesce(max(raw_id), 0) AS last_raw_id FROM created UNION ALL SELECT 'paid', coalesce(max(raw_id), 0) FROM paid UNION ALL SELECT 'cancelled', coalesce(max(raw_id), 0) FROM cancelled", "created", "paid", "cancelled"))
def high_watermarks(spark, sf_dir):
    return inc.high_watermarks(dict(zip(("created", "paid", "cancelled"), raw_tables(spark, sf_dir), strict=True)))


@query(oracle("SELECT c.raw_id, c.order_id, c.created_at FROM created c, bounds WHERE raw_id > low AND raw_id <= high", "created", **_BOUNDS))
def incremental_slice(spark, sf_dir):
    sources = raw_tables(spark, sf_dir)
    low, high = _marks(sources)
    return inc.sliced(sources[0], low, high).select("raw_id", "order_id", "created_at")


@query(oracle("SELECT order_id FROM touched", **_TOUCHED))
def distinct_affected_orders(spark, sf_dir):
    sources = list(raw_tables(spark, sf_dir))
    return inc.affected_orders(sources, *_marks(sources))


def _recomputed(spark, sf_dir) -> DataFrame:
    sources = list(raw_tables(spark, sf_dir))
    return life.enrich(*sources, inc.affected_orders(sources, *_marks(sources)), life.tasks_for(*sources))


def _steps(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders of the last watermark, the recomputed ones, and the changes between them, each built once and written."""
    before, fresh = written(_before(spark, sf_dir), "orders-before"), written(_recomputed(spark, sf_dir), "orders-fresh")
    return before, fresh, written(inc.change_log(before, fresh, list(life.COLUMNS[1:])), "orders-changes")


@query(oracle(f"SELECT {', '.join('o.' + c for c in life.COLUMNS)} FROM orders_all o JOIN touched t ON o.order_id = t.order_id", "orders_all", **_TOUCHED))
def incremental_affected(spark, sf_dir):
    return _recomputed(spark, sf_dir)


def _before(spark, sf_dir) -> DataFrame:
    sources = raw_tables(spark, sf_dir)
    return life.enrich(*_upto(sources, _marks(sources)[0]), tasks=life.tasks_for(*sources))


@query(oracle(f"SELECT {_COLUMNS} FROM orders_all", "orders_all"))
def upsert_orders(spark, sf_dir):
    return inc.upsert(_before(spark, sf_dir), _recomputed(spark, sf_dir), ["order_id"]).select(*life.COLUMNS)


_CHANGED = _old("orders_all") | {
    "changes": ("SELECT n.order_id, CASE WHEN o.order_id IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS operation, o.created_at::DATE AS old_order_dt, n.created_at::DATE AS new_order_dt FROM orders_all n LEFT JOIN old_orders_all o ON n.order_id = o.order_id WHERE o.order_id IS NULL OR " + " OR ".join(f"n.{c} IS DISTINCT FROM o.{c}" for c in life.COLUMNS[1:]), ("orders_all", "old_orders_all")),
}


def _changes(spark, sf_dir) -> DataFrame:
    return inc.change_log(_before(spark, sf_dir), _recomputed(spark, sf_dir), list(life.COLUMNS[1:]))


@query(oracle("SELECT * FROM changes", **_CHANGED))
def change_log(spark, sf_dir):
    return _changes(spark, sf_dir)


@query(oracle("SELECT order_dt FROM (SELECT old_order_dt AS order_dt FROM changes UNION SELECT new_order_dt FROM changes) WHERE order_dt IS NOT NULL", **_CHANGED))
def affected_dates_union(spark, sf_dir):
    return inc.affected_dates(_changes(spark, sf_dir))


@query(oracle("SELECT m.* FROM mart m WHERE order_dt IN (SELECT old_order_dt FROM changes UNION SELECT new_order_dt FROM changes)", "mart", **_CHANGED))
def mart_affected_dates(spark, sf_dir):
    orders = all_orders(spark, sf_dir)
    dates = inc.affected_dates(_steps(spark, sf_dir)[2])
    return marts.daily_orders(orders.join(dates.select(F.col("order_dt").alias("dt")), F.col("created_at").cast("date") == F.col("dt"), "left_semi"))


@query(oracle("SELECT * FROM mart", "mart"))
def mart_after_move(spark, sf_dir):
    """The mart of the last watermark, refreshed on the changed dates only, equals the whole mart."""
    before, fresh, changes = _steps(spark, sf_dir)
    return marts.refresh_dates(marts.daily_orders(before), inc.upsert(before, fresh, ["order_id"]), inc.affected_dates(changes))


_HISTORY = _CHANGED | {
    "clock": ("SELECT (SELECT max(kafka_load_dttm) FROM lifecycle, bounds WHERE raw_id <= low) AS t0, (SELECT max(kafka_load_dttm) + INTERVAL 1 SECOND FROM lifecycle) AS t1", ("lifecycle", "bounds")),
}


@query(
    oracle(
        "SELECT o.order_id, o.status, o.created_at::DATE AS order_dt, t0 AS valid_from, CASE WHEN c.order_id IS NOT NULL THEN t1 END AS valid_to FROM old_orders_all o CROSS JOIN clock LEFT JOIN changes c ON o.order_id = c.order_id UNION ALL SELECT n.order_id, n.status, n.created_at::DATE, t1, NULL FROM orders_all n CROSS JOIN clock JOIN changes c ON n.order_id = c.order_id",
        **_HISTORY,
    )
)
def scd2_history(spark, sf_dir):
    """Two snapshots: the orders of the last watermark, then the changed ones."""
    sources = raw_tables(spark, sf_dir)
    low, _ = _marks(sources)
    events = life.union_events(*sources)
    # one row: the times of the two runs
    t0, t1 = events.agg(F.max(F.when(F.col("raw_id") <= low, F.col("kafka_load_dttm"))), F.max("kafka_load_dttm") + F.expr("INTERVAL 1 SECOND")).first()
    at = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    before, fresh, changes = _steps(spark, sf_dir)
    columns = ["order_id", "status", F.col("created_at").cast("date").alias("order_dt")]
    first = before.select(*columns, at(t0).alias("processed_dttm"))
    history = first.withColumn("valid_from", F.col("processed_dttm")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    now = inc.upsert(before, fresh, ["order_id"]).join(changes.select("order_id", F.lit(True).alias("changed")), "order_id", "left")
    current = now.select(*columns, F.when(F.col("changed"), at(t1)).otherwise(at(t0)).alias("processed_dttm"))
    return inc.snapshot(history, current, "order_id", "processed_dttm").drop("processed_dttm")


@query(oracle("SELECT source, max(last_raw_id) AS last_raw_id FROM (SELECT 'created' AS source, low AS last_raw_id FROM bounds UNION ALL SELECT 'paid', high FROM bounds UNION ALL SELECT 'created', coalesce(max(raw_id), 0) FROM created UNION ALL SELECT 'paid', coalesce(max(raw_id), 0) FROM paid UNION ALL SELECT 'cancelled', coalesce(max(raw_id), 0) FROM cancelled) GROUP BY source", "created", "paid", "cancelled", **_BOUNDS))
def watermark_merge(spark, sf_dir):
    sources = raw_tables(spark, sf_dir)
    low, high = _marks(sources)
    old = spark.createDataFrame([("created", low), ("paid", high)], "source string, last_raw_id long")
    return inc.merge_watermarks(old, inc.high_watermarks(dict(zip(("created", "paid", "cancelled"), sources, strict=True))))


@query(oracle("SELECT order_id, created_at, 1000 + row_number() OVER (ORDER BY created_at, order_id) AS change_id FROM orders_all", "orders_all"))
def assign_surrogate_ids(spark, sf_dir):
    return inc.surrogate_ids(all_orders(spark, sf_dir).select("order_id", "created_at"), ["created_at", "order_id"], 1000)


@query(oracle("SELECT 'full_vs_incremental' AS test, 0::BIGINT AS differences, count(*) AS rows_compared FROM orders_all", "orders_all"))
def parity_full_vs_incremental(spark, sf_dir):
    step = inc.upsert(_before(spark, sf_dir), _recomputed(spark, sf_dir), ["order_id"])
    sources = raw_tables(spark, sf_dir)
    tasks = life.tasks_for(*sources)
    return _parity("full_vs_incremental", life.enrich(*sources, tasks=tasks).select(*life.COLUMNS), step, "order_id", tasks)


@query(oracle("SELECT 'orphans_full_vs_incremental' AS test, 0::BIGINT AS differences, count(*) AS rows_compared FROM orphan", "orphan"))
def parity_orphans(spark, sf_dir):
    """Orphans of all events against those that an incremental step leaves: the old ones of untouched orders, and the touched
    orders' new ones."""
    sources = list(raw_tables(spark, sf_dir))
    low, high = _marks(sources)
    touched = inc.affected_orders(sources, low, high)
    kept = life.orphans(*_upto(sources, low)).join(touched, "order_id", "left_anti")
    step = kept.unionByName(life.orphans(*inc.restrict(sources, touched)))
    return _parity("orphans_full_vs_incremental", life.orphans(*sources), step)


@query(oracle("SELECT 'mart_full_vs_incremental' AS test, 0::BIGINT AS differences, count(*) AS rows_compared FROM mart", "mart"))
def parity_mart(spark, sf_dir):
    return _parity("mart_full_vs_incremental", marts.daily_orders(all_orders(spark, sf_dir)), mart_after_move(spark, sf_dir))


def _parity(name: str, full: DataFrame, step: DataFrame, key: str | None = None, tasks: int | None = None) -> DataFrame:
    """Rows of one side only, as often as that side has more of them, and rows of ``full``. The sides meet once, each computed once;
    with ``tasks`` equal rows meet where the key sends them, in so many tasks."""
    columns = full.columns
    both = full.withColumn("tidemark_side", F.lit(1)).unionByName(step.select(*columns).withColumn("tidemark_side", F.lit(-1)))
    if tasks:
        both = both.repartition(tasks, key)
    met = both.groupBy(*columns).agg(F.sum("tidemark_side").alias("more"), F.count_if(F.col("tidemark_side") == 1).alias("rows"))
    zero = F.lit(0).cast("long")
    found = met.agg(F.coalesce(F.sum(F.abs("more")), zero).alias("differences"), F.coalesce(F.sum("rows"), zero).alias("rows_compared"))
    return found.select(F.lit(name).alias("test"), "differences", "rows_compared")


@query(
    oracle(
        "SELECT DISTINCT order_dt FROM (SELECT o.created_at::DATE AS order_dt FROM old_orders_all o JOIN changes c ON o.order_id = c.order_id UNION ALL SELECT n.created_at::DATE FROM orders_all n JOIN changes c ON n.order_id = c.order_id) WHERE order_dt IS NOT NULL",
        **_HISTORY,
    )
)
def mart_dates_from_history(spark, sf_dir):
    """Dates that a mart as of the first snapshot must recompute, taken from the history's versions."""
    sources = raw_tables(spark, sf_dir)
    low, _ = _marks(sources)
    (t0,) = life.union_events(*sources).agg(F.max(F.when(F.col("raw_id") <= low, F.col("kafka_load_dttm")))).first()  # one row
    history = scd2_history(spark, sf_dir).withColumn("created_at", F.col("order_dt"))
    return marts.dates_of_history(history, t0)


def _secondary(spark, sf_dir) -> list[DataFrame]:
    """orders and line items as created orders, payments (not returned) and cancellations (returned)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    paid = lines.where("l_returnflag IN ('N', 'A')").groupBy("l_orderkey").agg(F.count("*").alias("payments_cnt"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(18,2)").alias("paid_amount"), F.max("l_shipdate").alias("paid_at"))
    gone = lines.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("cancellations_cnt"), F.min("l_shipdate").alias("first_cancelled_at"))
    return [orders, paid, gone]


@query(
    """WITH p AS (SELECT l_orderkey, count(*) AS payments_cnt, sum(l_extendedprice::DECIMAL(12,2))::DECIMAL(18,2) AS paid_amount, max(l_shipdate) AS paid_at FROM lineitem WHERE l_returnflag IN ('N', 'A') GROUP BY 1),
c AS (SELECT l_orderkey, count(*) AS cancellations_cnt, min(l_shipdate) AS first_cancelled_at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS order_key, CASE WHEN cancellations_cnt > 0 THEN 'cancelled' WHEN payments_cnt > 0 THEN 'paid' ELSE 'created' END AS status, coalesce(payments_cnt, 0)::INTEGER AS payments_cnt, coalesce(cancellations_cnt, 0)::INTEGER AS cancellations_cnt, paid_amount, coalesce(paid_at > first_cancelled_at, false) AS paid_after_cancellation
FROM orders o LEFT JOIN p ON o.o_orderkey = p.l_orderkey LEFT JOIN c ON o.o_orderkey = c.l_orderkey"""
)
def orders_from_lineitems(spark, sf_dir):
    """The lifecycle over the larger tables."""
    orders, paid, gone = _secondary(spark, sf_dir)
    both = orders.select("o_orderkey").join(paid, F.col("o_orderkey") == paid["l_orderkey"], "left").drop("l_orderkey").join(gone, F.col("o_orderkey") == gone["l_orderkey"], "left")
    return both.select(F.col("o_orderkey").alias("order_key"), life.order_status(F.col("cancellations_cnt"), F.col("payments_cnt")).alias("status"), F.coalesce("payments_cnt", F.lit(0)).cast("int").alias("payments_cnt"), F.coalesce("cancellations_cnt", F.lit(0)).cast("int").alias("cancellations_cnt"), "paid_amount", F.coalesce(F.col("paid_at") > F.col("first_cancelled_at"), F.lit(False)).alias("paid_after_cancellation"))



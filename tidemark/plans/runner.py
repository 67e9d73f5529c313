"""The analytics run: ordered steps over the tables of one catalog, audit rows, status lattice, command line.

A run takes the events of RAW since the last watermark, merges their facts into the kept facts of their orders, makes those
orders and orphans anew, logs the changes, extends the history, refreshes the mart on the dates of the changes and moves the
watermarks. All of it is one commit: a reader sees every table as before the run or as after it, and a run that fails
anywhere leaves nothing behind and is simply repeated. Only buckets of orders with new events are read and rewritten.
One run at a time holds the lock of the folder; that of a run that died is taken over once its time is up, and its audit row is
closed as an error. ``run_ts`` is one moment for all steps and must increase from run to run.
"""

from __future__ import annotations

import argparse
import json
import sys
import threading
import time
import urllib.request
import uuid
from collections import Counter
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.contracts import ORDER_CONTRACTS
from tidemark.operators import incremental as inc
from tidemark.operators import lifecycle as life
from tidemark.operators import mart as marts
from tidemark.operators import monitor, quality
from tidemark.sources.catalog import Catalog
from tidemark.sources.store import LOCK_SECONDS, KeyedTable, Lock, Locked
from tidemark.sources.tables import AppendTable, BucketTable, History
from tidemark.sources.work import scratch, written
from tidemark.streaming.ingest import Ingest

# fixed values: how a step's status counts
SUCCESSFUL, WARNED, FAILED = frozenset({"success", "pass"}), frozenset({"warn", "warning"}), frozenset({"error", "fail", "runtime error", "skipped"})
TAIL = 4000


@dataclass
class Outcome:
    """Counts of step statuses; ``available`` is False where nothing was reported."""

    available: bool = False
    total: int = 0
    successful: int = 0
    warned: int = 0
    failed: int = 0


def summarize(statuses: list[Any] | None) -> Outcome:
    """Counts of statuses; a status that is missing counts as unknown."""
    if statuses is None:
        return Outcome()
    seen = Counter(str(s if s is not None else "unknown").lower() for s in statuses)
    of = lambda names: sum(n for s, n in seen.items() if s in names)
    return Outcome(True, len(statuses), of(SUCCESSFUL), of(WARNED), of(FAILED))


def summarize_artifact(path: Path) -> Outcome:
    """Counts over ``results[].status`` of a JSON artifact."""
    try:
        return summarize([r.get("status") for r in json.loads(path.read_text(encoding="utf-8"))["results"]])
    except (OSError, ValueError, KeyError, AttributeError):
        return Outcome()


def overall_status(freshness: str, build: Outcome) -> str:
    """A failed or missing build is an error; staleness and warnings are a warning."""
    if not build.available or build.failed:
        return "error"
    return "warning" if build.warned or freshness in ("warn", "error") else "success"


def exit_code(status: str, fail_on_warning: bool = False) -> int:
    return 1 if status == "error" or fail_on_warning and status == "warning" else 0


def output_tail(text: str | None) -> str | None:
    return text[-TAIL:] if text else None


def notify(url: str | None, payload: dict[str, Any], timeout: float = 10.0) -> bool:
    """POST the payload; False where there is no address or the call fails."""
    if not url:
        return False
    try:
        request = urllib.request.Request(url, json.dumps(payload, default=str).encode(), {"Content-Type": "application/json"})
        urllib.request.urlopen(request, timeout=timeout).close()
        return True
    except OSError:
        return False


def _schema(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])


RUNS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("run_id", "trigger_type", "status")]
    + [T.StructField(n, T.TimestampType()) for n in ("started_at", "finished_at")]
    + [T.StructField("duration_seconds", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("freshness_status", "build_status", "summary", "error_message")]
)
WATERMARKS = T.StructType([T.StructField("source", T.StringType()), T.StructField("last_raw_id", T.LongType())])
CHANGES = T.StructType(
    [T.StructField("change_id", T.LongType()), T.StructField("run_at", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in ("order_id", "operation")]
    + [T.StructField(n, T.DateType()) for n in ("old_order_dt", "new_order_dt")]
)
SOURCES = {"order_created": "created", "order_paid": "paid", "order_cancelled": "cancelled"}
#: The watermark of the mart: the last change it has seen.
MART = "mart_daily_orders"


class Pipeline:
    """Tables under ``root``: those of Ingest, and order_facts, dds_orders, its change log (append-only), orphans, history, mart
    and watermarks in one catalog, and the audit of runs. ``snapshot`` (numbers of both catalogs) fixes what is read."""

    def __init__(self, spark: SparkSession, root: str, contracts=None, buckets: int = 16, snapshot: tuple[int, int] | None = None):
        self.spark, self.root, self.contracts, self.buckets = spark, root.rstrip("/"), contracts or ORDER_CONTRACTS, buckets
        self.ingest = Ingest(spark, self.contracts, f"{self.root}/raw", snapshot=snapshot and snapshot[0])
        self.catalog = Catalog(spark, self.root, snapshot and snapshot[1])
        raw = [spark.createDataFrame([], self.ingest.tables[n].schema) for n in SOURCES]
        known = life.facts(*raw)
        orders = life.finish(known).withColumn("processed_dttm", F.current_timestamp())
        history = orders.withColumn("valid_from", F.col("processed_dttm")).withColumn("valid_to", F.col("processed_dttm"))
        self.facts = self._table("order_facts", known, ["order_id"])
        self.orders = self._table("dds_orders", orders, ["order_id"])
        self.history = History(self.catalog, "dds_orders_history", _schema(history), "order_id", buckets)
        self.orphans = self._table("dq_orphan_order_events", life.unfounded(known), ["order_id"])
        self.mart = BucketTable(self.catalog, "mart_daily_orders", _schema(marts.daily_orders(orders)), ["order_dt"], 1)
        self.log = AppendTable(self.catalog, "dds_order_changes", CHANGES, ("change_id",))
        self.watermarks = BucketTable(self.catalog, "etl_watermarks", WATERMARKS, ["source"], 1)
        self.runs = KeyedTable(spark, f"{self.root}/analytics_run_history", RUNS, ["run_id"])

    def _table(self, name: str, df: DataFrame, key: list[str]) -> BucketTable:
        return BucketTable(self.catalog, name, _schema(df), key, self.buckets)

    def snapshot(self) -> Pipeline:
        """All tables as they are now, whatever is committed later."""
        return Pipeline(self.spark, self.root, self.contracts, self.buckets, (self.ingest.catalog.version(), self.catalog.version()))

    def _raw(self) -> list[DataFrame]:
        return [self.ingest.raw(n) for n in SOURCES]

    def changes(self) -> DataFrame:
        """The change log."""
        return self.log.read()

    def build(self, run_ts: datetime) -> dict[str, int]:
        """Bring the tables up to RAW, in one commit; counts of affected orders and dates."""
        raw = self.ingest.at(self.ingest.catalog.version())
        top = raw.watermarks()
        at = F.lit(run_ts.isoformat()).cast("timestamp")
        with scratch(self.spark), self.catalog.transaction():
            last = {r.source: r.last_raw_id for r in self.watermarks.read().collect()}  # a row a source
            bootstrap = not any(last.values())
            counts = {"affected_orders": 0, "changed_orders": 0, "affected_dates": 0}
            if any(top[n] > last.get(n, 0) for n in SOURCES):
                fresh = written(life.facts(*[raw.slice(n, last.get(n, 0), top[n]) for n in SOURCES]), "facts-new")
                # all tables of orders have the same buckets
                met = self.facts.touched(fresh)
                known = written(life.merge_facts(self.facts.read_for(fresh, met), fresh), "facts")
                counts["affected_orders"] = known.count()
                self.facts.merge(known, within=met)
                counts["changed_orders"] = self._step_orders(known, met, at)
                self.orphans.merge(life.unfounded(known), known, met)
            counts["affected_dates"] = self._step_mart(last.get(MART, 0), bootstrap)
            marks = [(n, top[n]) for n in SOURCES] + [(MART, self.log.greatest("change_id") or 0)]
            moved = [(n, k) for n, k in marks if k > last.get(n, 0)]
            if moved:
                self.watermarks.merge(self.spark.createDataFrame(moved, WATERMARKS))
        return counts

    def _step_orders(self, known: DataFrame, met: set[int], at) -> int:
        """Log the orders whose facts make something new of them, and bring orders and history up to it; how many."""
        made = life.finish(known)
        changes = inc.change_log(self.orders.read_for(known, met), made, list(life.COLUMNS[1:])).withColumn("run_at", at)
        changes = inc.surrogate_ids(changes, ["order_id"], self.log.greatest("change_id") or 0)
        logged = self.log.append(changes.select(*CHANGES.names))
        if logged:
            changed = written(made.join(changes.select("order_id"), "order_id", "left_semi").withColumn("processed_dttm", at), "changed")
            self.orders.merge(changed, within=met)
            self.history.advance(changed, "processed_dttm", met)
        return logged

    def _step_mart(self, seen: int, bootstrap: bool) -> int:
        """Refresh the mart on the dates of changes that it has not seen, or on all where it starts anew; how many."""
        if not bootstrap and (self.log.greatest("change_id") or 0) <= seen:
            return 0
        orders, mart = self.orders.read(), self.mart.read()
        known = mart.select("order_dt").union(orders.select(F.col("created_at").cast("date").alias("order_dt"))) if bootstrap else None
        dates = written(inc.affected_dates(self.log.read(change_id=(seen + 1, None)), known), "dates")
        day = F.col("created_at").cast("date")
        self.mart.merge(marts.daily_orders(orders.join(dates.select(F.col("order_dt").alias("dt")), day == F.col("dt"), "left_semi")), gone=dates)
        return dates.count()

    def reset_watermarks(self) -> None:
        """The next build recomputes everything, all dates of the mart too; facts are gathered again from the first event."""
        with self.catalog.transaction():
            self.watermarks.replace(self.watermarks.read().withColumn("last_raw_id", F.lit(0).cast("long")))
            self.facts.replace(self.spark.createDataFrame([], self.facts.schema))

    def rebuild(self, run_ts: datetime) -> dict[str, int]:
        """Derived tables anew from all of RAW; their history starts again. Readers see the old tables until the new ones are whole."""
        with self.catalog.transaction():
            for table in (self.facts, self.orders, self.history.open, self.orphans, self.mart, self.watermarks):
                table.replace(self.spark.createDataFrame([], table.schema))
            self.history.closed.clear()
            return self.build(run_ts)

    def tests(self) -> dict[str, int]:
        """Violations of each data test over the current tables."""
        orders, created = self.orders.read(), self._raw()[0]
        found = {
            "order_id_unique": quality.not_unique(orders, "order_id"),
            "order_id_not_null": quality.is_null(orders, "order_id"),
            "status_accepted": quality.not_accepted(orders, "status", ["created", "paid", "cancelled"]),
            "status_precedence": quality.status_violations(orders),
            "orphans_without_order": quality.orphans_with_order(self.orphans.read(), created),
            "mart_matches_orders": quality.mart_differs(self.mart.read(), orders),
        }
        return {n: df.count() for n, df in found.items()}

    def health(self, as_of: datetime) -> DataFrame:
        at = F.lit(as_of.isoformat()).cast("timestamp")
        return monitor.pipeline_health(self.runs.read(), self._raw()[0], self.ingest.dead_letters(), self.orders.read(), self.orphans.read(), at)

    def run(self, trigger: str = "manual", run_ts: datetime | None = None, webhook: str | None = None, lock_seconds: float = LOCK_SECONDS) -> str:
        """One audited run; its status. Raises Locked while another run is at work."""
        run_id = str(uuid.uuid4())
        with Lock(self.spark, f"{self.root}/RUN", run_id, lock_seconds):
            return self._run(run_id, trigger, run_ts or datetime.now(timezone.utc), webhook)

    def attempt(self, retries: int = 1, delay: float = 30.0, timeout: float | None = 600.0, **how) -> str:
        """run(), again after ``delay`` while it ends with an error and tries are left. Spark's jobs of a try are cancelled
        after ``timeout`` seconds, which makes the try an error."""
        context = self.spark.sparkContext
        for left in range(retries, -1, -1):
            group = f"run-{uuid.uuid4().hex}"
            context.setJobGroup(group, "analytics run", interruptOnCancel=True)
            timer = threading.Timer(timeout, context.cancelJobGroup, [group]) if timeout is not None else None
            try:
                if timer:
                    timer.start()
                status = self.run(**how)
            finally:
                if timer:
                    timer.cancel()
                context.setLocalProperty("spark.jobGroup.id", None)
            if status != "error" or not left:
                return status
            time.sleep(delay)
        return status

    def _close_dead_runs(self, at: datetime) -> None:
        """Under the lock no other run can be going: rows that say so are of runs that died."""
        dead = self.runs.read().where("status = 'running'")
        if not dead.isEmpty():
            closed = {"status": F.lit("error"), "build_status": F.lit("error"), "finished_at": F.lit(at.isoformat()).cast("timestamp"), "error_message": F.lit("The run ended without a result")}
            self.runs.upsert(dead.withColumns(closed).select(*RUNS.names))

    def _run(self, run_id: str, trigger: str, started: datetime, webhook: str | None) -> str:
        clock = time.monotonic()
        self._close_dead_runs(started)
        row = {"run_id": run_id, "trigger_type": trigger, "status": "running", "started_at": started, "finished_at": None, "duration_seconds": None, "freshness_status": None, "build_status": None, "summary": None, "error_message": None}
        self._audit(row)
        build, error, freshness, summary = Outcome(), None, "pass", {}
        try:
            freshness = monitor.freshness_of(self.ingest.loaded_at("order_created"), started)
            summary = self.build(started)
            failed = {n: k for n, k in self.tests().items()}
            build = summarize(["success", *("fail" if k else "pass" for k in failed.values())])
            summary |= {"tests": failed}
        except Exception as e:  # noqa: BLE001  recorded, and the run ends with an error
            error = f"{type(e).__name__}: {e}"
        status = "error" if error else overall_status(freshness, build)
        took = time.monotonic() - clock
        summary |= asdict(build)
        row |= {"status": status, "finished_at": datetime.fromtimestamp(started.timestamp() + took, timezone.utc), "duration_seconds": took, "freshness_status": freshness, "build_status": "error" if error or build.failed else "success", "summary": json.dumps(summary), "error_message": output_tail(error)}
        self._audit(row)
        if status != "success":
            notify(webhook, {"run_id": run_id, "status": status, "error": row["error_message"]})
        return status

    def _audit(self, row: dict[str, Any]) -> None:
        self.runs.upsert(self.spark.createDataFrame([tuple(row[n] for n in RUNS.names)], RUNS))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Run the order analytics over a table folder.")
    parser.add_argument("--root", required=True)
    parser.add_argument("--trigger", choices=["manual", "scheduled", "ci", "airflow"], default="manual")
    parser.add_argument("--interval-seconds", type=float, default=0)
    parser.add_argument("--fail-on-warning", action="store_true")
    parser.add_argument("--retries", type=int, default=1, help="tries after a run that ends with an error")
    parser.add_argument("--timeout-seconds", type=float, default=600)
    parser.add_argument("--alert-webhook-url")
    parser.add_argument("--health", action="store_true", help="print the health row; the exit code is 1 for critical, and for warning if asked")
    parser.add_argument("--history", action="store_true", help="print the 20 latest runs, newest first, one line of JSON each")
    args = parser.parse_args(argv)
    from tidemark.session import get_spark

    pipeline = Pipeline(get_spark(), args.root)
    if args.health:
        row = pipeline.health(datetime.now(timezone.utc)).first()
        print(json.dumps(row.asDict(), default=str))
        return int(row.health_code == 2 or args.fail_on_warning and row.health_code == 1)
    if args.history:
        for row in monitor.run_history(pipeline.runs.read()).collect():
            print(json.dumps(row.asDict(), default=str))
        return 0
    while True:
        try:
            code = exit_code(pipeline.attempt(args.retries, timeout=args.timeout_seconds, trigger=args.trigger, webhook=args.alert_webhook_url), args.fail_on_warning)
        except Locked as e:
            print(f"skipped: another run holds {e}", file=sys.stderr)
            code = 0
        if not args.interval_seconds:
            return code
        time.sleep(args.interval_seconds)


if __name__ == "__main__":
    sys.exit(main())

import json
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest

from tidemark.functions.contracts import ORDER_CONTRACTS, ContractError
from tidemark.plans import runner
from tidemark.plans.runner import Pipeline
from tidemark.sources.store import KeyedTable, Lock, Locked
from tidemark.streaming.ingest import MESSAGES, Ingest, file_stream

T0 = datetime(2026, 8, 3, tzinfo=timezone.utc)


def message(name, offset, version=1, **event):
    return (f"ecommerce.{name}.v{version}", 0, offset, bytearray(json.dumps(event).encode()))


def created(offset, order, amount, when, **more):
    return message("order_created", offset, 2, order_id=order, customer_id=more.pop("customer", "customer_1"), amount=amount, currency="RUB", created_at=when, **more)


def paid(offset, order, amount, when):
    return message("order_paid", offset, order_id=order, payment_id=f"p{offset}", paid_amount=amount, currency="RUB", paid_at=when)


def cancelled(offset, order, when):
    return message("order_cancelled", offset, order_id=order, cancellation_id=f"x{offset}", cancellation_reason="out_of_stock", cancelled_at=when)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), MESSAGES)


def test_incremental_scenario(spark, tmp_path):
    """A late creation moves an order to an earlier day."""
    p = Pipeline(spark, str(tmp_path))
    p.ingest.process(batch(spark, created(1, "o1", 1200.00, "2026-08-02T10:00:00Z", source_channel="web"), paid(1, "o1", 1200.00, "2026-08-02T11:00:00Z")), T0)
    assert p.run(run_ts=T0) == "success"
    (row,) = p.mart.read().collect()
    assert (str(row.order_dt), row.paid_orders_cnt, row.paid_revenue) == ("2026-08-02", 1, Decimal("1200.00"))
    health = p.health(T0 + timedelta(seconds=5)).first()
    assert (health.health_code, health.overall_health) == (0, "healthy")

    before = p.orders.read().first().processed_dttm
    assert p.run(run_ts=T0 + timedelta(minutes=1)) == "success"
    assert p.orders.read().first().processed_dttm == before and p.history.read().count() == 1

    late = T0 + timedelta(minutes=2)
    p.ingest.process(batch(spark, created(2, "o1", 1100.00, "2026-08-01T12:00:00Z", customer="customer_late_arrival"), cancelled(1, "o1", "2026-08-01T12:30:00Z")), late)
    assert p.run(run_ts=late) == "success"
    (order,) = p.orders.read().collect()
    assert (order.customer_id, order.order_amount, order.status, order.duplicate_created_events_cnt) == ("customer_late_arrival", Decimal("1100.00"), "cancelled", 1)
    assert order.dq_payment_after_cancellation_flg
    (row,) = p.mart.read().collect()
    assert (str(row.order_dt), row.created_orders_cnt, row.cancelled_orders_cnt, row.orders_with_dq_cnt) == ("2026-08-01", 1, 1, 1)
    assert p.history.read().count() == 2 and p.history.read().where("valid_to IS NULL").count() == 1

    p.reset_watermarks()
    assert p.run(run_ts=late + timedelta(minutes=1)) == "success"
    assert p.orders.read().count() == 1 and p.history.read().count() == 2


def test_routing_dedup_and_replay(spark, tmp_path):
    sink = Ingest(spark, ORDER_CONTRACTS, str(tmp_path))
    rows = [created(1, "o1", 10.5, "2026-08-01T10:00:00Z"), created(2, "o1", 1e20, "2026-08-01T10:00:00Z"), ("ecommerce.order_paid.v1", 0, 1, None), ("ecommerce.order_paid.v1", 0, 2, bytearray(b"\xffnot-json")), paid(3, "o1", 10.5, "2026-08-01T10:00:00+02:00")]
    sink.process(batch(spark, *rows, rows[0]), T0)
    sink.process(batch(spark, *rows), T0)  # replayed after a failure
    assert sink.raw("order_created").count() == 1 and sink.raw("order_paid").count() == 1
    dead = {(r.kafka_topic, r.kafka_offset): r for r in sink.dead_letters().collect()}
    assert len(dead) == 3 and dead["ecommerce.order_paid.v1", 1].raw_payload is None
    assert bytes(dead["ecommerce.order_paid.v1", 2].raw_payload) == b"\xffnot-json"
    sink.process(batch(spark, created(9, "o2", 1, "2026-08-01T10:00:00Z")), T0)
    assert sorted(r.raw_id for r in sink.raw("order_created").collect()) == [1, 2]
    with pytest.raises(Exception, match="No contract for topic"):
        sink.process(batch(spark, ("other", 0, 1, None)), T0)


def test_stream_equals_batch(spark, tmp_path):
    rows = [created(i, f"o{i % 3}", 10 + i, f"2026-08-0{1 + i % 3}T10:00:00Z") for i in range(1, 8)] + [("ecommerce.order_created.v2", 0, 99, bytearray(b"{"))]
    for i, row in enumerate(rows):
        batch(spark, row).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 4:
            _drain(spark, tmp_path)
    _drain(spark, tmp_path)
    _drain(spark, tmp_path)
    whole = Ingest(spark, ORDER_CONTRACTS, str(tmp_path / "batch"))
    whole.process(batch(spark, *rows), T0)
    stream = Ingest(spark, ORDER_CONTRACTS, str(tmp_path / "out"))
    columns = ["kafka_offset", "order_id", "amount", "created_at", "original_payload"]
    assert sorted(stream.raw("order_created").select(*columns).collect()) == sorted(whole.raw("order_created").select(*columns).collect())
    assert stream.dead_letters().count() == 1


def _drain(spark, tmp_path):
    query = Ingest(spark, ORDER_CONTRACTS, str(tmp_path / "out")).stream(file_stream(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert query.exception() is None


def test_keyed_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    t = KeyedTable(spark, str(tmp_path / "t"), df.schema, ["k"])
    assert t.read().isEmpty() and t.upsert(df) == 1
    assert t.upsert(df.selectExpr("k + 1 AS k", "'new' AS v")) == 2
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "new"), (3, "new")]
    assert t.read(1).count() == 2
    t.insert_new(df)
    assert t.read().count() == 3
    t.vacuum(1)
    assert t.read().count() == 3 and not (tmp_path / "t" / "v=1").exists()
    (tmp_path / "t" / "LOCK").write_text("")
    with pytest.raises(Locked):
        t.upsert(df)
    with pytest.raises(ValueError):
        t.replace(df.select("v"))


def test_run_statuses(tmp_path):
    got = runner.summarize(["success", "pass", "warn", "error", "skipped"])
    assert (got.available, got.total, got.successful, got.warned, got.failed) == (True, 5, 2, 1, 2)
    missing = runner.summarize_artifact(tmp_path / "none.json")
    assert not missing.available and runner.overall_status("pass", missing) == "error"
    assert runner.overall_status("error", runner.summarize(["pass"])) == "warning"
    assert (runner.exit_code("error"), runner.exit_code("warning"), runner.exit_code("warning", True), runner.exit_code("success")) == (1, 0, 1, 0)
    assert runner.notify("http://127.0.0.1:9/none", {}, 0.2) is False and len(runner.output_tail("x" * 9000)) == 4000


def test_attempts(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    done = iter(["error", "error", "success", "error"])
    p.run = lambda **how: next(done)
    assert p.attempt(2, 0, trigger="ci") == "success" and p.attempt(0, 0) == "error"

    def slow(**how):
        try:
            spark.range(0, 4, 1, 4).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L)").collect()
        except Exception as e:  # noqa: BLE001
            return "error" if "cancel" in str(e).lower() else "other"
        return "success"

    p.run = slow
    assert p.attempt(0, timeout=1) == "error"


def test_failed_build_is_audited(spark, tmp_path, capsys):
    p = Pipeline(spark, str(tmp_path))
    p.ingest.process(batch(spark, created(1, "o1", 5, "2026-08-01T10:00:00Z")), T0)
    p.build = lambda run_ts: (_ for _ in ()).throw(ContractError("broken"))
    assert p.run(run_ts=T0) == "error"
    (row,) = p.runs.read().collect()
    assert runner.main(["--root", str(tmp_path), "--history"]) == 0
    (told,) = capsys.readouterr().out.strip().splitlines()
    assert json.loads(told)["status"] == "error"
    assert row.status == "error" and "broken" in row.error_message and p.health(T0).first().health_reason == "Latest dbt build failed"


def business(p):
    """The derived tables without the moments they were made at."""
    drop = ("processed_dttm", "valid_from", "valid_to")
    return {n: sorted(repr(r) for r in getattr(p, n).read().drop(*drop).collect()) for n in ("orders", "history", "orphans", "mart")}


STEPS = ("facts", "log", "history.closed", "history.open", "mart", "watermarks")


def part_of(p, name):
    for n in name.split("."):
        p = getattr(p, n)
    return p


def test_a_run_that_fails_after_any_table_is_repeated(spark, tmp_path, monkeypatch):
    """Readers see all old or all new tables between any two steps, and the run that is repeated ends as if nothing had been."""
    first = [created(1, "o1", 10, "2026-08-01T10:00:00Z"), created(2, "o2", 20, "2026-08-02T10:00:00Z"), paid(1, "o1", 10, "2026-08-01T11:00:00Z"), paid(2, "lost", 5, "2026-08-01T11:00:00Z")]
    second = [created(3, "o1", 11, "2026-08-03T09:00:00Z"), created(4, "o2", 21, "2026-08-01T09:00:00Z"), cancelled(1, "o1", "2026-08-04T10:00:00Z"), created(5, "lost", 5, "2026-08-02T10:00:00Z")]
    want = None
    for chain in ((), STEPS):
        p = Pipeline(spark, str(tmp_path / str(len(chain))), buckets=3)
        p.ingest.process(batch(spark, *first), T0)
        assert p.run(run_ts=T0) == "success"
        old = business(p)
        p.ingest.process(batch(spark, *second), T0 + timedelta(minutes=10))
        put, before = type(p.catalog).put, p.catalog.version()
        for i, broken in enumerate(chain):

            def fail(catalog, name, state, broken=broken, p=p):  # the table is written and staged, then the run dies
                put(catalog, name, state)
                if name == part_of(p, broken).name:
                    assert business(Pipeline(spark, p.root, buckets=3)) == old
                    raise RuntimeError("lost")

            monkeypatch.setattr(type(p.catalog), "put", fail)
            assert p.run(run_ts=T0 + timedelta(minutes=11 + i)) == "error"
            monkeypatch.setattr(type(p.catalog), "put", put)
            assert business(p) == old and p.catalog.version() == before
        reader = p.snapshot()
        assert p.run(run_ts=T0 + timedelta(minutes=20)) == "success"
        assert business(reader) == old and p.catalog.version() == before + 1
        with pytest.raises(ValueError, match="no writes"):
            reader.reset_watermarks()
        got = business(p)
        assert len(got["orders"]) == 3 and got["orphans"] == []
        want = want or got
        assert got == want


def test_reset_refreshes_the_whole_mart(spark, tmp_path):
    from pyspark.sql import functions as F

    p = Pipeline(spark, str(tmp_path))
    p.ingest.process(batch(spark, created(1, "o1", 5, "2026-08-01T10:00:00Z")), T0)
    p.run(run_ts=T0)
    good = p.mart.read().collect()
    p.mart.replace(p.mart.read().withColumn("created_orders_cnt", F.lit(9)))
    p.reset_watermarks()
    p.run(run_ts=T0 + timedelta(minutes=1))
    assert p.mart.read().collect() == good


def test_locks_of_dead_runs(spark, tmp_path, capsys):
    import os

    p = Pipeline(spark, str(tmp_path))
    p.ingest.process(batch(spark, created(1, "o1", 5, "2026-08-01T10:00:00Z")), T0)
    with Lock(spark, f"{p.root}/RUN", "other", 3600):
        with pytest.raises(Locked):
            p.run(run_ts=T0)
    p._audit({n: None for n in runner.RUNS.names} | {"run_id": "dead", "status": "running", "started_at": T0})
    stale = Lock(spark, f"{p.root}/RUN", "dead", -1)
    assert stale._create()
    table = tmp_path / "mart_daily_orders" / "LOCK"
    table.parent.mkdir(exist_ok=True)
    table.write_text("")
    os.utime(table, (1, 1))
    assert p.run(run_ts=T0) == "success"
    assert not (tmp_path / "RUN").exists()
    assert {r.run_id == "dead": r.status for r in p.runs.read().collect()} == {True: "error", False: "success"}


def test_bounded_consumption(spark, tmp_path):
    sink = Ingest(spark, ORDER_CONTRACTS, str(tmp_path / "out"))
    batch(spark, created(1, "o1", 5, "2026-08-01T10:00:00Z")).write.parquet(str(tmp_path / "in"))
    stream = lambda: file_stream(spark, str(tmp_path / "in"))
    assert sink.consume(stream(), str(tmp_path / "c"), once=True, timeout=60) == 1
    assert sink.consume(stream(), str(tmp_path / "c"), idle_timeout=1.5) == 0
    assert sink.consume(stream(), str(tmp_path / "c"), once=True, timeout=1.5) == 0
    assert sink.raw("order_created").count() == 1


def test_views_show_no_payload(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.operators import monitor

    p = Pipeline(spark, str(tmp_path))
    shown = {"health": p.health(T0), "dead": monitor.recent(p.ingest.dead_letters(), [F.desc("id")], 5), "raw": p.ingest.raw("order_created")}
    found = {(r.relation, r.column_name): (r.data_type, r.exposes_payload) for r in monitor.relation_columns(spark, shown).collect()}
    assert {n for (n, _), (_, hidden) in found.items() if hidden} == {"raw"}
    assert found["health", "latest_error_message"] == ("string", False) and found["health", "latest_duration_seconds"][0] == "double"

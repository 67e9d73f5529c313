"""Catalog, bucket tables, appended tables with statistics and ledger, history, mergeable facts."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import incremental as inc
from tidemark.operators import lifecycle as life
from tidemark.sources import tables, work
from tidemark.sources.adapters import raw_tables
from tidemark.sources.catalog import Catalog, Conflict
from tidemark.sources.tables import AppendTable, BucketTable, History, join_spans
from tidemark.sources.work import scratch, written

SF = "/root/testdata/sf0.001"
ROWS = "topic string, part int, at long, id long, v string"
WHERE = ("topic", "part", "at")


def files(root) -> dict[str, int]:
    return {str(p.relative_to(root)): p.stat().st_size for p in Path(root).rglob("*.parquet")}


def numbers(spark, n, v="a"):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit(v), F.col("id").cast("string")).alias("v"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_writes_only_the_buckets_it_touches(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    rows = numbers(spark, 20_000)
    t = BucketTable(catalog, "t", rows.schema, ["k"], 32)
    t.replace(rows)
    before = files(tmp_path)
    assert len(before) == 32
    one = rows.where(t.bucket() == 7)
    some = one.limit(one.count() // 3).withColumn("v", F.lit("new"))
    t.merge(some)
    fresh = {p: n for p, n in files(tmp_path).items() if p not in before}
    assert [p.split("/")[2] for p in fresh] == ["tidemark_bucket=7"]
    assert sum(fresh.values()) < 2 * sum(before.values()) / 32
    assert {k: before[k] for k in before} == {k: n for k, n in files(tmp_path).items() if k in before}
    assert t.read().count() == 20_000 and t.read().where("v = 'new'").count() == some.count()
    assert t.read({7}).count() == one.count() and len(t.read({7}).inputFiles()) == 1
    assert len(t.read_for(some).inputFiles()) == 1


def test_merge_is_one_shuffle(spark, tmp_path, monkeypatch):
    t = BucketTable(Catalog(spark, str(tmp_path)), "t", numbers(spark, 1).schema, ["k"], 4)
    t.replace(numbers(spark, 100))
    plans = []
    put = BucketTable._put
    monkeypatch.setattr(BucketTable, "_put", lambda self, rows, buckets: plans.append(plan(rows)) or put(self, rows, buckets))
    t.merge(numbers(spark, 50, "b"), gone=numbers(spark, 60).select("k"))
    assert plans[0].count("Exchange") == 1
    assert {r.k: r.v for r in t.read().collect()} == {k: f"{'b' if k < 50 else 'a'}{k}" for k in range(100) if k < 50 or k >= 60}
    t.resize(9)
    assert t.state()["buckets"] == 9 and t.read().count() == 90
    t.merge(numbers(spark, 200, "c"))
    assert t.read().count() == 200 and t.read().where("v LIKE 'c%'").count() == 200
    with pytest.raises(ValueError, match="schema"):
        t.merge(numbers(spark, 1).select("v"))


def test_random_merges(spark, tmp_path):
    rng, want = random.Random(3), {}
    t = BucketTable(Catalog(spark, str(tmp_path)), "t", spark.createDataFrame([], "k string, v long").schema, ["k"], 3)
    for i in range(5):
        new = {rng.choice([None, "", "é", *map(str, range(12))]): i * 100 + j for j in range(rng.randrange(8))}
        gone = {rng.choice(list(map(str, range(12)))) for _ in range(rng.randrange(3))}
        t.merge(spark.createDataFrame(list(new.items()), "k string, v long"), spark.createDataFrame([(k,) for k in gone], "k string"))
        want = {k: v for k, v in want.items() if k not in gone} | new
        assert {r.k: r.v for r in t.read().collect()} == want


def test_transactions(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    a, b = (BucketTable(catalog, n, numbers(spark, 1).schema, ["k"], 2) for n in "ab")
    with catalog.transaction():
        a.replace(numbers(spark, 3))
        assert a.read().count() == 3 and Catalog(spark, str(tmp_path)).tables() == {}
        b.replace(numbers(spark, 4))
    assert catalog.version() == 1 and b.read().count() == 4
    old = catalog.snapshot()
    with pytest.raises(RuntimeError, match="stop"), catalog.transaction():
        a.replace(numbers(spark, 9))
        raise RuntimeError("stop")
    assert a.read().count() == 3 and catalog.version() == 1
    other = Catalog(spark, str(tmp_path))
    with pytest.raises(Conflict), catalog.transaction():
        a.merge(numbers(spark, 5))
        BucketTable(other, "b", b.schema, ["k"]).replace(numbers(spark, 1))
    assert (a.read().count(), b.read().count()) == (3, 1)
    assert (a.at(old).read().count(), b.at(old).read().count()) == (3, 4)
    with catalog.transaction():
        pass
    assert catalog.version() == 2


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    t, log = BucketTable(catalog, "t", numbers(spark, 1).schema, ["k"], 2), AppendTable(catalog, "log", numbers(spark, 1).schema, ("k",))
    for i in range(4):
        t.replace(numbers(spark, 10 + i))
        log.append(numbers(spark, 5))
    folders = len(list((tmp_path / "t").iterdir()))
    assert catalog.vacuum(2) == [] and len(catalog.versions()) == 2
    gone = catalog.vacuum(1, older_s=-1)
    assert gone and len(list((tmp_path / "t").iterdir())) == folders - len([g for g in gone if g.startswith("t/")]) == 1
    assert t.read().count() == 13 and log.read().count() == 20 and log.rows() == 20


def test_slices_open_only_their_files(spark, tmp_path):
    """A table of 1,000 files: a slice of one file opens one, watermarks open none."""
    catalog = Catalog(spark, str(tmp_path))
    t = AppendTable(catalog, "t", spark.createDataFrame([], "id long, at timestamp, v string").schema, ("id", "at"))
    start = datetime(2026, 8, 1)
    rows = lambda a, b, n: spark.range(a, b, 1, n).select("id", F.timestamp_seconds(F.lit(start.timestamp()) + F.col("id")).alias("at"), F.lit("x").alias("v"))
    with catalog.transaction():
        t.append(rows(0, 9970, 997))
        for i in range(3):
            t.append(rows(9970 + 10 * i, 9980 + 10 * i, 1))
    assert len(t.files()) == 1000
    assert (t.rows(), t.greatest("id")) == (10_000, 9999)
    part = t.read(id=(5001, 5009))
    assert len(part.inputFiles()) == 1 and sorted(r.id for r in part.collect()) == list(range(5001, 5010))
    assert len(t.read(id=(9965, 9985)).inputFiles()) == 3
    assert t.read(id=(10_000, None)).inputFiles() == [] and len(t.read(id=(None, 4)).inputFiles()) == 1
    micros = int((start + timedelta(seconds=9995)).timestamp() * 1e6)
    late = t.read(at=(micros, None))
    assert len(late.inputFiles()) == 1 and late.count() == 5
    assert t.append(rows(0, 0, 1)) == 0 and t.rows() == 10_000


def test_spans_cover(spark):
    rng = random.Random(4)
    for _ in range(300):
        spans = [[a, a + rng.randrange(4)] for a in (rng.randrange(100) for _ in range(rng.randrange(12)))]
        got = join_spans([list(s) for s in spans], 3)
        assert len(got) <= 3 and got == sorted(got) and all(x[1] < y[0] for x, y in zip(got, got[1:], strict=False))
        assert all(any(a <= s[0] and s[1] <= b for a, b in got) for s in spans)
    assert join_spans([[1, 3], [4, 6], [9, 9]]) == [[1, 6], [9, 9]]


def test_new_offsets_read_nothing(spark, tmp_path):
    t = AppendTable(Catalog(spark, str(tmp_path)), "t", spark.createDataFrame([], ROWS).schema, ("id", "at"), WHERE)
    rows = lambda *at, part=0: spark.createDataFrame([("x", part, a, a, "v") for a in at], ROWS)
    assert t.append(t.unseen(rows(1, 2, 2, 5))) == 3
    # other partitions may have the same offsets
    for fresh in (rows(6, 7, 8), rows(1, 2, part=1)):
        found = t.unseen(fresh)
        assert "FileScan" not in plan(found) and found.count() == fresh.count()
        t.append(found)
    assert t.state()["ledger"] == {"0 x": [[1, 2], [5, 8]], "1 x": [[1, 2]]} or t.state()["ledger"]["0 x"] == [[1, 8]]
    again = t.unseen(rows(1, 2, 3, 5, 6, 9))
    assert "FileScan" in plan(again) and sorted(r.at for r in again.collect()) == [3, 9]
    assert t.append(t.unseen(rows(1, 2, 5, 6, 7, 8))) == 0 and t.rows() == 8


def test_ledger_of_random_batches(spark, tmp_path):
    rng, seen = random.Random(8), set()
    t = AppendTable(Catalog(spark, str(tmp_path)), "t", spark.createDataFrame([], ROWS).schema, ("id", "at"), WHERE)
    for _ in range(6):
        batch = [(f"t{rng.randrange(2)}", rng.randrange(2), rng.randrange(60)) for _ in range(rng.randrange(1, 25))]
        found = t.unseen(spark.createDataFrame([(*c, c[2], "v") for c in batch], ROWS)).cache()
        assert sorted((r.topic, r.part, r.at) for r in found.collect()) == sorted(set(batch) - seen)
        t.append(found)
        seen |= set(batch)
    assert t.rows() == len(seen) and all(len(s) <= tables.MOST_SPANS for s in t.state()["ledger"].values())


def test_history_equals_snapshots(spark, tmp_path):
    """Closing and opening changed keys gives what a comparison with all current rows gives."""
    fields = "k string, v long, at timestamp, valid_from timestamp, valid_to timestamp"
    schema = spark.createDataFrame([], fields).schema
    history = History(Catalog(spark, str(tmp_path)), "h", schema, "k", 3)
    rng, current, plain = random.Random(2), {}, spark.createDataFrame([], schema)
    for i in range(4):
        at = datetime(2026, 8, 1 + i)
        changed = {f"k{rng.randrange(8)}": (i, at) for _ in range(3)}
        current |= changed
        frame = lambda rows: spark.createDataFrame([(k, v, t) for k, (v, t) in rows.items()], "k string, v long, at timestamp")
        with scratch(spark):
            history.advance(written(frame(changed), "changed"), "at")
        history.advance(frame(changed), "at")  # a second time it finds nothing to do
        plain = spark.createDataFrame(inc.snapshot(plain, frame(current), "k", "at").collect(), schema)
        assert sorted(map(repr, history.read().collect())) == sorted(map(repr, plain.select(*schema.names).collect()))
    moment = datetime(2026, 8, 2, 12)
    want = plain.where((F.col("valid_from") <= F.lit(moment)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(moment))))
    assert sorted(map(repr, history.as_of(int(moment.timestamp() * 1e6)).collect())) == sorted(map(repr, want.collect()))


def test_facts_of_any_batches(spark):
    """Facts of shuffled parts, merged in any order, make the orders and orphans of all events."""
    sources = [s.where("user_id IS NULL OR raw_id % 3 > 0") if "user_id" in s.columns else s for s in raw_tables(spark, SF)]
    want = sorted(map(repr, life.enrich(*sources).select(*life.COLUMNS).collect()))
    lost = sorted(map(repr, life.orphans(*sources).collect()))
    for seed in (1, 2):
        dealt = [F.pmod(F.xxhash64("raw_id", F.lit(seed)), F.lit(3)) == k for k in range(3)]
        parts = [life.facts(*[s.where(d) for s in sources]) for d in dealt]
        merged = life.merge_facts(parts[seed], life.merge_facts(parts[0], parts[3 - seed]))
        assert sorted(map(repr, life.finish(merged).select(*life.COLUMNS).collect())) == want
        assert sorted(map(repr, life.unfounded(merged).collect())) == lost


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(work, "work_folder", lambda spark, name: f"{tmp_path}/{name}")
    with scratch(spark):
        assert written(spark.range(3), "x").count() == 3 and len(list(tmp_path.iterdir())) == 1
    assert list(tmp_path.iterdir()) == []


def test_lists_of_files_stay_few(spark, tmp_path, monkeypatch):
    """Lists are put together, files are not touched, and slices still find theirs."""
    monkeypatch.setattr(tables, "MOST_SEGMENTS", 4)
    catalog = Catalog(spark, str(tmp_path))
    t = AppendTable(catalog, "t", spark.range(1).schema, ("id",))
    with catalog.transaction():
        for i in range(9):
            t.append(spark.range(10 * i, 10 * i + 10, 1, 1))
    assert len(t.state()["segments"]) <= 4 and len(t.files()) == 9 and t.rows() == t.read().count() == 90
    assert t.read(id=(41, 42)).inputFiles() == [f for f in t.read().inputFiles() if t.spark.read.parquet(f).first().id == 40]
    assert catalog.vacuum(1, older_s=-1) and t.read().count() == 90

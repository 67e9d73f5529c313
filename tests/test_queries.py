"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    found = db.execute(catalog.ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted(repr(tuple(r[c] for c in order)) for r in rows)
    theirs = sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in found.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_operators(tmp_path):
    """With the operators' folders gone, with or without the pipeline's file, the entry offers the engine's queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    asked = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    for name in (None, "corpus_pipeline.py"):
        if name and (root / name).exists():
            shutil.copy(root / name, tmp_path)
        done = subprocess.run([sys.executable, "-c", asked], cwd=tmp_path, capture_output=True, text=True)
        assert done.returncode == 0 and int(done.stdout) == len(catalog.QUERIES), done.stderr[-500:]


def test_plans_shuffle_once(spark):
    """The lifecycle needs one exchange, and incremental bounds reach the scan."""
    plan = catalog.QUERIES["orders_enriched"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    scan = catalog.QUERIES["incremental_slice"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id" in scan

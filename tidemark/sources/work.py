"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as written once: whatever reads it sees the same rows, and lost executors cost no recomputation."""
    path = work_folder(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What written() makes inside is deleted at the end."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

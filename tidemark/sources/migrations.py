"""Ordered, checksummed migrations of a table folder.

A migration is (version, name, SQL or callable). What has run is recorded with the checksum of its text; a change of a
recorded migration, or a version below the last recorded one that has not run, stops everything.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tidemark.sources.store import KeyedTable

APPLIED = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("checksum", T.StringType()), T.StructField("applied_at", T.TimestampType())])


class MigrationError(RuntimeError):
    """The recorded and the given migrations do not fit."""


def checksum(step: str | Callable) -> str:
    text = step if isinstance(step, str) else inspect.getsource(step)
    return hashlib.sha256(text.encode()).hexdigest()


def migrate(spark: SparkSession, root: str, steps: list[tuple[int, str, str | Callable[[SparkSession], None]]]) -> list[int]:
    """Run what has not run, in order; the versions that ran now. Each is recorded as soon as it is done."""
    versions = [v for v, *_ in steps]
    if sorted(set(versions)) != versions:
        raise MigrationError("versions must increase")
    table = KeyedTable(spark, f"{root.rstrip('/')}/schema_migrations", APPLIED, ["version"])
    done = {r.version: r for r in table.read().collect()}
    ran = []
    for version, name, step in steps:
        if version in done:
            if (done[version].name, done[version].checksum) != (name, checksum(step)):
                raise MigrationError(f"migration {version} has changed since it was applied")
            continue
        if done and version < max(done):
            raise MigrationError(f"migration {version} comes before the applied {max(done)}")
        if isinstance(step, str):
            for statement in filter(str.strip, step.split(";")):
                spark.sql(statement)
        else:
            step(spark)
        table.upsert(spark.createDataFrame([(version, name, checksum(step), datetime.now(timezone.utc))], APPLIED))
        ran.append(version)
    return ran

"""Keyed tables over Parquet: each version is a folder of its own, and a small pointer file names the current one.

A reader resolves the pointer once and never sees a half-written version. A writer takes the table's lock (an
exclusively created file that states its owner and until when it holds), writes the next version, then replaces the
pointer. A lock beyond its time, left by a process that died, is taken over. All file access goes through Hadoop's file
systems, so tables may lie wherever Spark reads.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.operators.incremental import upsert


class Locked(RuntimeError):
    """Another writer is at work."""


#: Seconds that a lock holds.
LOCK_SECONDS = 3600


class Lock:
    """A file that one owner at a time can create; used as a context."""

    def __init__(self, spark: SparkSession, path: str, owner: str = "", seconds: float = LOCK_SECONDS):
        self.path, self.seconds = path, seconds
        self.owner = owner or uuid.uuid4().hex
        self._file = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._made = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._file.getFileSystem(spark._jsc.hadoopConfiguration())

    def _create(self) -> bool:
        try:
            stream = self._system.create(self._file, False)
        except Py4JJavaError:
            if self._system.exists(self._file):
                return False
            raise
        stream.write(bytearray(json.dumps({"owner": self.owner, "until": time.time() + self.seconds}).encode()))
        stream.close()
        return True

    def _held(self) -> dict:
        """What the file states; a file without a statement holds from when it was made."""
        made = self._system.getFileStatus(self._file).getModificationTime() / 1000
        stream = self._system.open(self._file)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return {"owner": "", "until": made + self.seconds}
        finally:
            stream.close()

    def __enter__(self) -> Lock:
        self.stale = False
        if not self._create():
            try:
                self.stale = self._held()["until"] < time.time()
                # of several that find a stale lock only one can rename it
                if self.stale:
                    aside = self._made(f"{self.path}-{uuid.uuid4().hex}")
                    self.stale = self._system.rename(self._file, aside) and self._system.delete(aside, False)
            except Py4JJavaError:  # it went away meanwhile
                self.stale = False
            if not (self.stale and self._create()):
                raise Locked(self.path)
        return self

    def __exit__(self, *_) -> None:
        # a lock that another has taken over is not ours to release
        if self._system.exists(self._file) and self._held()["owner"] == self.owner:
            self._system.delete(self._file, False)


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str]):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The current version; 0 before the first."""
        system, path = self._at("CURRENT")
        if not system.exists(path):
            return 0
        stream = system.open(path)
        try:
            return int(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def replace(self, df: DataFrame) -> int:
        """Make ``df`` the table. Its columns must be the table's."""
        if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in self.schema]:
            raise ValueError(f"schema of {self.path} is {self.schema.simpleString()}, not {df.schema.simpleString()}")
        with Lock(self.spark, f"{self.path}/LOCK"):
            version = self.version() + 1
            df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
            system, temporary = self._at(f".CURRENT-{uuid.uuid4().hex}")
            stream = system.create(temporary, True)
            stream.write(bytearray(str(version).encode()))
            stream.close()
            current = self._at("CURRENT")[1]
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.spark._jsc.hadoopConfiguration())
            options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            context.rename(temporary, current, options)
            return version

    def upsert(self, new: DataFrame) -> int:
        return self.replace(upsert(self.read(), new, self.key).select(*self.schema.names))

    def insert_new(self, new: DataFrame) -> int:
        """Add the rows whose key is not there yet."""
        fresh = new.dropDuplicates(self.key).join(self.read().select(*self.key), self.key, "left_anti")
        return self.replace(self.read().unionByName(fresh.select(*self.schema.names)))

    def vacuum(self, keep: int = 2) -> None:
        """Delete versions older than the last ``keep``."""
        for v in range(1, self.version() - keep + 1):
            system, path = self._at(f"v={v}")
            system.delete(path, True)


def wait_for(ready, seconds: float = 30.0, every: float = 1.0) -> None:
    """Call ``ready`` until it returns or the time is up; its last error is raised."""
    end = time.monotonic() + seconds
    while True:
        try:
            return ready()
        except Exception:
            if time.monotonic() + every > end:
                raise
            time.sleep(every)

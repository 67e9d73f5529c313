"""Hourly volumes kept by increments: a batch or micro-batch adds its counts to the hours it has events of, however late.

Counts are sums, so the counts of parts add up to those of the whole. A stream hands each micro-batch over with its number; the
number is committed with the counts, so a batch that comes again after a failure changes nothing. Events behind the watermark (the latest
event of earlier batches less ``late``) go to a table of late counts first, so that a report of closed hours can be
repeated; ``correct`` adds them to the hours and ``read(True)`` shows hours with the late counts that are still outside.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.catalog import Catalog
from tidemark.sources.tables import AppendTable, BucketTable
from tidemark.sources.work import scratch, written

KEY = ["event_hour", "event_type"]
HOURS = T.StructType([T.StructField("event_hour", T.TimestampNTZType()), T.StructField("event_type", T.StringType()), T.StructField("events_cnt", T.LongType())])
LATE = T.StructType([T.StructField("batch", T.LongType()), *HOURS.fields])
MARKS = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.LongType())])


def hourly(rows: DataFrame, at: str = "kafka_load_dttm", kind: str = "event_type") -> DataFrame:
    """Counts by hour and type."""
    return rows.groupBy(F.date_trunc("hour", at).cast("timestamp_ntz").alias("event_hour"), F.col(kind).alias("event_type")).agg(F.count("*").alias("events_cnt"))


def summed(*parts: DataFrame) -> DataFrame:
    one = parts[0]
    for p in parts[1:]:
        one = one.unionByName(p)
    return one.groupBy(*KEY).agg(F.sum("events_cnt").alias("events_cnt"))


class HourlyVolume:
    def __init__(self, catalog: Catalog, name: str = "event_volume_hourly", late: timedelta = timedelta(hours=1), buckets: int = 4):
        self.catalog, self.late_s = catalog, int(late.total_seconds())
        self.hours = BucketTable(catalog, name, HOURS, KEY, buckets)
        self.late = AppendTable(catalog, f"{name}_late", LATE, ("batch",))
        self.marks = BucketTable(catalog, f"{name}_marks", MARKS, ["name"], 1)

    def _marks(self) -> dict[str, int]:
        """batch: the last one added; latest: the latest event (seconds); corrected: the last batch whose late counts are in."""
        return {r["name"]: r["value"] for r in self.marks.read().collect()}  # three rows

    def _move(self, **marks: int) -> None:
        self.marks.merge(self.catalog.spark.createDataFrame(sorted(marks.items()), MARKS))

    def _add(self, counts: DataFrame) -> None:
        self.hours.merge(summed(self.hours.read_for(counts), counts))

    def add(self, rows: DataFrame, batch: int, at: str = "kafka_load_dttm", kind: str = "event_type") -> bool:
        """Add the events of a batch; False if it has been added before. Batches come with growing numbers."""
        with scratch(self.catalog.spark), self.catalog.transaction():
            marks = self._marks()
            if batch <= marks.get("batch", -1):
                return False
            counts = written(hourly(rows, at, kind), "hours")
            latest = rows.agg(F.max(F.unix_seconds(F.col(at).cast("timestamp")))).first()[0]
            closed = F.lit(False)
            if "latest" in marks:  # hours that ended before the watermark are closed
                closed = F.unix_seconds(F.col("event_hour").cast("timestamp")) + 3600 <= marks["latest"] - self.late_s
            self._add(counts.where(~closed))
            self.late.append(counts.where(closed).select(F.lit(batch).cast("long").alias("batch"), *HOURS.names))
            self._move(batch=batch, latest=max(latest or 0, marks.get("latest", 0)))
        return True

    def correct(self) -> int:
        """Add the late counts that are still outside to their hours; how many events they are."""
        with scratch(self.catalog.spark), self.catalog.transaction():
            marks = self._marks()
            outside = self.late.read(batch=(marks.get("corrected", -1) + 1, None)).drop("batch")
            events = outside.agg(F.coalesce(F.sum("events_cnt"), F.lit(0))).first()[0]
            if events:
                self._add(written(summed(outside), "late"))
            if "batch" in marks:
                self._move(corrected=marks["batch"])
        return events

    def read(self, with_late: bool = False) -> DataFrame:
        """event_hour, event_type, events_cnt."""
        if not with_late:
            return self.hours.read()
        return summed(self.hours.read(), self.late.read(batch=(self._marks().get("corrected", -1) + 1, None)).drop("batch"))

    def stream(self, source: DataFrame, checkpoint: str, at: str = "kafka_load_dttm", kind: str = "event_type"):
        """Start a query that adds the micro-batches of a streaming ``source`` and then ends (available now)."""
        writer = source.writeStream.foreachBatch(lambda df, number: self.add(df, number, at, kind)).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

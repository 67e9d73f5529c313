"""Tables of a catalog: keyed rows in buckets that are rewritten one by one, rows that are only appended, and history."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.sources.catalog import Catalog

BUCKET, RANK = "tidemark_bucket", "tidemark_rank"


def _same(df: DataFrame, schema: T.StructType, name: str) -> None:
    """Names and types must agree; whether values may be null does not count, within structs neither."""
    if df.schema.simpleString() != schema.simpleString():
        raise ValueError(f"schema of {name} is {schema.simpleString()}, not {df.schema.simpleString()}")


class BucketTable:
    """Rows of unique key, dealt to buckets by a hash of it. The state names one folder a bucket; a write makes new folders
    for the buckets it touches and leaves the others' alone."""

    def __init__(self, catalog: Catalog, name: str, schema: T.StructType, key: list[str], buckets: int = 16):
        self.catalog, self.name, self.schema, self.key, self._buckets = catalog, name, schema, key, buckets
        self.spark = catalog.spark

    def at(self, catalog: Catalog) -> BucketTable:
        """The same table in another catalog, such as a snapshot."""
        return BucketTable(catalog, self.name, self.schema, self.key, self._buckets)

    def state(self) -> dict:
        return self.catalog.state(self.name) or {"buckets": self._buckets, "parts": {}}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.state()["buckets"])).cast("int")

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets only."""
        parts = self.state()["parts"]
        paths = [parts[b] for b in sorted(parts) if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.catalog.root}/{p}" for p in paths])

    def touched(self, keys: DataFrame) -> set[int]:
        """The buckets of some keys: one row a bucket is collected."""
        return {r[0] for r in keys.select(self.bucket()).distinct().collect()}

    def read_for(self, keys: DataFrame, within: set[int] | None = None) -> DataFrame:
        """The rows with these keys; other buckets are not opened. ``within``: their buckets, where they are known."""
        return self.read(self.touched(keys) if within is None else within).join(keys.select(*self.key), self.key, "left_semi")

    def replace(self, df: DataFrame) -> None:
        """Make ``df`` the table."""
        _same(df, self.schema, self.name)
        self._put(df.withColumn(BUCKET, self.bucket()).repartition(F.col(BUCKET)), range(self.state()["buckets"]))

    def merge(self, new: DataFrame, gone: DataFrame | None = None, within: set[int] | None = None) -> None:
        """``new`` over the rows of its keys, the keys of ``gone`` out (unless new has them). Of rows of ``new`` with one key
        any one stays. Old, new and gone rows meet by bucket in one shuffle, and each bucket becomes one file. ``within``: the buckets of
        all these keys, where they are known."""
        _same(new, self.schema, self.name)
        parts = [new.withColumn(RANK, F.lit(2))]
        if gone is not None:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.key]
            parts.append(gone.select(*self.key, *empty).select(*self.schema.names).withColumn(RANK, F.lit(1)))
        touched = self.touched(reduce(DataFrame.unionByName, [p.select(*self.key) for p in parts])) if within is None else within
        if not touched:
            return
        parts.append(self.read(touched).withColumn(RANK, F.lit(0)))
        rows = reduce(DataFrame.unionByName, parts).withColumn(BUCKET, self.bucket()).repartition(F.col(BUCKET))
        best = W.partitionBy(BUCKET, *self.key).orderBy(F.desc(RANK))
        kept = rows.withColumn("tidemark_place", F.row_number().over(best)).where(f"tidemark_place = 1 AND {RANK} <> 1")
        self._put(kept.select(*self.schema.names, BUCKET), touched)

    def upsert(self, new: DataFrame) -> None:
        self.merge(new)

    def resize(self, buckets: int) -> None:
        """Deal all rows anew."""
        rows = self.read()
        n = F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")
        parts = self._written(rows.withColumn(BUCKET, n).repartition(F.col(BUCKET)))
        self.catalog.put(self.name, {"buckets": buckets, "parts": parts})

    def _written(self, rows: DataFrame) -> dict[str, str]:
        folder = f"{self.name}/{uuid.uuid4().hex}"
        rows.write.partitionBy(BUCKET).parquet(f"{self.catalog.root}/{folder}")
        names = self.catalog.files.names(f"{self.catalog.root}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def _put(self, rows: DataFrame, buckets: Iterable[int]) -> None:
        """Rows with BUCKET, dealt by it, take the place of these buckets."""
        state, parts = self.state(), self._written(rows)
        kept = {b: p for b, p in state["parts"].items() if int(b) not in set(buckets)}
        self.catalog.put(self.name, state | {"parts": kept | parts})


def _number(name: str, kind: T.DataType) -> Column:
    """A tracked column as a whole number, times in microseconds."""
    return F.unix_micros(F.col(name).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(name).cast("long")


#: Lists of files up to which each append keeps its own; beyond, the shortest are put into one.
MOST_SEGMENTS = 64
#: Intervals of offsets that the ledger keeps for a partition of a topic; beyond, the nearest are joined.
MOST_SPANS = 8


def join_spans(spans: list[list[int]], most: int = MOST_SPANS) -> list[list[int]]:
    """Sorted intervals without overlap that cover the given ones; the smallest gaps are closed where they are too many."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    while len(out) > most:
        k = min(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
        out[k - 1 : k + 1] = [[out[k - 1][0], out[k][1]]]
    return out


class AppendTable:
    """Rows that are only appended. For each file its rows and the least and greatest value of the ``tracked`` columns are kept, in
    lists beside the data whose totals stand in the state, so that watermarks need no scan and a slice opens only the files
    it may be in. With ``coordinates`` (topic, partition, offset) a ledger keeps the intervals of offsets that the table covers."""

    def __init__(self, catalog: Catalog, name: str, schema: T.StructType, tracked: tuple[str, ...] = (), coordinates: tuple[str, str, str] | None = None):
        self.catalog, self.name, self.schema, self.tracked, self.coordinates = catalog, name, schema, tracked, coordinates
        self.spark = catalog.spark

    def at(self, catalog: Catalog) -> AppendTable:
        return AppendTable(catalog, self.name, self.schema, self.tracked, self.coordinates)

    def state(self) -> dict:
        return self.catalog.state(self.name) or {"segments": [], "ledger": {}}

    def append(self, df: DataFrame) -> int:
        """Add rows; how many."""
        _same(df, self.schema, self.name)
        folder = f"{self.name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.catalog.root}/{folder}")
        files, spans = self._described(folder)
        if not files:
            self.catalog.files.delete(f"{self.catalog.root}/{folder}")
            return 0
        state = self.state()
        segments, ledger = [*state["segments"], self._listed(files, [folder])], dict(state["ledger"])
        for key, found in spans.items():
            ledger[key] = join_spans([*ledger.get(key, []), *found])
        self.catalog.put(self.name, {"segments": self._shortened(segments), "ledger": ledger})
        return sum(f["rows"] for f in files)

    def clear(self) -> None:
        """Name no rows and no offsets any more."""
        self.catalog.put(self.name, {"segments": [], "ledger": {}})

    def _described(self, folder: str) -> tuple[list[dict], dict[str, list[list[int]]]]:
        """The files of a folder, and the offsets of each partition of a topic; only the tracked columns are read."""
        kinds = {f.name: f.dataType for f in self.schema}
        needed = [f for f in self.schema if f.name in {*self.tracked, *(self.coordinates or ())}]
        bounds = [g(_number(c, kinds[c])).alias(f"{kind}_{c}") for c in self.tracked for kind, g in (("low", F.min), ("high", F.max))]
        topic, partition, offset = self.coordinates or (None,) * 3
        by, span = [F.col("_metadata.file_path").alias("path")], []
        if offset:
            by.append(F.concat_ws(" ", F.col(partition).cast("string"), topic).alias("key"))
            span = [F.min(offset).alias("from"), F.max(offset).alias("to")]
        rows = self.spark.read.schema(T.StructType(needed)).parquet(f"{self.catalog.root}/{folder}")
        files: dict[str, dict] = {}
        spans: dict[str, list[list[int]]] = {}
        for r in rows.groupBy(*by).agg(F.count("*").alias("rows"), *bounds, *span).collect():  # a row for each file and partition of a topic
            name = f"{folder}/{r['path'].rsplit('/', 1)[1]}"
            f = files.setdefault(name, {"path": name, "rows": 0, "low": {}, "high": {}})
            f["rows"] += r["rows"]
            for c in self.tracked:
                for kind, g in (("low", min), ("high", max)):
                    found = [x for x in (f[kind].get(c), r[f"{kind}_{c}"]) if x is not None]
                    f[kind][c] = g(found) if found else None
            if offset:
                spans.setdefault(r["key"], []).append([r["from"], r["to"]])
        # a folder's interval of a partition: what its files cover together
        return sorted(files.values(), key=lambda f: f["path"]), {k: [[min(s[0] for s in v), max(s[1] for s in v)]] for k, v in spans.items()}

    def _listed(self, files: list[dict], folders: list[str]) -> dict:
        """Write a list of files; its totals."""
        path = f"{self.name}/{uuid.uuid4().hex}.json"
        self.catalog.files.write(f"{self.catalog.root}/{path}", json.dumps(files))
        total: dict[str, Any] = {"list": path, "folders": [*folders, path], "rows": sum(f["rows"] for f in files), "files": len(files), "low": {}, "high": {}}
        for c in self.tracked:
            for kind, g in (("low", min), ("high", max)):
                found = [f[kind][c] for f in files if f[kind][c] is not None]
                total[kind][c] = g(found) if found else None
        return total

    def _shortened(self, segments: list[dict]) -> list[dict]:
        """At most MOST_SEGMENTS lists: the lists with fewest files are put into one. Data files stay as they are."""
        if len(segments) <= MOST_SEGMENTS:
            return segments
        order = sorted(range(len(segments)), key=lambda i: (segments[i]["files"], i))
        few = set(order[: MOST_SEGMENTS // 2 + 1])
        files = [f for i in sorted(few) for f in self._list(segments[i])]
        one = self._listed(files, sorted({f["path"].rsplit("/", 1)[0] for f in files}))
        return [s for i, s in enumerate(segments) if i not in few] + [one]

    def _list(self, segment: dict) -> list[dict]:
        return json.loads(self.catalog.files.read(f"{self.catalog.root}/{segment['list']}"))

    def files(self, **between: tuple[int | None, int | None]) -> list[str]:
        """Paths of the files that may have rows with each named tracked column within (least, greatest), None being open."""

        def meets(x: dict) -> bool:
            return all(x["low"][c] is not None and (high is None or x["low"][c] <= high) and (low is None or x["high"][c] >= low) for c, (low, high) in between.items())

        return [f["path"] for s in self.state()["segments"] if meets(s) for f in self._list(s) if meets(f)]

    def read(self, **between: tuple[int | None, int | None]) -> DataFrame:
        """All rows, or those with tracked columns within bounds (times in microseconds): only files that may have such are named."""
        paths = self.files(**between)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.catalog.root}/{p}" for p in paths])
        kinds = {f.name: f.dataType for f in self.schema}
        for c, bounds in between.items():
            value = lambda x, c=c: F.timestamp_micros(F.lit(x)).cast(kinds[c]) if isinstance(kinds[c], (T.TimestampType, T.TimestampNTZType)) else F.lit(x)
            low, high = bounds
            rows = rows.where(F.col(c) >= value(low)) if low is not None else rows
            rows = rows.where(F.col(c) <= value(high)) if high is not None else rows
        return rows

    def rows(self) -> int:
        return sum(s["rows"] for s in self.state()["segments"])

    def greatest(self, column: str) -> int | None:
        """The greatest value of a tracked column, from the totals alone."""
        return max((s["high"][column] for s in self.state()["segments"] if s["high"][column] is not None), default=None)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """One row for each coordinate that the table does not have. Offsets outside the ledger's intervals are new as they are; only
        where a batch overlaps one, the files that may have the doubtful offsets are read."""
        topic, partition, offset = self.coordinates
        ledger = self.state()["ledger"]
        spans = rows.groupBy(topic, partition).agg(F.min(offset), F.max(offset)).collect() if ledger else []  # one row a partition of a topic
        doubt = [(t, p, max(low, a), min(high, b)) for t, p, low, high in spans for a, b in ledger.get(f"{p} {t}", ()) if low <= b and a <= high]
        fresh = rows.dropDuplicates(list(self.coordinates))
        if not doubt:
            return fresh
        low, high = min(d[2] for d in doubt), max(d[3] for d in doubt)
        near = self.read(**{offset: (low, high)})
        one_of = reduce(lambda x, y: x | y, [(F.col(topic) == t) & (F.col(partition) == p) & F.col(offset).between(a, b) for t, p, a, b in doubt]) if len(doubt) <= 64 else F.lit(True)
        return fresh.join(near.where(one_of).select(*self.coordinates), list(self.coordinates), "left_anti").select(*rows.columns)


class History:
    """Slowly changing history in two parts: open versions by key, in buckets, and closed ones, which are only appended."""

    def __init__(self, catalog: Catalog, name: str, schema: T.StructType, key: str, buckets: int = 16):
        self.key, self.schema = key, schema
        self.open = BucketTable(catalog, f"{name}_open", schema, [key], buckets)
        self.closed = AppendTable(catalog, f"{name}_closed", schema, ("valid_from", "valid_to"))

    def read(self) -> DataFrame:
        return self.closed.read().unionByName(self.open.read())

    def as_of(self, micros: int) -> DataFrame:
        """The versions that were current at a moment: of the closed part, only files that reach it."""
        moment = F.timestamp_micros(F.lit(micros)).cast(self.schema["valid_from"].dataType)
        opened = self.open.read().where(F.col("valid_from") <= moment)
        return opened.unionByName(self.closed.read(valid_from=(None, micros), valid_to=(micros + 1, None)))

    def advance(self, changed: DataFrame, updated_at: str, within: set[int] | None = None) -> None:
        """Close the open versions of the changed keys and open new ones from ``updated_at`` on. A key whose open version is as
        late keeps it. Only buckets of changed keys are rewritten."""
        kind = self.schema["valid_to"].dataType
        within = self.open.touched(changed) if within is None else within
        live = self.open.read_for(changed, within)
        later = changed.select(self.key, F.col(updated_at).alias("tidemark_at"))
        closing = live.join(later, self.key).where(F.col("tidemark_at") > F.col(updated_at)).withColumn("valid_to", F.col("tidemark_at").cast(kind)).select(*self.schema.names)
        known = live.select(self.key, F.col(updated_at).alias("tidemark_at"))
        opening = changed.join(known, self.key, "left").where(F.col("tidemark_at").isNull() | (F.col("tidemark_at") < F.col(updated_at)))
        opening = opening.withColumn("valid_from", F.col(updated_at)).withColumn("valid_to", F.lit(None).cast(kind)).select(*self.schema.names)
        self.closed.append(closing)
        self.open.merge(opening, within=within)

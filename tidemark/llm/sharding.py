"""Resharding by minimum-cost flow: documents in files of old shards move to new capacities with the fewest bytes moved.

1. ``lay_out`` writes documents as shard folders; a ``Layout`` names each shard's files with their bytes and rows.
2. ``transfers`` solves the flow: a byte that stays costs nothing, one that moves within a zone 1, one that moves between zones 2.
   The network has an edge for each shard and zone (movers meet in hubs), so thousands of shards are small work for the driver.
3. ``planned`` turns the flow into files: whole files stay or move; those that no quota takes whole are split among quotas.
4. ``reshard`` rewrites only files that move or are split (a task deals the documents of one split file, the largest
   first, to the quota with most room) and leaves the others where they are. Texts are not shuffled, but for split files.
5. ``read`` gives all documents with shard and slot: a file's first slot plus the row's place in the file.

Size of a document: UTF-8 bytes of its text (null: none) plus 1. New shards are within a few small documents of their capacity, as the
last documents of a split file to be dealt are its smallest.

Defined results: an empty table has empty shards; null ids, null texts and repeated rows are rows like others; a document of
any length stays whole; extra columns, of any name but those that begin with ``tidemark_``, are kept. Capacities
below the bytes there are raise a ValueError. The driver holds one entry a file, and joins send it out in parts of
``FILES_AT_ONCE`` files.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import table, work_dir

SHARD, SIZE, PATH, ROW = "tidemark_shard", "tidemark_size", "tidemark_path", "tidemark_row"
#: Files whose new shards are broadcast together (some 200 bytes each).
FILES_AT_ONCE = 50_000


class Part(NamedTuple):
    path: str
    size: int
    rows: int


class Layout(NamedTuple):
    schema: T.StructType  # columns of the documents
    shards: list[list[Part]]

    def sizes(self) -> list[int]:
        return [sum(p.size for p in parts) for parts in self.shards]


def min_cost_flow(nodes: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost >= 0) of a greatest flow that costs least: shortest distances by reduced
    costs, then as much flow as the edges on shortest paths carry, until the sink is out of reach."""
    to, room, cost, out = [], [], [], [[] for _ in range(nodes)]
    for u, v, capacity, price in edges:
        for a, b, c, p in ((u, v, capacity, price), (v, u, 0, -price)):
            out[a].append(len(to))
            to.append(b)
            room.append(c)
            cost.append(p)
    height = [0] * nodes
    while True:
        far = [None] * nodes
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if far[u] is None:
                far[u] = d
                for e in out[u]:
                    if room[e] and far[to[e]] is None:
                        heapq.heappush(heap, (d + cost[e] + height[u] - height[to[e]], to[e]))
        if far[sink] is None:
            return [room[2 * k + 1] for k in range(len(edges))]
        height = [h + (far[sink] if d is None else min(d, far[sink])) for h, d in zip(height, far, strict=True)]
        while _saturate(nodes, to, room, cost, out, height, source, sink):
            pass


def _saturate(nodes, to, room, cost, out, height, source, sink) -> int:
    """A blocking flow on the edges without reduced cost; how much it carries."""
    free = lambda e, u: room[e] and cost[e] + height[u] == height[to[e]]
    level, line = [None] * nodes, [source]
    level[source] = 0
    for u in line:
        for e in out[u]:
            if level[to[e]] is None and free(e, u):
                level[to[e]] = level[u] + 1
                line.append(to[e])
    if level[sink] is None:
        return 0
    carried, at, path = 0, [0] * nodes, []
    u = source
    while True:
        if u == sink:
            most = min(room[e] for e in path)
            for e in path:
                room[e] -= most
                room[e ^ 1] += most
            carried += most
            keep = next(i for i, e in enumerate(path) if not room[e])
            u = to[path[keep] ^ 1]
            del path[keep:]
        while at[u] < len(out[u]):
            e = out[u][at[u]]
            if level[to[e]] == level[u] + 1 and free(e, u):
                path.append(e)
                u = to[e]
                break
            at[u] += 1
        else:
            if not path:
                return carried
            u = to[path.pop() ^ 1]
            at[u] += 1


def transfers(sizes: list[int], capacities: list[int], old_zones: list[int] | None = None, new_zones: list[int] | None = None) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, (i, i) being those that stay. Shards of one number are the same place."""
    if sum(capacities) < sum(sizes):
        raise ValueError(f"{sum(sizes)} bytes do not fit into {sum(capacities)}")
    n, m = len(sizes), len(capacities)
    old_zones, new_zones = old_zones or [0] * n, new_zones or [0] * m
    zones = sorted({*old_zones, *new_zones})
    place = {z: k for k, z in enumerate(zones)}
    leave, enter = (lambda z: n + m + place[z]), (lambda z: n + m + len(zones) + place[z])
    between = n + m + 2 * len(zones)
    source, sink, free = between + 1, between + 2, sum(sizes)
    edges = [(source, i, s, 0) for i, s in enumerate(sizes)]
    stay = range(len(edges), len(edges) + min(n, m))
    edges += [(i, n + i, free, 0) for i in range(min(n, m))]
    go = range(len(edges), len(edges) + n)
    edges += [(i, leave(z), free, 0) for i, z in enumerate(old_zones)]
    come = range(len(edges), len(edges) + m)
    edges += [(enter(z), n + j, free, 0) for j, z in enumerate(new_zones)]
    within = range(len(edges), len(edges) + len(zones))
    edges += [(leave(z), enter(z), free, 1) for z in zones]
    edges += [(leave(z), between, free, 2) for z in zones] + [(between, enter(z), free, 0) for z in zones]
    edges += [(n + j, sink, c, 0) for j, c in enumerate(capacities)]
    flow = min_cost_flow(sink + 1, edges, source, sink)
    found = defaultdict(int, {(i, i): flow[e] for i, e in enumerate(stay) if flow[e]})
    given, taken = [flow[e] for e in go], [flow[e] for e in come]
    # those who leave meet those who arrive: first in their own zone as far as the flow says, then anyone
    for z, most in [(z, flow[e]) for z, e in zip(zones, within, strict=True)] + [(None, free)]:
        givers = [i for i in range(n) if given[i] and z in (None, old_zones[i])]
        takers = [j for j in range(m) if taken[j] and z in (None, new_zones[j])]
        while most and givers and takers:
            i, j = givers[-1], takers[-1]
            b = min(most, given[i], taken[j])
            found[i, j] += b
            most, given[i], taken[j] = most - b, given[i] - b, taken[j] - b
            if not given[i]:
                givers.pop()
            if not taken[j]:
                takers.pop()
    return dict(found)


class Plan(NamedTuple):
    stay: list[list[Part]]  # files that each new shard keeps where they are
    move: dict[str, int]  # new shard of files that move whole
    split: dict[str, dict[int, int]]  # bytes that each new shard gets of a file


def planned(shards: list[list[Part]], flow: dict[tuple[int, int], int], count: int) -> Plan:
    """Files by the flow: the largest first, to its own shard while there is room, else to the shard with most room."""
    quotas: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), b in flow.items():
        quotas[i][j] = b
    plan = Plan([[] for _ in range(count)], {}, {})
    for i, parts in enumerate(shards):
        room, rest = quotas[i], []
        for part in sorted(parts, key=lambda p: (-p.size, p.path)):
            j = i if room.get(i, 0) >= part.size else max(room, key=lambda j: (room[j], -j))
            if room[j] < part.size:
                rest.append(part)
                continue
            room[j] -= part.size
            if j == i:
                plan.stay[i].append(part)
            else:
                plan.move[part.path] = j
        left = [[j, b] for j, b in sorted(room.items()) if b]
        for part in rest:
            need, plan.split[part.path] = part.size, {}
            while need:
                b = min(need, left[-1][1])
                plan.split[part.path][left[-1][0]] = b
                need -= b
                left[-1][1] -= b
                if not left[-1][1]:
                    left.pop()
    return plan


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _written(df: DataFrame, schema: T.StructType, count: int) -> list[list[Part]]:
    """Write documents with SHARD and SIZE as folders of shards; the files of each."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, "shards")
    df.write.partitionBy(SHARD).parquet(path)
    small = spark.read.schema(T.StructType([T.StructField(SIZE, T.LongType()), T.StructField(SHARD, T.IntegerType())])).parquet(path)
    shards: list[list[Part]] = [[] for _ in range(count)]
    for r in small.groupBy(SHARD, F.col("_metadata.file_path").alias(PATH)).agg(F.sum(SIZE).alias("size"), F.count("*").alias("rows")).collect():  # one row a file
        shards[r[SHARD]].append(Part(r[PATH], r["size"], r["rows"]))
    return [sorted(parts) for parts in shards]


def lay_out(docs: DataFrame, shard: Column, count: int) -> Layout:
    """Write documents into ``count`` shards; ``shard`` is the number of a document's shard."""
    return Layout(docs.schema, _written(docs.withColumn(SIZE, size_of(F.col("text"))).withColumn(SHARD, shard.cast("int")), docs.schema, count))


def _files(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    """The documents of some files with SIZE, and the file and place of each."""
    whole = T.StructType([*schema.fields, T.StructField(SIZE, T.LongType())])
    if not paths:
        return spark.createDataFrame([], T.StructType([*whole.fields, T.StructField(PATH, T.StringType()), T.StructField(ROW, T.LongType())]))
    return spark.read.schema(whole).parquet(*paths).select("*", F.col("_metadata.file_path").alias(PATH), F.col("_metadata.row_index").alias(ROW))


def _joined(spark: SparkSession, schema: T.StructType, rows: list[tuple], fields: str) -> list[DataFrame]:
    """The files that rows (path, ...) name, with the other fields: FILES_AT_ONCE of them in each table."""
    out = []
    for k in range(0, len(rows), FILES_AT_ONCE):
        some = rows[k : k + FILES_AT_ONCE]
        out.append(_files(spark, schema, [r[0] for r in some]).join(F.broadcast(spark.createDataFrame(some, f"{PATH} string, {fields}")), PATH))
    return out


def _dealt(quotas: dict[str, dict[int, int]]):
    """Deals the documents of a split file, the largest first, to the shard with most room left."""

    def deal(key, rows):
        path = key[0].as_py()
        room = [(-b, j) for j, b in quotas[path].items()]
        heapq.heapify(room)
        rows = rows.sort_by([(SIZE, "descending"), (ROW, "ascending")])
        shard = []
        for size in rows.column(SIZE).to_pylist():
            left, j = room[0]
            shard.append(j)
            heapq.heapreplace(room, (left + size, j))
        return pa.table({PATH: pa.array([path] * len(shard), pa.string()), ROW: rows.column(ROW), SHARD: pa.array(shard, pa.int32())})

    return deal


def reshard(spark: SparkSession, old: Layout, capacities: list[int], **zones) -> Layout:
    """The layout with the new capacities; files that do not change shard are those of the old layout."""
    count = len(capacities)
    plan = planned(old.shards, transfers(old.sizes(), capacities, **zones), count)
    names = [*old.schema.names, SIZE, SHARD]
    changed = [df.select(*names) for df in _joined(spark, old.schema, sorted(plan.move.items()), f"{SHARD} int")]
    if plan.split:
        cut = _files(spark, old.schema, sorted(plan.split))
        dealt = cut.select(PATH, ROW, SIZE).groupBy(PATH).applyInArrow(_dealt(plan.split), f"{PATH} string, {ROW} long, {SHARD} int")
        changed.append(cut.join(dealt, [PATH, ROW]).select(*names))
    fresh = _written(reduce(DataFrame.unionAll, changed), old.schema, count) if changed else [[] for _ in range(count)]
    return Layout(old.schema, [sorted([*a, *b]) for a, b in zip(plan.stay, fresh, strict=True)])


def drop_superseded(spark: SparkSession, old: Layout, new: Layout) -> int:
    """Delete the old layout's files that the new one does not name; how many."""
    gone = {p.path for parts in old.shards for p in parts} - {p.path for parts in new.shards for p in parts}
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)
    return len(gone)


def read(spark: SparkSession, layout: Layout) -> DataFrame:
    """All documents with SIZE, and ``tidemark_shard`` and ``tidemark_slot`` (gapless from 0 in each shard)."""
    rows = []
    for j, parts in enumerate(layout.shards):
        first = 0
        for p in parts:
            rows.append((p.path, j, first))
            first += p.rows
    found = _joined(spark, layout.schema, rows, f"{SHARD} int, tidemark_first long") or [_files(spark, layout.schema, []).selectExpr("*", f"0 AS {SHARD}", "0L AS tidemark_first")]
    return reduce(DataFrame.unionAll, [df.withColumn("tidemark_slot", F.col("tidemark_first") + F.col(ROW)).select(*layout.schema.names, SIZE, SHARD, "tidemark_slot") for df in found])


def even(total: int, count: int) -> list[int]:
    """Capacities that differ by a byte at most."""
    return [total // count + (j < total % count) for j in range(count)]


def op13_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in five shards by source, which differ much in size; they move to eight of equal bytes."""
    docs = table(spark, sf_dir, "documents")
    old = lay_out(docs, F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(5)), 5)
    new = reshard(spark, old, even(sum(old.sizes()), 8))
    drop_superseded(spark, old, new)
    text = F.coalesce(F.col("text"), F.lit(""))
    return read(spark, new).select("doc_id", F.col(SIZE).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), F.col(SHARD).alias("shard"), F.col("tidemark_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: No SQL: the flow decides; tests/llm holds it against all flows of small networks, and the layout against its capacities.
QUERIES = {"op13_resharding": op13_resharding}

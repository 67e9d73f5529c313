"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash of the id. Each shard builds a graph: points enter in growing
batches, a greedy beam search over the graph so far proposes neighbours, and a point keeps a proposal only if no kept
neighbour is nearer to it by the factor alpha, so edges stay diverse; back edges are pruned alike. Each shard then measures
itself: a sample of its vectors is searched with wider and wider beams until the recall against brute force is ``RECALL``.
Vectors without any structure need a beam of a large part of the shard; it is searched through the graph all the same. Graphs
are files in the shared folder. Queries go in blocks to every shard, where a beam search finds candidates; those are scored in
double precision on the original vectors, and the best of all shards are returned. A shard is searched by ``SPLITS`` tasks
at most, each of which loads it once and takes its blocks one after another.

Largest inner product becomes nearest by Euclid once a shard's vectors get one more component that makes them equally
long. Equal vectors of a shard are one point with their ids in order, so no number of copies hides any.

Defined results: rows with a null id, and vectors that are null, zero or hold null or non-finite components, take no part;
vectors of another length than the most frequent one (of equally frequent ones the shorter) have no inner product with
the others and take none either; rows that repeat an id are candidates each, one query
together (the first vector by order); ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import map_arrow, saved, table, work_dir

SHARD_ROWS = 16_384
QUERY_BLOCK = 512
DEGREE = 48
BUILD_BEAM = 64
#: The beam of a shard begins here and doubles until MEASURED sampled queries have RECALL.
SEARCH_BEAM = 160
#: Tasks that share the queries of a shard.
SPLITS = 4
RECALL, MEASURED = 0.93, 64
ALPHA = 1.2
#: Nodes that a step of a search expands: more for wide beams, which would take too many steps.
_WIDE, _WIDEST = 4, 64


class Graph:
    """points: float32, equally long; edges: (n, DEGREE), -1 where none; start: first nodes of a search."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, start: np.ndarray):
        self.points, self.edges, self.start = points, edges, start

    def search(self, queries: np.ndarray, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 where none) and similarities of the best ``beam`` points found, best first. ``limit``: only nodes below it."""
        b, n = len(queries), limit or len(self.points)
        expand = max(_WIDE, min(_WIDEST, beam // 64))
        seen = np.zeros((b, n + 1), bool)  # the last column takes the missing edges
        seen[:, n] = True
        rows = np.arange(b)[:, None]
        ids = np.full((b, beam), -1)
        sim = np.full((b, beam), -np.inf, np.float32)
        done = np.ones((b, beam), bool)
        first = self.start[self.start < n][:beam]
        ids[:, : len(first)] = first
        sim[:, : len(first)] = queries @ self.points[first].T
        done[:, : len(first)] = False
        seen[:, first] = True
        turn = np.argsort(-sim, axis=1, kind="stable")
        ids, sim, done = ids[rows, turn], sim[rows, turn], done[rows, turn]
        live = np.arange(b)
        while len(live):
            open_ = ~done[live]
            some = open_.any(1)
            live, open_ = live[some], open_[some]
            if not len(live):
                break
            rank = np.cumsum(open_, 1)
            pick = open_ & (rank <= expand)
            done[live] |= pick
            r, c = np.nonzero(pick)
            near = self.edges[ids[live[r], c]]  # (picked, degree)
            near = np.where((near < 0) | (near >= n), n, near)
            slot = rank[r, c] - 1
            fresh = np.full((len(live), expand * near.shape[1]), n)
            at = slot[:, None] * near.shape[1] + np.arange(near.shape[1])
            fresh[r[:, None], at] = near
            # a node that two expanded nodes share counts once
            fresh.sort(axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
            own = live[:, None]
            fresh = np.where(seen[own, fresh], n, fresh)
            seen[own, fresh] = True
            width = int((fresh < n).sum(1).max())
            if not width:
                continue
            fresh.sort(axis=1)
            fresh = fresh[:, :width]
            good = fresh < n
            x = self.points[np.where(good, fresh, 0)]
            s = np.where(good, np.einsum("bd,bkd->bk", queries[live], x), -np.inf).astype(np.float32)
            all_ids = np.concatenate([ids[live], np.where(good, fresh, -1)], 1)
            all_sim = np.concatenate([sim[live], s], 1)
            all_done = np.concatenate([done[live], ~good], 1)
            turn = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
            pos = np.arange(len(live))[:, None]
            ids[live], sim[live], done[live] = all_ids[pos, turn], all_sim[pos, turn], all_done[pos, turn]
        return ids, sim


def prune(points: np.ndarray, own: np.ndarray, ids: np.ndarray, length: float, alpha: float = ALPHA, degree: int = DEGREE) -> np.ndarray:
    """Robust pruning of candidate lists (b, c), -1 where none, for the nodes ``own``: kept neighbours (b, degree)."""
    b, c = ids.shape
    ids = np.where(ids == own[:, None], -1, ids)
    x = points[np.maximum(ids, 0)]
    far = np.where(ids >= 0, length - np.einsum("bd,bcd->bc", points[own], x), np.inf)
    turn = np.argsort(far, axis=1, kind="stable")
    pos = np.arange(b)[:, None]
    ids, far, x = ids[pos, turn], far[pos, turn], x[pos, turn]
    between = length - np.matmul(x, x.transpose(0, 2, 1))
    left = ids >= 0
    spare = left.copy()
    kept = np.full((b, degree), -1)
    for k in range(degree):
        some = left.any(1)
        if not some.any():
            break
        best = left.argmax(1)
        kept[some, k] = ids[np.arange(b), best][some]
        spare[np.arange(b)[some], best[some]] = False
        left &= ~((alpha * between[np.arange(b), best] <= far) & some[:, None])
        left[np.arange(b), best] = False
    # places that diversity leaves empty go to the nearest of the others (a node listed twice may fill one)
    have = (kept >= 0).sum(1)
    rank = np.cumsum(spare, 1) - 1 + have[:, None]
    r, c = np.nonzero(spare & (rank < degree))
    kept[r, rank[r, c]] = ids[r, c]
    return kept


def build(points: np.ndarray, seed: int = 3) -> Graph:
    """The graph of equally long points."""
    n = len(points)
    length = float(np.square(points, dtype=np.float64).sum(1).max()) if n else 0.0
    turn = np.random.default_rng(seed).permutation(n)
    points = points[turn]
    edges = np.full((n, DEGREE), -1)
    graph = Graph(points, edges, np.arange(min(n, 24)))
    first = min(n, 512)
    if n:
        sim = points[:first] @ points[:first].T
        near = np.argsort(-sim, axis=1)[:, : min(first, 2 * DEGREE)]
        edges[:first] = prune(points, np.arange(first), near, length)
    a = first
    while a < n:
        b = min(n, a + min(a, 1024))
        for c in range(a, b, 512):
            own = np.arange(c, min(b, c + 512))
            ids, _ = graph.search(points[own], BUILD_BEAM, a)
            edges[own] = prune(points, own, ids, length)
        src = np.repeat(np.arange(a, b), DEGREE)
        dst = edges[a:b].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, at, count = np.unique(dst, return_index=True, return_counts=True)
        most = min(int(count.max()), 2 * DEGREE) if len(count) else 0
        for k in range(0, len(nodes), 1024):
            node, start, many = nodes[k : k + 1024], at[k : k + 1024], count[k : k + 1024]
            new = np.full((len(node), most), -1)
            rank = np.arange(most)
            fits = rank < np.minimum(many, most)[:, None]
            # of more back edges than fit, a spread of them is offered
            step = np.maximum(1.0, many / most)[:, None]
            new[fits] = src[(start[:, None] + np.floor(rank * step).astype(np.int64))[fits]]
            both = np.concatenate([edges[node], new], 1)
            full = (both >= 0).sum(1) > DEGREE
            if full.any():
                edges[node[full]] = prune(points, node[full], both[full], length)
            if (~full).any():
                calm = -np.sort(-both[~full], axis=1)
                edges[node[~full]] = calm[:, :DEGREE]
        a = b
    # a node that no edge leads to takes the last place of its nearest neighbour
    seen = np.zeros(n + 1, bool)
    seen[edges.ravel()] = True
    for node in np.flatnonzero(~seen[:n]):
        if edges[node, 0] >= 0:
            edges[edges[node, 0], -1] = node
    back = np.empty(n, np.int64)
    back[turn] = np.arange(n)
    edges = np.where(edges >= 0, turn[np.maximum(edges, 0)], -1)[back]
    return Graph(points[back], edges, turn[: min(n, 24)])


class Shard:
    """A graph over the distinct vectors of a shard, with the ids of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        group = np.cumsum(new) - 1
        rank = np.arange(len(ids)) - np.flatnonzero(new)[group]
        keep = rank <= k  # of one vector no more than the k smallest ids and the query's own can be among its k nearest
        self.vectors = vectors[new]
        self.ids, self.first = ids[keep], np.concatenate([[0], np.cumsum(np.bincount(group[keep], minlength=len(self.vectors)))])
        norm = np.square(self.vectors, dtype=np.float64).sum(1)
        extra = np.sqrt(np.maximum(0, norm.max() - norm))
        self.graph = build(np.column_stack([self.vectors, extra]).astype(np.float32))
        # long vectors are near many queries: half of a search's first nodes are the longest
        longest = np.argsort(-norm, kind="stable")[:12]
        self.graph.start = np.unique(np.concatenate([self.graph.start[:12], longest]))
        self.beam = self._measure(k)

    def _measure(self, k: int, beam: int = SEARCH_BEAM, sample: int = MEASURED, seed: int = 11) -> int:
        """The least beam, of those doubled from the first, with which sampled vectors find RECALL of their k nearest; at most the size
        of the shard."""
        n = len(self.vectors)
        if n <= beam:
            return beam
        own = self.vectors[np.sort(np.random.default_rng(seed).choice(n, min(sample, n), replace=False))].astype(np.float32)
        exact = own @ self.vectors.astype(np.float32).T
        # ties with the k-th count as found
        least = np.partition(exact, n - k, axis=1)[:, n - k]
        wide = np.column_stack([own, np.zeros(len(own), np.float32)])
        while beam < n:
            near = self._found(wide, beam)
            score = np.where(near >= 0, np.take_along_axis(exact, np.maximum(near, 0), axis=1), -np.inf)
            if np.minimum((score >= least[:, None]).sum(1), k).mean() >= RECALL * k:
                return beam
            beam *= 2
        return n

    def _found(self, wide: np.ndarray, beam: int) -> np.ndarray:
        """What searches find. Wide beams take fewer queries at a time: the places seen and the candidates are held for each."""
        step = max(16, QUERY_BLOCK * SEARCH_BEAM // beam)
        found = [self.graph.search(wide[a : a + step], beam)[0] for a in range(0, len(wide), step)]
        return np.concatenate(found) if found else np.zeros((0, 1), np.int64)

    def dump(self) -> bytes:
        sink = io.BytesIO()
        np.savez(sink, vectors=self.vectors, ids=self.ids, first=self.first, points=self.graph.points, edges=self.graph.edges.astype(np.int32), start=self.graph.start, beam=self.beam)
        return sink.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        self, x = cls.__new__(cls), np.load(io.BytesIO(raw))
        self.vectors, self.ids, self.first = x["vectors"], x["ids"], x["first"]
        self.graph = Graph(x["points"], x["edges"].astype(np.int64), x["start"])
        self.beam = int(x["beam"])
        return self

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vec_id, score) of the k best of each query in this shard."""
        wide = np.column_stack([queries, np.zeros(len(queries), queries.dtype)]).astype(np.float32)
        found = self._found(wide, self.beam)
        out = ([], [], [])
        for q, own, near in zip(ids, queries.astype(np.float64), found, strict=True):
            near = near[near >= 0]
            score = (self.vectors[near].astype(np.float64) * own).sum(1)
            best = np.argsort(-score, kind="stable")
            # points tied with the k-th after one for the query itself can matter
            if len(best) > k + 1:
                best = best[score[best] >= score[best[k]]]
            many = self.first[near[best] + 1] - self.first[near[best]]
            at = np.repeat(self.first[near[best]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            cand, s = self.ids[at], np.repeat(score[best], many)
            other = cand != q
            cand, s = cand[other], s[other]
            top = np.lexsort((cand, -s))[:k]
            for column, values in zip(out, (np.full(len(top), q), cand[top], s[top]), strict=True):
                column.append(values)
        return tuple(np.concatenate(c) if c else np.zeros(0) for c in out)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vector (array<float>, or array<double> where the column has doubles) of the rows that take part."""
    kind = "double" if "double" in dict(vectors.dtypes)[column] else "float"
    v = F.col("vector")
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast(f"array<{kind}>").alias("vector")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    )
    usual = whole.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return whole.join(F.broadcast(usual.select("d")), F.size("vector") == F.col("d"), "left_semi")


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.array(flat, flat.dtype if flat.dtype == np.float64 else np.float32).reshape(rows, -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for tables of (vec_id, vector). Every query goes to every shard, so shards should be
    as large as memory allows where there are many queries."""
    spark = vectors.sparkSession
    shards = max(1, -(-vectors.count() // shard_rows))
    folder = work_dir(spark, "graphs")
    whole = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def make(rows: pa.Table) -> pa.Table:
        data = _matrix(rows.column("vector").combine_chunks(), len(rows))
        shard = Shard(rows.column("vec_id").to_numpy(), data, k)
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, temporary = f"{root}/{rows.column('shard')[0].as_py()}.npz", f"{root}/.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as sink:
            sink.write(shard.dump())
        system.move(temporary, name)
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "points": pa.array([len(shard.vectors)], pa.int64()), "beam": pa.array([shard.beam], pa.int64())})

    # a task a shard: their sizes are alike, and none waits behind another
    saved(whole.repartition(shards, "shard").groupBy("shard").applyInArrow(make, "shard int, points long, beam long"), "graph-list")
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int"))
    # a block of queries is one row, which goes to every shard
    packed = block.groupBy("block").agg(F.collect_list(F.struct("vec_id", "vector")).alias("q"))
    units = packed.select("block", "q", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).withColumn("split", F.col("block") % SPLITS)
    units = units.repartition(shards * min(SPLITS, blocks), "shard", "split").sortWithinPartitions("shard", "block")

    def find(batches):
        system, root = fs.FileSystem.from_uri(folder)
        now, shard = None, None
        for batch in batches:
            for number, q in zip(batch.column("shard").to_pylist(), batch.column("q"), strict=True):
                if number != now:
                    now, shard, path = number, None, f"{root}/{number}.npz"
                    if system.get_file_info(path).type != fs.FileType.NotFound:
                        with system.open_input_stream(path) as source:
                            shard = Shard.load(source.read())
                if shard is None:  # no vector has come to it
                    continue
                own = q.values
                ids = own.field("vec_id").to_numpy(zero_copy_only=False)
                cols = shard.nearest(ids, _matrix(own.field("vector"), len(ids)), k)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], names=["query_id", "vec_id", "score"])

    found = map_arrow(units.select("shard", "q"), find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op8_neighbours": op8_neighbours}

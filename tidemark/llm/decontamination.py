"""Benchmark decontamination by suffix arrays over the training text.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The training text is cut into shards of whole documents;
each shard gets a suffix array over its words. Every suffix of every benchmark item is looked up in every shard by
binary search; the matches of a window (13 words, or a whole shorter item) give its locations, and runs of windows
the longest verbatim matches. A document word inside any occurrence is hit; a document with ``n_hit`` > 0 and
20 * n_hit >= n_words is contaminated.

The benchmark is cut by item into blocks of some ``BLOCK_BYTES`` of text, prepared by the executors and kept as files in
the shared folder; some 50 bytes a word are in memory, of one block at a time. The documents are read once, however
many blocks there are, and are neither shuffled nor sent to the driver.

Defined results: null and empty texts have no words, no hits and are clean; an item without words or with a null id
is ignored, items of one id count once; repeated documents are judged alike; a very long document is a shard of its
own; an empty benchmark leaves all clean; columns of docs named like a result column give way to it in ``judge`` and
stay as they are in ``remove_contaminated``.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import ALNUM_WORDS, Words, map_arrow, mix64, saved, slices, table, text_buffers, with_columns, words, work_dir

WINDOW = 13
BLOCK_BYTES = 8 << 20
#: Bytes of text of a shard (a longer document is a shard of its own).
SHARD_BYTES = 2 << 20
#: Windows that are compared, and matches that are joined into runs, in one step.
STEP = 1 << 16

RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_words", "longest_item", "longest_start")
_KINDS = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType(), T.LongType(), T.StringType(), T.LongType())


class Windows(NamedTuple):
    """Distinct windows of a benchmark block and all their places."""

    word: np.ndarray  # uint64, the words of all rows one after another
    start: np.ndarray  # first word of each window
    size: np.ndarray
    first: np.ndarray  # places of window i: row[first[i]:first[i + 1]], at[...]
    row: np.ndarray  # rows of the block
    at: np.ndarray  # first word within the row
    item: np.ndarray  # index into ids of each row
    ids: list[str]

    def dump(self) -> bytes:
        sink = io.BytesIO()
        np.savez(sink, **{n: x for n, x in zip(self._fields, self, strict=True) if n != "ids"}, ids=np.frombuffer(json.dumps(self.ids).encode(), np.uint8))
        return sink.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Windows:
        x = np.load(io.BytesIO(raw))
        return cls(*[json.loads(x[n].tobytes()) if n == "ids" else x[n] for n in cls._fields])


def item_windows(items: list[tuple[object, str]], window: int = WINDOW) -> Windows:
    """Windows of (item_id, text) rows."""
    rows = [(str(k), t.encode()) for k, t in items if k is not None and t]
    offs = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])]).astype(np.int64)
    w = words(np.frombuffer(b"".join(t for _, t in rows), np.uint8), offs, ALNUM_WORDS)
    ids = sorted({k for k, _ in rows})
    number = {k: i for i, k in enumerate(ids)}
    many = np.where(w.count >= window, w.count - window + 1, w.count > 0)
    row = np.repeat(np.arange(len(rows)), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start, size = (np.cumsum(w.count) - w.count)[row] + at, np.minimum(window, w.count[row])
    last = max(0, len(w.hash) - 1)
    key = size.astype(np.uint64)
    for k in range(window):
        key = key * np.uint64(0x2545F4914F6CDD1D) + np.where(k < size, w.hash[np.minimum(start + k, last)], np.uint64(0)) if len(w.hash) else key
    key = mix64(key)
    turn = np.argsort(key, kind="stable")
    key, row, at, start, size = key[turn], row[turn], at[turn], start[turn], size[turn]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    # equal keys are compared word by word
    for a in range(0, len(key), STEP):
        same = np.flatnonzero(~new[a : a + STEP]) + a
        x, y = (np.where(np.arange(window) < size[same + d][:, None], w.hash[np.minimum(start[same + d][:, None] + np.arange(window), last)], 0) for d in (0, -1))
        new[same[(x != y).any(1) | (size[same] != size[same - 1])]] = True
    first = np.flatnonzero(new)
    return Windows(w.hash, start[first], size[first], np.append(first, len(key)), row.astype(np.int32), at.astype(np.int32), np.array([number[k] for k, _ in rows], np.int32), ids)


class Shard:
    """A suffix array over the words of some documents, in order to a depth of at least ``depth`` words."""

    def __init__(self, w: Words, depth: int = WINDOW):
        count, self.depth = w.count, depth
        codes, self.vocabulary = pd.factorize(w.hash)
        # one end mark (0) after each document; matches never hold one
        ends = np.cumsum(count + 1) - 1
        text = np.zeros(len(codes) + len(count) + depth, np.int64)
        text[np.arange(len(codes)) + w.doc] = codes + 1
        self.text, self.ends, n = text, ends, len(codes) + len(count)
        self.doc_start = ends - count
        bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.bits, k = bits, max(1, min(depth, 62 // bits))
        key = np.zeros(n, np.int64)
        for j in range(k):
            key = (key << bits) | text[j : n + j]
        self.order = np.argsort(key)
        self.key, self.k = key[self.order], k
        self._refine(key, n, k, depth)

    def _refine(self, key: np.ndarray, n: int, h: int, depth: int) -> None:
        """Prefix doubling over the suffixes that are still tied and hold no end mark within the sorted depth."""
        head = np.ones(n, bool)
        head[1:] = self.key[1:] != self.key[:-1]
        rank = np.empty(n + depth, np.int64)
        rank[n:] = 0
        rank[self.order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        to_end = self.ends[np.searchsorted(self.ends, np.arange(n))] - np.arange(n)
        while h < depth:
            tied = np.zeros(n, bool)
            tied[:-1] = ~head[1:]
            tied |= ~head
            slots = np.flatnonzero(tied)
            slots = slots[to_end[self.order[slots]] >= h]
            if not len(slots):
                break
            own = self.order[slots]
            pair = rank[own] * (n + 1) + rank[np.minimum(own + h, n)]
            turn = np.argsort(pair)
            pair, own = pair[turn], own[turn]
            self.order[slots] = own
            # a group is whole here: its members share their first h words, so all or none hold an end mark
            fresh = np.ones(len(slots), bool)
            fresh[1:] = pair[1:] != pair[:-1]
            head[slots] = fresh
            rank[own] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
            h *= 2

    def find(self, q: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in text) of every occurrence."""
        if not len(self.vocabulary) or not len(q.size):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sorter = np.argsort(self.vocabulary)
        sorted_words = self.vocabulary[sorter]
        spot = np.minimum(np.searchsorted(sorted_words, q.word), len(sorted_words) - 1)
        known = sorted_words[spot] == q.word
        code = np.where(known, sorter[spot] + 1, 0)
        missing = np.concatenate([[0], np.cumsum(~known)])
        alive = np.flatnonzero(missing[q.start + q.size] == missing[q.start])
        found = [self._find(q, code, alive[a : a + STEP]) for a in range(0, len(alive), STEP)]
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (alive, alive)

    def _find(self, q: Windows, words_code: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, column = q.size[alive], np.arange(self.depth)
        code = np.where(column < size[:, None], words_code[np.minimum(q.start[alive][:, None] + column, len(words_code) - 1)], 0)
        low = np.zeros(len(alive), np.int64)
        for j in range(self.k):
            low = (low << self.bits) | code[:, j]
        span = np.int64(1) << (self.bits * np.maximum(0, self.k - size))
        lo, hi = np.searchsorted(self.key, low), np.searchsorted(self.key, low + span - 1, "right")
        some = hi > lo
        alive, code, size, lo, hi = alive[some], code[some], size[some], lo[some], hi[some]
        lo, hi = self._bound(code, size, lo, hi, False), self._bound(code, size, lo, hi, True)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        slot = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return alive[which], self.order[slot]

    def _bound(self, code, size, lo, hi, after: bool) -> np.ndarray:
        """Binary search within [lo, hi) for the first suffix not below (``after``: above) each window."""
        lo, hi = lo.copy(), hi.copy()
        column = np.arange(code.shape[1])
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            own = self.text[np.minimum(self.order[mid][:, None] + column, len(self.text) - 1)]
            diff = np.where(column < size[open_][:, None], own - code[open_], 0)
            at = (diff != 0).argmax(1)
            sign = diff[np.arange(len(diff)), at]
            # suffixes rank by first codes and then by ranks, which follow the codes
            right = sign <= 0 if after else sign < 0
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)
        return lo


def runs(which: np.ndarray, place: np.ndarray, q: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first word in the row, place in text, words) of the longest verbatim matches: adjacent matches of windows that
    are adjacent in their row are one. Works through the text in steps, with the runs that may go on carried along."""
    turn = np.argsort(place, kind="stable")
    which, place = which[turn], place[turn]
    many = (q.first[1:] - q.first[:-1])[which]
    reach = np.cumsum(many)
    # row, row's first word less place, first and last place, end
    held = np.zeros((5, 0), np.int64)
    a = 0
    while a < len(which):
        b = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + STEP, "right")))
        n = many[a:b]
        at = np.arange(n.sum()) + np.repeat(q.first[which[a:b]] - np.cumsum(n) + n, n)
        s = np.repeat(place[a:b], n)
        new = np.stack([q.row[at].astype(np.int64), q.at[at] - s, s, s, s + np.repeat(q.size[which[a:b]], n)])
        every = np.concatenate([held, new], 1)
        every = every[:, np.lexsort((every[3], every[1], every[0]))]
        row, diagonal, first, last, end = every
        cut = np.ones(len(row), bool)
        cut[1:] = (row[1:] != row[:-1]) | (diagonal[1:] != diagonal[:-1]) | (first[1:] != last[:-1] + 1)
        head = np.flatnonzero(cut)
        tail = np.append(head[1:], len(row)) - 1
        held = np.stack([row[head], diagonal[head], first[head], last[tail], end[tail]])
        over = held[3] < place[b - 1] if b < len(which) else np.ones(len(head), bool)
        row, diagonal, first, _, end = held[:, over]
        yield row, first + diagonal, first, end - first
        held, a = held[:, ~over], b


class Found(NamedTuple):
    """What a batch of texts holds."""

    words: np.ndarray
    hits: np.ndarray
    items: list[set[str]]
    longest: list[tuple[int, str | None, int]]  # words below zero, item, first word; (0, None, 0) without a match


def scan(data: np.ndarray, offs: np.ndarray, blocks) -> Found:
    """Look the windows of ``blocks()`` up in some texts."""
    cut = list(slices(offs, SHARD_BYTES))
    counts = [words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], ALNUM_WORDS) for a, b in cut]
    n = np.concatenate([np.zeros(0, np.int64), *[w.count for w in counts]])
    hits = np.zeros(len(n), np.int64)
    items: list[set[str]] = [set() for _ in n]
    longest: list[tuple[int, str | None, int]] = [(0, None, 0)] * len(n)
    for (a, _), w in zip(cut, counts, strict=True):
        shard = Shard(w)
        hit = np.zeros(len(shard.text) + 1, np.int32)
        for q in blocks():
            which, place = shard.find(q)
            if not len(which):
                continue
            np.add.at(hit, place, 1)
            np.subtract.at(hit, place + q.size[which], 1)
            pairs = np.unique(np.searchsorted(shard.ends, place) * len(q.size) + which)
            for d, i in zip((pairs // len(q.size)).tolist(), (pairs % len(q.size)).tolist(), strict=True):
                items[a + d].update(q.ids[k] for k in np.unique(q.item[q.row[q.first[i] : q.first[i + 1]]]).tolist())
            for row, _, at, size in runs(which, place, q):
                doc, item = np.searchsorted(shard.ends, at), q.item[row]
                turn = np.lexsort((at, item, -size, doc))
                best = turn[np.unique(doc[turn], return_index=True)[1]]
                for d, k, m, p in zip(doc[best].tolist(), item[best].tolist(), size[best].tolist(), (at - shard.doc_start[doc])[best].tolist(), strict=True):
                    longest[a + d] = min(longest[a + d], (-m, q.ids[k], p))
        inside = np.concatenate([[0], np.cumsum(np.cumsum(hit) > 0)])
        hits[a : a + len(w.count)] = inside[shard.ends] - inside[shard.doc_start]
    return Found(n, hits, items, longest)


class Blocks:
    """The windows of a benchmark as files; calling it reads them one by one (a single one is kept)."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names, self._kept = folder, names, None

    def __call__(self) -> Iterator[Windows]:
        if self._kept is not None:
            yield self._kept
            return
        system, root = fs.FileSystem.from_uri(self.folder)
        for name in self.names:
            with system.open_input_stream(f"{root}/{name}") as source:
                q = Windows.load(source.read())
            if len(self.names) == 1:
                self._kept = q
            yield q


def prepare(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Write the windows of (item_id, text), one file a block; the rows of an item are in one block."""
    folder = work_dir(benchmark.sparkSession, "benchmark")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-int(total) // block_bytes)))).cast("int")

    def write(rows: pa.Table) -> pa.Table:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, temporary = f"{rows.column('block')[0].as_py()}.npz", f"{root}/.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as sink:
            sink.write(item_windows(list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True))).dump())
        system.move(temporary, f"{root}/{name}")
        return pa.table({"name": [name]})

    made = saved(items.withColumn("block", block).groupBy("block").applyInArrow(write, "name string"), "benchmark-blocks")
    return Blocks(folder, sorted(r.name for r in made.collect()))  # one row a block


def _judged(docs: DataFrame, benchmark: DataFrame, names: tuple[str, ...], block_bytes: int) -> DataFrame:
    schema = with_columns(docs.schema, *zip(names, _KINDS, strict=True))
    kept = [f.name for f in schema][: -len(names)]
    blocks = prepare(benchmark, block_bytes)

    def run(batches):
        for batch in batches:
            found = scan(*text_buffers(batch.column("text")), blocks)
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found.items]
            cols = (found.words, found.hits, [len(x) for x in found.items], sha, (found.hits > 0) & (20 * found.hits >= found.words), [-n for n, _, _ in found.longest], [i for _, i, _ in found.longest], [p if i is not None else None for _, i, p in found.longest])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[f.name for f in schema])

    return map_arrow(docs, run, schema)


def judge(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every column of docs, then RESULTS: words, hit words, items found and the hash of their sorted ids, the verdict, and
    the longest verbatim match (words, item, first word in the document; of equally long ones the least item, then place)."""
    return _judged(docs, benchmark, RESULTS, block_bytes)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The clean documents, with the columns of docs."""
    names = tuple(f"tidemark_{n}" for n in RESULTS)
    return _judged(docs, benchmark, names, block_bytes).where("NOT tidemark_contaminated").select(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, item_start, doc_id, doc_start, n_words of every longest verbatim match of at least a window, starts
    counted in words; each shard joins its adjacent window matches into runs."""
    blocks = prepare(benchmark, block_bytes)
    kinds = {"item_id": pa.string(), "item_start": pa.int64(), "doc_id": pa.int64(), "doc_start": pa.int64(), "n_words": pa.int64()}

    def run(batches):
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for a, b in slices(offs, SHARD_BYTES):
                shard = Shard(words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], ALNUM_WORDS))
                ids = batch.column("doc_id").slice(a, b - a)
                for q in blocks():
                    for row, p, s, n in runs(*shard.find(q), q):
                        doc = np.searchsorted(shard.ends, s)
                        cols = ([q.ids[k] for k in q.item[row].tolist()], p, ids.take(pa.array(doc)), s - shard.doc_start[doc], n)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "item_id string, item_start long, doc_id long, doc_start long, n_words long")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "benchmark")).select("doc_id", *RESULTS)


QUERIES = {"op10_decontamination": op10_decontamination}

_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = {
    "op10_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS ws FROM documents),
i AS (SELECT row_number() OVER () AS b, item_id::VARCHAR AS item, {_SQL_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT b, item, q, ws[q : q + least(len(ws), {WINDOW}) - 1] AS g FROM (SELECT b, item, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS q FROM i WHERE len(ws) > 0)),
n AS (SELECT DISTINCT len(g) AS n FROM w),
s AS (SELECT r, p, n, ws[p : p + n - 1] AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, n WHERE len(ws) >= n)),
h AS (SELECT s.r, s.p, s.n, w.b, w.item, w.q FROM s JOIN w ON s.g = w.g),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM h) GROUP BY r),
l AS (SELECT r, item, min(p) AS p, max(p) + max(n) - min(p) AS m FROM (SELECT *, p - row_number() OVER (PARTITION BY r, b, p - q ORDER BY p) AS island FROM h) GROUP BY r, b, item, p - q, island),
m AS (SELECT r, item, p, m FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY m DESC, item, p) AS k FROM l) WHERE k = 1)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, coalesce(t.items_sha256, sha256('')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.ws) AS contaminated,
  coalesce(m.m, 0)::BIGINT AS longest_words, m.item AS longest_item, (m.p - 1)::BIGINT AS longest_start
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN t ON d.r = t.r LEFT JOIN m ON d.r = m.r
"""
}

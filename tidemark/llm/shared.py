"""Helpers of the operators: the shared work folder, Arrow text columns, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that one vectorised step works on (a longer text is one step of its own). A step takes some 40 times as much.
SLICE_BYTES = 1 << 20


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by spark.checkpoint.dir; only a local session (tests) may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so lost executors cost no recomputation."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    return back


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs now, not when the driver next collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete tables made by saved() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tidemark_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of an Arrow batch at most: texts are long, and each task holds some batches on either side.
BATCH_ROWS = 1000


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a task's Python process for later tasks of any kind."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with batches that suit long texts (the session's limit counts where it is lower)."""

    def whole(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(whole, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema plus new columns; a column of the same name (any case) gives way to the new one."""
    new = {n.lower() for n, _ in fields}
    return T.StructType([f for f in schema if f.name.lower() not in new] + [T.StructField(n, t, True) for n, t in fields])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes together."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: The bytes of an 8-byte piece that belong to a word with so many bytes left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


#: Bytes of words: everything but ASCII white space; or letters, digits and every non-ASCII character.
SPACE_WORDS = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
ALNUM_WORDS = np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)])


class Words(NamedTuple):
    hash: np.ndarray  # uint64 for each word
    doc: np.ndarray  # row of each word
    count: np.ndarray  # words of each row


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> Words:
    """64-bit hashes of the words of lower-cased (A-Z) texts. data[offs[i]:offs[i + 1]] is text i, offs[0] is 0."""
    n, docs = len(data), len(offs) - 1
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(docs, np.int64))
    b = FOLD[data]
    w = kind[b]
    before = np.empty(n, bool)
    before[0], before[1:] = False, w[:-1]
    first = offs[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, w[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(w & ~after) + 1
    doc = np.searchsorted(offs, starts, "right") - 1
    # the 8-byte pieces of each word, mixed with their places, are added up: a word of one piece is its own key
    size = ends - starts
    many = (size + 7) >> 3
    first = np.cumsum(many) - many
    place = np.arange(many.sum()) - np.repeat(first, many)
    piece = np.ndarray(n, "<u8", np.concatenate([b, np.zeros(8, np.uint8)]), strides=(1,))[np.repeat(starts, many) + 8 * place]
    piece &= _LEFT[np.minimum(np.repeat(size, many) - 8 * place, 8)]
    mixed = mix64(piece ^ (place.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
    h = np.add.reduceat(mixed, first) if len(first) else mixed
    return Words(mix64(h + size.astype(np.uint64) * _GOLDEN), doc, np.bincount(doc, minlength=docs))


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of runs of ``size`` words; a row of fewer words, but not none, gives its whole sequence."""
    h, n = w.hash, len(w.hash)
    out_h, out_d = [], []
    if n >= size:
        acc = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            acc = acc * np.uint64(0x2545F4914F6CDD1D) + h[k : n - size + 1 + k]
        same = w.doc[: n - size + 1] == w.doc[size - 1 :]
        out_h.append(mix64(acc[same]))
        out_d.append(w.doc[: n - size + 1][same])
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(short):
        start = np.concatenate([[0], np.cumsum(w.count)])
        acc = np.full(len(short), 77, np.uint64)
        for k in range(size - 1):
            has = w.count[short] > k
            acc[has] = acc[has] * np.uint64(0x2545F4914F6CDD1D) + h[start[short[has]] + k]
        out_h.append(mix64(acc + w.count[short].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        out_d.append(short)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_d)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(ridge)), x.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

"""Phrase collocation mining: count-min sketches, then exact counts of their survivors only, then scores.

Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those into words ``[^\\x20\\x09]+``.
Everything is per language (null: ``und``).

1. Sketch passes (``PASSES``): each task adds the hashed n-grams of one length to two rows of counters that stop at
   ``min_count``; the tasks' blocks of counters are added up by block, and of each sum only one bit is kept: whether it
   reaches ``min_count``. A sketch never counts too little, so a clear bit rules an n-gram out for good. A longer n-gram is only
   added where both its parts of one word less are still possible, as it is at most as frequent as they are.
2. The exact pass counts, by their words and not by a hash, the n-grams that all passes leave possible.
3. The counts give each phrase of two words or more its lowest score over all cuts; phrases inside longer ones that
   are as frequent are dropped.

The rows of counters have about four counters for each ``min_count`` words, at most ``MOST_CELLS`` (the bits of a pass are
broadcast: 2 * MOST_CELLS / 8 bytes). A fuller sketch leaves more survivors to the exact pass and loses none.

Defined results: null and empty texts have no words; repeated rows count again; null ids and other columns, of any name, are
ignored; a text of any length is counted whole; an empty table has no phrases; ties in score are ordered by count and by the
phrase's UTF-8 bytes. Scores are exact for corpora of up to 10^17 words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.shared import FOLD, map_arrow, mix64, saved, slices, table, text_buffers, words

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: Lengths of the n-grams that each sketch pass counts.
PASSES = ((1,), (2,), (3, 4, 5))
#: Counters of a row of a sketch, at least and at most, and rows.
LEAST_CELLS, MOST_CELLS, ROWS = 1 << 16, 1 << 26, 2
#: Counters that travel together.
BLOCK = 1 << 16
UNKNOWN = "und"
#: Languages up to which their totals are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000

#: Bytes that end a piece; bytes of words.
ENDS = np.isin(np.arange(256), [*b".,;:!?", *range(10, 14)])
WORD = ~(ENDS | np.isin(np.arange(256), [9, 32]))
_STEP = np.uint64(0x2545F4914F6CDD1D)


class Slice:
    """The words of some texts: their hashes, and the same words as bytes with one space after each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lang: np.ndarray):
        found = words(data, offs, WORD)
        self.hash, self.count = found.hash, found.count
        n = len(data)
        folded = FOLD[data]
        inside = WORD[folded]
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        before[offs[:-1][offs[:-1] < n]] = False
        starts = np.flatnonzero(inside & ~before)
        # a piece is known by the marks before it; texts are pieces of their own
        self.piece = np.cumsum(ENDS[folded])[starts] + found.doc
        self.lang = lang[found.doc]
        after = np.concatenate([inside[1:], [False]]) if n else inside
        after[(offs[1:] - 1)[offs[1:] > 0]] = False
        size = np.flatnonzero(inside & ~after) + 1 - starts
        self.begin = np.concatenate([[0], np.cumsum(size + 1)])
        self.bytes = np.full(self.begin[-1], 32, np.uint8)
        self.bytes[_runs(self.begin[:-1], size)] = folded[inside]

    def grams(self, salt: np.ndarray, filters: dict[int, list[np.ndarray]], upto: int):
        """(length, hashes, positions) of the n-grams of each length that the filters so far leave possible."""
        n = len(self.hash)
        key = mix64(self.hash ^ salt[self.lang]) if n else self.hash
        alive = np.ones(n, bool)
        for k in range(1, upto + 1):
            if k > 1:
                key = mix64(key[: max(0, n - k + 1)] * _STEP + self.hash[k - 1 :])
                alive = alive[:-1] & alive[1:] & (self.piece[: len(key)] == self.piece[k - 1 :]) if len(key) else np.zeros(0, bool)
            at = np.flatnonzero(alive)
            if k in filters:
                ok = possible(key[at], filters[k])
                alive[at[~ok]] = False
                at = at[ok]
            yield k, key[at], at
            if not len(key):
                return


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] of them, then first[1], ..."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def cells_of(key: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The counter of each hash in a row: its uppermost bits, or those of the hash mixed again."""
    for _ in range(row):
        key = mix64(key + np.uint64(row))
    return (key >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


def possible(key: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Whether all rows of the sketch reach the least count."""
    ok = np.ones(len(key), bool)
    for row, b in enumerate(bits):
        at = cells_of(key, row, 8 * len(b))
        ok &= (b[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ok


def add(counters: np.ndarray, at: np.ndarray, count: np.ndarray, most: int) -> None:
    """counters[at] += count, no further than ``most``; places may repeat."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
    if len(first):
        cell = at[first]
        counters[cell] = np.minimum(counters[cell] + np.add.reduceat(count[order], first), most)


def _texts(batches):
    """Slices of the batches with the names of their languages and a salt for each."""
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        names = np.array([*lang.dictionary.to_pylist(), UNKNOWN], dtype=object)
        codes = lang.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
        data, offs = text_buffers(batch.column("text"))
        for i, j in slices(offs):
            yield Slice(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], codes[i:j]), names, salt


def sketch(docs: DataFrame, lengths: tuple[int, ...], filters, cells: int, min_count: int) -> list[np.ndarray]:
    """The bits of the merged sketch of the n-grams of these lengths: for each row, a packed array of ``cells`` bits."""
    kind = np.uint8 if min_count <= 255 else np.uint16 if min_count <= 65535 else np.uint32
    block = min(BLOCK, cells)

    def local(batches):
        counters = np.zeros((ROWS, cells), kind)
        for part, _, salt in _texts(batches):
            for k, key, _ in part.grams(salt, filters.value, max(lengths)):
                if k in lengths and len(key):
                    key, count = np.unique(key, return_counts=True)
                    for row in range(ROWS):
                        add(counters[row], cells_of(key, row, cells), count, min_count)
        pack = zstandard.ZstdCompressor(level=1)
        for row in range(ROWS):
            for b in np.flatnonzero(counters[row].reshape(-1, block).any(axis=1)):
                yield pa.record_batch([pa.array([row * (cells // block) + int(b)], pa.int32()), pa.array([pack.compress(counters[row, b * block : (b + 1) * block].tobytes())], pa.binary())], ["block", "counters"])

    def merged(batches):
        def done():
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([np.packbits(total >= min_count).tobytes()], pa.binary())], ["block", "bits"])

        unpack, at, total = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            for b, packed in zip(batch.column("block").to_pylist(), batch.column("counters").to_pylist(), strict=True):
                if b != at:
                    if at is not None:
                        yield done()
                    at, total = b, np.zeros(block, np.uint64)
                total += np.frombuffer(unpack.decompress(packed), kind)
        if at is not None:
            yield done()

    parts = map_arrow(docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")), local, "block int, counters binary")
    # the counters of a block come one task after another: a task holds one block's sum at a time
    spread = parts.repartition(F.col("block")).sortWithinPartitions("block")
    bits = [np.zeros(cells // 8, np.uint8) for _ in range(ROWS)]
    for r in map_arrow(spread, merged, "block int, bits binary").collect():  # at most ROWS * MOST_CELLS / 8 bytes
        row, b = divmod(r["block"], cells // block)
        bits[row][b * block // 8 : (b + 1) * block // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def survivors(part: Slice, names: np.ndarray, salt: np.ndarray, filters, longest: int):
    """lang, k, phrase, f of the possible n-grams of a slice, and of its words altogether (k = 0)."""
    per = np.bincount(part.lang, minlength=len(names))
    have = np.flatnonzero(per)
    yield pa.record_batch([pa.array(names[have], pa.string()), pa.array(np.zeros(len(have), np.int32)), pa.array([""] * len(have), pa.string()), pa.array(per[have].astype(np.int64))], ["lang", "k", "phrase", "f"])
    for k, key, at in part.grams(salt, filters, longest):
        if not len(at):
            continue
        begin, end = part.begin[at], part.begin[at + k] - 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        like = np.empty(len(at), np.int64)  # the first n-gram with the same hash
        like[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        # equal hashes are not enough: language, length and bytes are compared
        same = (part.lang[at] == part.lang[at[like]]) & (end - begin == (end - begin)[like])
        own = np.flatnonzero(same & (like != np.arange(len(at))))
        size = (end - begin)[own]
        differs = part.bytes[_runs(begin[own], size)] != part.bytes[_runs(begin[like[own]], size)]
        if differs.any():
            same[own[np.unique(np.repeat(np.arange(len(own)), size)[differs])]] = False
        like = np.where(same, like, np.arange(len(at)))
        count = np.bincount(like, minlength=len(at))
        kept = np.flatnonzero(count)
        size = (end - begin)[kept]
        text = pa.StringArray.from_buffers(len(kept), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(part.bytes[_runs(begin[kept], size)]))
        yield pa.record_batch([pa.array(names[part.lang[at[kept]]], pa.string()), pa.array(np.full(len(kept), k, np.int32)), text, pa.array(count[kept])], ["lang", "k", "phrase", "f"])


def counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """lang, k, phrase, f: every n-gram of up to ``longest`` words that occurs ``min_count`` times; k = 0 has all words."""
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # a word and what parts it from the next take some six bytes
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (4 * size // 6 // min_count).bit_length()))
    filters: dict[int, list[np.ndarray]] = {}
    for lengths in PASSES:
        lengths = tuple(k for k in lengths if k <= longest)
        if lengths:
            known = spark.sparkContext.broadcast(dict(filters))
            bits = sketch(docs, lengths, known, cells, min_count)
            filters |= dict.fromkeys(lengths, bits)
    known = spark.sparkContext.broadcast(filters)

    def exact(batches):
        for part, names, salt in _texts(batches):
            yield from survivors(part, names, salt, known.value, longest)

    rows = map_arrow(docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")), exact, "lang string, k int, phrase string, f long")
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("k") == 0))


def scored(counted: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of the phrases of two words or more: the cut with the lowest score, the first of ties."""
    n = counted.where("k = 0").select("lang", F.col("f").alias("n"))
    if n.count() <= BROADCAST_ROWS:
        n = F.broadcast(n)
    part = counted.where("k > 0").select("lang", "phrase", "f")
    whole = counted.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = whole.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.withColumn("first", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ")).withColumn("rest", F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ")).drop("w")
    both = cut.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(n, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * (CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r", "n")).alias("x"))
    return lowest.select("lang", "phrase", *[f"x.{c}" for c in ("k", "a", "l", "r", "n", "score")])


def subsumed(counted: DataFrame, share: int = 100) -> DataFrame:
    """lang, phrase of those inside a longer phrase with 100 * f(longer) >= share * f. A longer phrase that has this is part
    of one longer by a single word that has it too, so neighbours in length are enough."""
    w = F.split("phrase", " ")
    cut = F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("k") - 1), " ")))
    longer = counted.where("k > 2").select("lang", cut.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return longer.join(counted.where("k > 1"), ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("f") * share).select("lang", "phrase")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, share: int = 100) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counted = saved(counts(docs, min_count, longest), "phrase-counts")
    kept = scored(counted).join(subsumed(counted, share), ["lang", "phrase"], "left_anti")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_collocations": op11_collocations}

ORACLE = {
    "op11_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT x.lang, x.phrase, x.k, x.a, x.cut, l.f AS l, r.f AS r, n.n,
        ((1000::HUGEINT * x.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ')
      JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:], ' ') JOIN n ON n.lang = x.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND c.a >= b.a)),
t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d)
SELECT * FROM t WHERE rank <= 2000
""",
}

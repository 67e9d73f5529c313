"""N-gram Jaccard join by token-combination prefixes.

The tokens of a document are its distinct 5-word shingles; two documents link when 100 * |A & B| >= 80 * |A | B|.

1. Documents of equal token sets form a class, known by a digest; only classes are joined.
2. Every (token, class) is dealt to a bucket of tokens, in packed blocks of 6-byte tokens, and the classes of each token
   are counted. A token of one class cannot be shared: a class of which over a fifth are such tokens links with nothing.
   Tokens that many classes share already within a slice of the text (``HOT``) are known to be frequent: they are listed,
   take the greatest count and go to their classes directly, so that no passage of a third of all documents meets in a bucket.
   Three eighths of the tokens (``FIRST``) are dealt first. Where those that no other class has are over a fifth of all
   tokens, the class is out, and the other tokens are dealt, and counted, only of the rows of classes that are left.
   Buckets are as many as the shuffle partitions by the eighths dealt, or as the tokens ask if those are more.
3. The tokens of the other classes go back, packed, to a bucket of classes. There a class orders its tokens from rare to
   frequent and takes a prefix. A rare token is a signature alone. Frequent tokens fall into ``SUBCLASSES`` subclasses and
   pairs within a subclass are the signatures; the prefix is extended until, whatever tokens a partner lacks, one
   signature at least is common: every rare token, and every frequent one after the first of its subclass, counts
   one, and the count must exceed the tokens a partner may lack. Where a class has too few tokens for that, its
   frequent tokens are signatures alone too.
4. Classes of a signature are candidates. Each is verified first against its most frequent pivot (the class of a
   signature with the fewest tokens of its own), links join components, and only signatures whose classes still
   lie in different components go on: further pivots, then the remaining pairs across components whose sizes, unshared
   tokens and sketches allow a link. Near copies by the thousand so cost a verification each, and no pair of different
   components is left out.

Defined results: null, empty and blank texts have no tokens, no links and are their own component; documents of under
5 words are one token; repeated rows belong to one class; a null id takes no part in a component's smallest id (a
component of null ids only is null); very long texts are whole; other columns are ignored. ``keep_one`` keeps one row of
each component, that of the smallest id (null last, then the least digest, then the least hash of the row), and every row
without tokens.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import SPACE_WORDS, discard, give_back, map_arrow, mix64, release, saved, shingles, slices, table, text_buffers, words, work_dir

SHINGLE = 5
#: Classes up to which a token is rare: a signature alone.
RARE = 8
SUBCLASSES = 64
#: Tokens that one packed block is cut from.
FLUSH_TOKENS = 1 << 18
#: Classes of a signature up to which all its pairs across components are verified at once.
SMALL = 12
PIVOT_ROUNDS = 3
#: Classes that share a token within one slice of text, from which on it is listed as hot, and the length of that list.
HOT, HOT_TOKENS = 32, 500_000
#: Eighths of the tokens, by their highest bits, that are dealt of every class.
FIRST = 3
#: Tokens of a bucket, on average, if there are more than the shuffle partitions hold. More buckets cut the tokens of a
#: document into more runs, each of 9 bytes.
BUCKET_TOKENS = 1 << 22
#: Counts of classes stop here.
MOST = 65535
#: The place of a row: its file and where it stands in it. Rows whose places share a file of bits.
FILE, ROW = "tidemark_file", "tidemark_row"
CHUNK = 1 << 20

_RUN = np.dtype([("set", "<i8"), ("k", "u1")])
#: Once a block: the tokens of a set, and those of them that are dealt first.
_SIZE = np.dtype([("set", "<i8"), ("n", "<u4"), ("first", "<u4")])


def _pack48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, :6] = six
    return wide.reshape(-1).view("<u8").astype(np.int64)


def token_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 48-bit tokens sorted by text, their texts, tokens of each text, digest of each text."""
    h, doc = shingles(words(data, offs, SPACE_WORDS), SHINGLE)
    tok = (h >> np.uint64(16)).astype(np.int64)
    turn = np.lexsort((tok, doc))
    tok, doc = tok[turn], doc[turn]
    if len(tok):
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])
        tok, doc = tok[new], doc[new]
    n = np.bincount(doc, minlength=len(offs) - 1)
    a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(tok.astype(np.uint64) + np.uint64(0x1234567)))])
    ends = np.cumsum(n)
    digest = mix64((a[ends] - a[ends - n]) ^ mix64(n.astype(np.uint64))).astype(np.int64)
    return tok, doc, n, digest


def _hot(tok: np.ndarray, doc: np.ndarray, digest: np.ndarray) -> list[int]:
    """Tokens of HOT different sets at least."""
    fresh = np.zeros(len(digest), bool)
    fresh[np.unique(digest, return_index=True)[1]] = True
    own = np.sort(tok[fresh[doc]])
    return own[HOT - 1 :][own[HOT - 1 :] == own[: len(own) - HOT + 1]].tolist() if len(own) >= HOT else []


def class_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set (digest; null without tokens), hot (tokens that are frequent around this row, once a batch), and the place
    of each row of placed() documents."""

    def run(batches):
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            ns, sets, hot = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], set()
            for a, b in slices(offs):
                tok, doc, n, digest = token_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                ns.append(n)
                sets.append(digest)
                hot.update(_hot(tok, doc, digest))
            n = np.concatenate(ns).astype(np.int64)
            listed = pa.array([sorted(hot)] + [None] * (len(n) - 1) if len(n) else [], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(np.concatenate(sets), mask=n == 0), listed, batch.column(FILE), batch.column(ROW)], names=["doc_id", "n_shingles", "set", "hot", FILE, ROW])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", FILE, ROW), run, f"doc_id long, n_shingles long, set long, hot array<long>, {FILE} long, {ROW} long")


def hot_tokens(classes: DataFrame) -> np.ndarray:
    """The tokens that are hot in most batches, HOT_TOKENS at most (8 bytes each); the rest goes through the buckets."""
    top = classes.select(F.explode("hot").alias("t")).groupBy("t").count().orderBy(F.desc("count"), "t").limit(HOT_TOKENS)
    return np.sort(np.array([r.t for r in top.select("t").collect()], np.int64))


def _blocks(key: np.ndarray, group: np.ndarray, sets: np.ndarray, tok: np.ndarray, extra: np.ndarray | None):
    """Packed rows by key: runs of tokens of one set. ``group`` numbers the sets; rows are sorted by key and group here."""
    turn = np.lexsort((group, key))
    key, group, sets, tok = key[turn], group[turn], sets[turn], tok[turn]
    extra = extra[turn] if extra is not None else None
    cut = np.flatnonzero(np.diff(key)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
        if a == b:
            continue
        g = group[a:b]
        first = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1])
        size = np.diff(np.append(first, b - a))
        many = -(-size // 255)  # a run counts to 255
        at = np.repeat(np.arange(len(first)), many)
        runs = np.zeros(len(at), _RUN)
        runs["set"] = sets[a:b][first][at]
        left = np.repeat(size, many) - 255 * (np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many))
        runs["k"] = np.minimum(left, 255)
        yield int(key[a]), runs.tobytes(), _pack48(tok[a:b]), b"" if extra is None else extra[a:b].astype("<u2").tobytes(), b""


def _open(rows: pa.Table):
    """Runs, the run of each token, tokens and extra column of packed rows."""
    runs = np.concatenate([np.frombuffer(r.as_buffer(), _RUN) for r in rows.column("runs")])
    tok = np.concatenate([_unpack48(r.as_buffer()) for r in rows.column("tok")])
    extra = np.concatenate([np.frombuffer(r.as_buffer(), "<u2") for r in rows.column("extra")])
    return runs, np.repeat(np.arange(len(runs), dtype=np.int32), runs["k"]), tok, extra


def _sizes(rows: pa.Table) -> np.ndarray:
    """The sizes in packed rows, one of each set, by set."""
    every = np.concatenate([np.frombuffer(r.as_buffer(), _SIZE) for r in rows.column("sizes")])
    return every[np.unique(every["set"], return_index=True)[1]]


_PACKED = "key int, runs binary, tok binary, extra binary, sizes binary"


def _batch(rows: list[tuple[int, bytes, bytes, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "runs", "tok", "extra", "sizes"])


def _bucket(sets: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of sets; those of tokens are the token modulo their number, and both are told apart by sign."""
    return -1 - (mix64(sets.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _deal(docs: DataFrame, buckets: int, parts: int, hot: np.ndarray, first: bool, only: Places | None = None) -> DataFrame:
    """The first tokens of all documents by bucket of tokens, and sizes by bucket of sets; or the other tokens, and hot ones by
    bucket of sets. A set that a block holds twice is in it once. ``only``: the rows that take part."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        held, sizes, total, seen = [], [], 0, set()
        hot = shared.value

        def flush():
            tok, sets, known = (np.concatenate(x) for x in zip(*held, strict=True))
            _, group = np.unique(sets, return_inverse=True)
            cold = ~known
            yield _batch(list(_blocks(tok[cold] % buckets, group[cold], sets[cold], tok[cold], None)))
            if known.any():
                own = sets[known]
                yield _batch(list(_blocks(_bucket(own, parts), group[known], own, tok[known], np.full(len(own), MOST))))
            if first:
                size = np.concatenate(sizes)
                key = _bucket(size["set"], parts)
                yield _batch([(k, b"", b"", b"", size[key == k].tobytes()) for k in np.unique(key).tolist()])

        for batch in batches:
            batch = batch if only is None else only.of(batch)
            data, offs = text_buffers(batch.column("text"))
            for a, b in slices(offs):
                tok, doc, n, digest = token_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                fresh = np.zeros(b - a, bool)
                for i, d in enumerate(digest.tolist()):
                    if n[i] and d not in seen:
                        seen.add(d)
                        fresh[i] = True
                known = hot[np.minimum(np.searchsorted(hot, tok), len(hot) - 1)] == tok if len(hot) else np.zeros(len(tok), bool)
                early = ((tok >> 45) < FIRST) & ~known
                keep = fresh[doc] & (early if first else ~early)
                if first and fresh.any():
                    size = np.zeros(int(fresh.sum()), _SIZE)
                    size["set"], size["n"], size["first"] = digest[fresh], n[fresh], np.bincount(doc[keep], minlength=b - a)[fresh]
                    sizes.append(size)
                    held.append((tok[keep], digest[doc[keep]], known[keep]))
                elif keep.any():
                    held.append((tok[keep], digest[doc[keep]], known[keep]))
                total += int(keep.sum())
                if total >= FLUSH_TOKENS:
                    yield from flush()
                    held, sizes, total, seen = [], [], 0, set()
        if held:
            yield from flush()

    return map_arrow(docs.select("text", FILE, ROW) if only is not None else docs.select("text"), run, _PACKED)


def _shared_tokens(packed: pa.Table, parts: int) -> pa.Table:
    """For one bucket of tokens: those of two sets at least, with the number of sets (to MOST), by bucket of sets."""
    runs, run, tok, _ = _open(packed)
    # most tokens are there once: they go before anything else is sorted
    turn = np.argsort(tok, kind="stable")
    tok = tok[turn]
    some = np.zeros(len(tok), bool)
    some[1:] = tok[1:] == tok[:-1]
    some[:-1] |= some[1:]
    turn, tok = turn[some], tok[some]
    run = run[turn]
    sets = runs["set"][run]
    turn = np.lexsort((sets, tok))
    sets, tok = sets[turn], tok[turn]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (sets[1:] != sets[:-1])
    sets, tok = sets[new], tok[new]
    first = np.concatenate([[0], np.flatnonzero(np.diff(tok)) + 1])[: len(tok)]
    count = np.repeat(np.diff(np.append(first, len(tok))), np.diff(np.append(first, len(tok))))
    many = count >= 2
    sets, tok, count = sets[many], tok[many], np.minimum(count[many], MOST)
    if not len(tok):
        return pa.Table.from_batches([_batch([])])
    _, group = np.unique(sets, return_inverse=True)
    return pa.Table.from_batches([_batch(list(_blocks(_bucket(sets, parts), group, sets, tok, count)))])


def _possible(packed: pa.Table) -> pa.Table:
    """For one bucket of sets, after the first tokens: those of which no more than a fifth are known to be unshared."""
    runs, sizes = np.concatenate([np.frombuffer(r.as_buffer(), _RUN) for r in packed.column("runs")]), _sizes(packed)
    shared = np.bincount(np.searchsorted(sizes["set"], runs["set"]), runs["k"], len(sizes)).astype(np.int64)
    return pa.table({"set": sizes["set"][5 * (sizes["first"].astype(np.int64) - shared) <= sizes["n"]]})


def signatures(n: int, tok: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Signatures of a set of n tokens, of which ``tok`` are in ``count`` >= 2 sets each and the others in none else."""
    order = np.lexsort((tok, count))
    tok, rare = tok[order], count[order] <= RARE
    need = n // 5 + 1 - (n - len(tok))
    sub = tok % SUBCLASSES
    frequent = np.flatnonzero(~rare)
    worth = np.ones(len(tok), np.int64)
    if len(frequent):
        _, first = np.unique(sub[frequent], return_index=True)
        worth[frequent[first]] = 0
    reach = np.cumsum(worth)
    enough = len(tok) > 0 and reach[-1] >= need
    stop = int(np.searchsorted(reach, need)) + 1 if enough else len(tok)
    alone = tok[:stop][rare[:stop]]
    if not enough:  # the usual prefix of single tokens, beside the combinations
        alone = np.union1d(alone, tok[:need])
    made = [mix64(alone.astype(np.uint64) + np.uint64(0x5000000000000000))]
    pick = frequent[frequent < stop]
    pick = pick[np.argsort(sub[pick], kind="stable")]
    cut = np.flatnonzero(np.diff(sub[pick])) + 1
    for own in np.split(tok[pick], cut):
        if len(own) > 1:
            own = np.sort(own).astype(np.uint64)
            i, j = np.triu_indices(len(own), 1)
            made.append(mix64(own[i] * np.uint64(0x9E3779B97F4A7C15) + own[j]))
    return np.concatenate(made).view(np.int64)


#: Bits of the parity sketch: a pair differs in at least as many tokens as its sketches in bits.
SKETCH = tuple(f"q{i}" for i in range(8))
_SETS = "set long, n long, s long, tok binary, sigs array<long>, " + ", ".join(f"{q} long" for q in SKETCH)


def _sketch(tok: np.ndarray) -> list[int]:
    """Parities of the numbers of tokens by hash, 64 to a word."""
    width = 64 * len(SKETCH)
    odd = np.bincount((mix64(tok.astype(np.uint64)) % np.uint64(width)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).tolist()


def _candidates(packed: pa.Table) -> pa.Table:
    """For one bucket of sets: those that can link, with their shared tokens in order and their signatures."""
    runs, run, tok, count = _open(packed)
    turn = np.lexsort((tok, runs["set"][run]))
    run, tok, count = run[turn], tok[turn], count[turn]
    sets, sizes = runs["set"][run], _sizes(packed)
    n = sizes["n"][np.searchsorted(sizes["set"], sets)].astype(np.int64)
    # hot tokens come once for each block that held the set
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (sets[1:] != sets[:-1])
    tok, count, sets, n = tok[new], count[new], sets[new], n[new]
    first = np.concatenate([[0], np.flatnonzero(np.diff(sets)) + 1, [len(sets)]]) if len(sets) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if 5 * (b - a) >= 4 * int(n[a]):
            rows.append((int(sets[a]), int(n[a]), b - a, _pack48(tok[a:b]), signatures(int(n[a]), tok[a:b], count[a:b]), *_sketch(tok[a:b])))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * len(SKETCH))
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["set", "n", "s", "tok", "sigs", *SKETCH])


def _returned(table: pa.Table) -> pa.Table:
    give_back()
    return table


def placed(docs: DataFrame, stored: bool) -> DataFrame:
    """docs with the place of each row: its file (a hash of the path) and where it stands in it. Documents that are not read straight
    from Parquet (``stored``) are written first."""
    docs = docs if stored else saved(docs, "jaccard-docs")
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


class Places:
    """Rows by their place, as one small file of bits for each CHUNK rows of a file in the shared folder. A task opens those of the
    files that it reads itself, so no row is shuffled to be found and nothing is sent to all, however many rows there are and
    whatever their ids."""

    def __init__(self, rows: DataFrame):
        self.folder, self.chunk = work_dir(rows.sparkSession, "jaccard-places"), CHUNK
        folder, size = self.folder, self.chunk

        def write(batches):
            system, root = fs.FileSystem.from_uri(folder)
            system.create_dir(root, recursive=True)
            for batch in batches:
                for file, chunk, at in zip(*(batch.column(c) for c in (FILE, "chunk", "at")), strict=True):
                    bits = np.zeros(size, bool)
                    bits[at.values.to_numpy()] = True
                    temporary = f"{root}/.{uuid.uuid4().hex}"
                    with system.open_output_stream(temporary) as sink:
                        sink.write(np.packbits(bits).tobytes())
                    system.move(temporary, f"{root}/{file.as_py()}.{chunk.as_py()}")
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], names=["done"])

        # at most ``size`` places in a group
        by = rows.select(FILE, F.expr(f"{ROW} DIV {size}").alias("chunk"), (F.col(ROW) % size).cast("int").alias("at")).groupBy(FILE, "chunk").agg(F.collect_set("at").alias("at"))
        map_arrow(by, write, "done long").write.format("noop").mode("overwrite").save()
        self._known: dict[tuple[int, int], np.ndarray] = {}

    def _bits(self, file: int, chunk: int) -> np.ndarray:
        key = (file, chunk)
        if key not in self._known:
            if len(self._known) >= 8:  # tasks read file after file
                self._known.clear()
            system, root = fs.FileSystem.from_uri(self.folder)
            path = f"{root}/{file}.{chunk}"
            there = system.get_file_info(path).type != fs.FileType.NotFound
            self._known[key] = np.frombuffer(system.open_input_file(path).readall() if there else bytes(self.chunk // 8), np.uint8)
        return self._known[key]

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of a batch that are among the places."""
        file, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in (FILE, ROW))
        keep = np.zeros(len(row), bool)
        chunk, at = row // self.chunk, row % self.chunk
        cut = np.flatnonzero((np.diff(file) != 0) | (np.diff(chunk) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(row)], strict=True):
            if a < b:
                bits = self._bits(int(file[a]), int(chunk[a]))
                keep[a:b] = (bits[at[a:b] >> 3] >> (7 - (at[a:b] & 7)).astype(np.uint8)) & 1 == 1
        return batch.filter(pa.array(keep))

    def rows(self, docs: DataFrame, columns: list[str]) -> DataFrame:
        """These columns of the rows of placed() documents that are among the places."""
        schema = T.StructType([docs.schema[c] for c in columns])
        return map_arrow(docs.select(*columns, FILE, ROW), lambda batches: (self.of(b).select(columns) for b in batches), schema)


def candidate_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """set, n, s, tok, sigs of the classes that can link (saved), for placed() documents and their class table."""
    spark = docs.sparkSession
    tokens = int(classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0])
    partitions, hot = int(spark.conf.get("spark.sql.shuffle.partitions")), hot_tokens(classes)
    parts = max(partitions, -(-tokens // BUCKET_TOKENS))

    def counted(eighths: int, only: Places | None = None) -> DataFrame:
        dealt = _deal(docs, -(-parts * eighths // 8), parts, hot, eighths == FIRST, only).repartition(parts, "key")
        # what lies in buckets of sets already passes
        made = saved(dealt.groupBy("key").applyInArrow(lambda t: t if t.column("key")[0].as_py() < 0 else _returned(_shared_tokens(t, parts)), _PACKED), "jaccard-counts")
        release(spark)
        return made

    first = counted(FIRST)
    possible = saved(first.select("key", "runs", "sizes").repartition(parts, "key").groupBy("key").applyInArrow(_possible, "set long"), "jaccard-possible")
    rest = counted(8 - FIRST, Places(classes.select("set", FILE, ROW).join(possible, "set")))
    found = saved(first.union(rest).repartition(parts, "key").groupBy("key").applyInArrow(_candidates, _SETS), "jaccard-sets")
    discard(first, rest, possible)
    release(spark)
    return found


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, link) for pairs of classes (a, b): the exact test on their tokens."""
    own = sets.select("set", "n", "tok")
    left = pairs.select("a", "b").join(own.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("tok").alias("ta")), "a")
    both = left.join(own.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("tok").alias("tb")), "b")

    def run(batches):
        for batch in batches:
            link = []
            for k in range(batch.num_rows):
                na, ta, nb, tb = (batch.column(c)[k] for c in ("na", "ta", "nb", "tb"))
                x, y = _unpack48(ta.as_buffer()), _unpack48(tb.as_buffer())
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                link.append(9 * int((y[at] == x).sum()) >= 4 * (na.as_py() + nb.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(link, pa.bool_())], names=["a", "b", "link"])

    return map_arrow(both.select("a", "b", "na", "ta", "nb", "tb"), run, "a long, b long, link boolean")


def _roots(edges: DataFrame) -> DataFrame:
    """node -> root for edges (u, v) of differing nodes: each node points to its least lower neighbour, then to the end of its path."""
    both = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    parent = saved(both.groupBy("node").agg(F.min("root").alias("root")), "jaccard-parents")
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = saved(parent.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "jaccard-parents")
        discard(parent)
        if jumped.where("moved").isEmpty():
            return jumped.select("node", "root")
        parent = saved(jumped.select("node", "root"), "jaccard-parents")
        discard(jumped)


def join_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (set, comp) after the links (a, b), saved. Contracts until no link crosses components."""
    while True:
        left = links.join(labels.select(F.col("set").alias("a"), F.col("comp").alias("u")), "a")
        across = saved(left.join(labels.select(F.col("set").alias("b"), F.col("comp").alias("v")), "b").where("u != v").select("u", "v").distinct(), "jaccard-across")
        if across.isEmpty():
            return labels
        roots = _roots(across).withColumnRenamed("node", "comp")
        renamed = saved(labels.join(roots, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root").select(*labels.columns), "jaccard-labels")
        discard(across, labels)
        labels = renamed


def _fit(a: str, b: str):
    """Whether sizes, shared tokens and sketches allow a link: linked sets differ in at most a ninth of their tokens, in
    which are all tokens that only one set has, and one more for each bit in which the sketches differ."""
    bits = " + ".join(f"bit_count({a}.{q} ^ {b}.{q})" for q in SKETCH)
    alone = f"{a}.n - {a}.s + {b}.n - {b}.s"
    return F.expr(f"5 * least({a}.n, {b}.n) >= 4 * greatest({a}.n, {b}.n) AND 9 * ({alone}) <= {a}.n + {b}.n AND 9 * ({alone} + {bits}) <= {a}.n + {b}.n")


def components(sets: DataFrame) -> DataFrame:
    """set, comp (and sizes, sketch) for the classes of candidate_sets()."""
    labels = saved(sets.select("set", F.col("set").alias("comp"), "n", "s", *SKETCH), "jaccard-labels")
    # the first pivots need no labels: they are found as the signatures are counted
    every = saved(sets.select("set", (F.col("n") - F.col("s")).alias("own"), F.explode("sigs").alias("sig")), "jaccard-postings")
    twice = every.groupBy("sig").agg(F.count("*").alias("k"), F.min(F.struct("own", "set")).alias("p")).where("k > 1").select("sig", "k", F.col("p.set").alias("pivot"))
    postings = saved(every.drop("own").join(twice, "sig"), "jaccard-postings")
    discard(every)
    checked: list[DataFrame] = []
    used: list[DataFrame] = []

    def settle(pairs: DataFrame) -> None:
        """Verify the pairs that are new and join their components."""
        nonlocal labels
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for old in checked:
            pairs = pairs.join(old.select("a", "b"), ["a", "b"], "left_anti")
        found = saved(verify(pairs, sets), "jaccard-verified")
        checked.append(found)
        if not found.isEmpty():
            labels = join_components(labels, found.where("link"))

    # every class is a component of its own still: pairs are counted before sizes and sketches are looked up, once a pair
    met = postings.where("set != pivot").groupBy("set", "pivot").agg(F.count("*").alias("k"))
    of_pivot = labels.select(*[F.col(c).alias("pivot" if c == "set" else c) for c in labels.columns])
    met = met.join(labels, "set").alias("x").join(of_pivot.alias("p"), "pivot").where(_fit("x", "p"))
    settle(met.groupBy(F.col("set").alias("a")).agg(F.max_by("pivot", F.struct("k", "pivot")).alias("b")).select("a", "b"))

    for turn in range(1, PIVOT_ROUNDS + 1):
        open_ = postings.join(labels.select("set", "comp"), "set").groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("sig")
        left = saved(postings.join(open_, "sig"), "jaccard-postings")
        discard(postings)
        postings = left
        if postings.isEmpty():
            break
        now = postings.join(labels, "set")
        pairs = []
        if turn < PIVOT_ROUNDS:
            fresh = reduce(lambda x, y: x.join(y, ["sig", "set"], "left_anti"), used, now.where("set != pivot"))
            pivot = fresh.groupBy("sig").agg(F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "set")).alias("p")).select("sig", F.col("p.set").alias("set"))
            used.append(saved(pivot, "jaccard-pivots"))
            p = used[-1].join(labels, "set").alias("p")
            at = now.alias("x").join(p, "sig").where("x.set != p.set AND x.comp != p.comp").where(_fit("x", "p"))
            pairs.append(at.select(F.col("x.set").alias("a"), F.col("p.set").alias("b")).distinct())
        x = (now.where(F.col("k") <= SMALL) if turn < PIVOT_ROUNDS else now).alias("x")
        y = now.alias("y")
        pairs.append(x.join(y, "sig").where("x.set < y.set AND x.comp != y.comp").where(_fit("x", "y")).select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct())
        settle(reduce(DataFrame.union, pairs))
    discard(postings, *used, *checked)
    return labels


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The class of every row, and set, n_shingles, comp, component_id of every class (both saved)."""
    classes = saved(class_table(docs), "jaccard-classes")
    sets = candidate_sets(docs, classes)
    labels = components(sets)
    least = classes.where("set IS NOT NULL").groupBy("set", "n_shingles").agg(F.min("doc_id").alias("least"))
    of_set = least.join(labels.select("set", "comp"), "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    of_comp = of_set.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = saved(of_set.join(of_comp, "comp").select("set", "n_shingles", "comp", "component_id"), "jaccard-named")
    discard(sets, labels)
    release(docs.sparkSession)
    return classes.drop("hot"), named


def link_components(docs: DataFrame, stored: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every document. ``stored``: docs is read straight from Parquet."""
    classes, named = _linked(placed(docs, stored))
    found = classes.join(named, ["set", "n_shingles"], "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, stored: bool = False) -> DataFrame:
    """One row of each component, the one with the least id (the first in its file, of rows that share it; null ids last), and all rows
    without words; with the columns of docs. ``stored``: docs is read straight from Parquet."""
    rows = placed(docs, stored)
    classes, named = _linked(rows)
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", FILE, ROW)
    of_set = classes.where("set IS NOT NULL").groupBy("set", "n_shingles").agg(F.min(place).alias("best"))
    best = of_set.join(named, ["set", "n_shingles"]).groupBy("comp").agg(F.min("best").alias("best"))
    kept = Places(best.select(f"best.{FILE}", f"best.{ROW}").unionByName(classes.where("set IS NULL").select(FILE, ROW)))
    return kept.rows(rows, docs.columns)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"), stored=True)


QUERIES = {"op3_jaccard": op3_jaccard}

_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLE = {
    "op3_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda p: array_to_string(ws[p : p + {SHINGLE - 1}], ' ')) END)) AS g
      FROM d WHERE len(ws) > 0),
c AS (SELECT row_number() OVER () AS c, g, len(g) AS n, min(doc_id) AS least FROM s GROUP BY g),
t AS (SELECT c, n, unnest(g) AS w FROM c),
k AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.w = b.w AND a.c < b.c GROUP BY ALL),
l AS (SELECT a, b FROM k WHERE 100 * k >= 80 * (na + nb - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT c, c FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT r.a AS c, min(c.least) AS component_id FROM r JOIN c ON r.b = c.c GROUP BY r.a)
SELECT s.doc_id, c.n::BIGINT AS n_shingles, m.component_id FROM s JOIN c ON s.g = c.g JOIN m ON m.c = c.c
UNION ALL SELECT doc_id, 0::BIGINT, doc_id FROM d WHERE len(ws) = 0
"""
}

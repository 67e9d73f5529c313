"""Token ids in files of fixed-width bit fields.

Every id takes the fewest bits that hold the vocabulary. A file is a magic, blocks of ``BLOCK_IDS`` ids packed from
the low bit on, and an index (document ids and lengths, offsets of the blocks) found from its last 48 bytes; blocks
are unpacked by numpy, alone or in runs, so that any document or range of ids is read without the rest.

Files are written by the executors through pyarrow's filesystems under the shared folder, one for each range of
document ids; a retried task writes the same bytes under a temporary name and moves them into place.

Defined results: null text is empty and still has its end id; null ids come first; rows of one id follow each other in
the order of their ids' bytes; an empty table makes no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import map_arrow, saved, slices, table, text_buffers, work_dir

MAGIC = b"TMIDS001"
FOOTER = struct.Struct("<QQQII8sQ")
BLOCK_IDS = 1 << 16
END_ID = 2
#: Bytes of text that are split in one step.
STEP_BYTES = 4 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = np.unpackbits(ids.astype("<u4").view(np.uint8), bitorder="little").reshape(-1, 32)[:, :bits]
    return np.packbits(fields.reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    fields = np.zeros((n, 32), np.uint8)
    fields[:, :bits] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(fields.reshape(-1), bitorder="little").view("<u4").astype(np.uint32)


class Writer:
    """Streams documents into one file; holds one block and 17 bytes a document."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.rest, self.held = [], 0
        self.doc_ids, self.lengths, self.offsets = [], [], [len(MAGIC)]
        self.total = 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.total += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            every = np.concatenate(self.rest)
            full = len(every) // self.block_ids * self.block_ids
            for a in range(0, full, self.block_ids):
                self._block(every[a : a + self.block_ids])
            self.rest, self.held = [every[full:]], len(every) - full

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.sink.write(raw)
        self.offsets.append(self.offsets[-1] + len(raw))

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        for part in (np.array([d or 0 for d in self.doc_ids], "<i8"), np.array(self.lengths, "<u8"), null, np.array(self.offsets, "<u8")):
            self.sink.write(part.tobytes())
        self.sink.write(FOOTER.pack(self.offsets[-1], len(self.doc_ids), self.total, self.bits, self.block_ids, MAGIC, len(self.offsets)))
        self.sink.close()


class Reader:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        index, docs, self.total, self.bits, self.block_ids, magic, offsets = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(index)
        raw = source.read(size - FOOTER.size - index)
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.lengths = np.frombuffer(raw, "<u8", docs, 8 * docs).astype(np.int64)
        self.null = np.frombuffer(raw, np.uint8, docs, 16 * docs).astype(bool)
        self.offsets = np.frombuffer(raw[17 * docs :], "<u8", offsets).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, (stop - 1) // self.block_ids + 1
        self.source.seek(int(self.offsets[a]))
        raw = self.source.read(int(self.offsets[b] - self.offsets[a]))
        made, base = [], int(self.offsets[a])
        for k in range(a, b):
            n = min(self.block_ids, self.total - k * self.block_ids)
            made.append(unpack(raw[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base], self.bits, n))
        return np.concatenate(made)[start - a * self.block_ids : stop - a * self.block_ids]

    def documents(self, batch_ids: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of every document, reading about ``batch_ids`` ids at a time."""
        i, n = 0, len(self.lengths)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + batch_ids, "right")) - 1)
            run = self.ids(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                a = int(self.starts[k] - self.starts[i])
                yield None if self.null[k] else int(self.doc_ids[k]), int(self.starts[k]), run[a : a + int(self.lengths[k])]
            i = j


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# fixed values: the normaliser and the splitter that the vectorised encoder follows, as tokenizer files state them
_SPLITS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
# kinds of the first 256 code points in that splitter
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_KIND = np.array([_SPACE if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else _NUMBER if chr(c).isnumeric() else _LETTER if chr(c).isalpha() else _OTHER for c in range(256)], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def follows_splits(path: str) -> bool:
    """Whether a tokenizer file has the normaliser, the splitter and the kind of model that the vectorised encoder follows."""
    tool = json.loads(_tokenizer(path).to_str())
    model = tool["model"]
    simple = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
    return simple and (tool["normalizer"], tool["pre_tokenizer"]) == _SPLITS and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in tool["added_tokens"])


def _latin(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of the first 256 code points as one byte each, and the offsets of its texts."""
    lead = data >= 0xC2
    if not lead.any():
        return data, offs
    up = np.zeros(len(data), np.uint8)
    up[1:] = (data[:-1] == 0xC3) * np.uint8(0x40)
    stay = ~lead
    return (data + up)[stay], np.concatenate([[0], np.cumsum(stay)])[offs]


def latin_parts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes without white space, offsets of the splitter's parts in them, parts of each text."""
    low = _LOWER[data]
    kind = _KIND[low]
    n = len(low)
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    bounds = offs[1:-1]
    new[bounds[bounds < n]] = True
    # 's 't 'm 'd 're 've 'll: where an apostrophe is a run of its own and a letter follows at once
    quote = np.flatnonzero((low == 39) & new)
    quote = quote[quote + 1 < n]
    quote = quote[new[quote + 1] & (kind[quote + 1] == _LETTER)]
    if len(quote):
        last = offs[np.searchsorted(offs, quote, "right")]  # end of the text
        quote, last = quote[quote + 1 < last], last[quote + 1 < last]
        one, two = low[quote + 1], low[np.minimum(quote + 2, n - 1)]
        pair = (quote + 2 < last) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        size = np.where(single, 2, np.where(pair, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        new[quote + 1] = False
        after = quote + size
        after = after[after < n]
        new[after] = True
    solid = kind != _SPACE
    starts = np.flatnonzero(new & solid)
    place = np.concatenate([[0], np.cumsum(solid)])
    counts = np.diff(np.searchsorted(starts, offs))
    return low[solid], np.append(place[starts], place[-1]), counts


def blank_pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 without ASCII white space, offsets of the pieces between it, pieces of each text."""
    solid = ~_BLANK[data]
    new = solid.copy()
    new[1:] &= ~solid[:-1]
    first = offs[:-1]
    first = first[first < len(data)]
    new[first] = solid[first]
    starts = np.flatnonzero(new)
    place = np.concatenate([[0], np.cumsum(solid)])
    return data[solid], np.append(place[starts], place[-1]), np.diff(np.searchsorted(starts, offs))


class Encoder:
    """Ids of whole texts. Of a vocabulary that follows _SPLITS every distinct part of some texts is encoded once, and kept
    for later ones (up to ``most`` parts); others go to the library text by text.

    Texts of the first 256 code points without a special token's opening are lower-cased and split by numpy, their new
    parts go to the library's model. Other texts are cut at ASCII white space, which no token spans, and new pieces go
    to the library's whole encoder."""

    def __init__(self, path: str, split: bool | None = None, most: int = 400_000):
        self.tool, self.most = _tokenizer(path), most
        self.split = follows_splits(path) if split is None else split
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known: tuple[dict[bytes, int], dict[bytes, int]] = {}, {}
        self.first, self.flat = array("q", [0]), array("I")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, at[1:-1]) if texts else []

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts in them. Null is empty."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if self.split:
            data, offs = text_buffers(texts)
            for a, b in slices(offs, STEP_BYTES):
                got, n = self._slice(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                ids.append(got)
                counts.append(n)
        else:
            for e in self.tool.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False):
                ids.append(np.array(e.ids, np.uint32))
                counts.append(np.array([len(e.ids)]))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _slice(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.flatnonzero(data >= 0xC4)
        opens = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        odd = np.zeros(len(offs) - 1, bool)
        odd[np.searchsorted(offs, np.concatenate([wide, opens]), "right") - 1] = True
        if not odd.any():
            return self._gather(*latin_parts(*_latin(data, offs)), 0)
        size = np.diff(offs)
        counts, made = np.zeros(len(odd), np.int64), []
        for kind, rows in ((0, ~odd), (1, odd)):
            own, at = data[np.repeat(rows, size)], np.concatenate([[0], np.cumsum(size[rows])])
            ids, counts[rows] = self._gather(*(blank_pieces(own, at) if kind else latin_parts(*_latin(own, at))), kind)
            made.append(ids)
        # back in the order of the texts
        ids = np.empty(sum(map(len, made)), np.uint32)
        ids[np.repeat(~odd, counts)], ids[np.repeat(odd, counts)] = made
        return ids, counts

    def _gather(self, data: np.ndarray, place: np.ndarray, counts: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts of some texts (and how many each text has): every distinct part is looked up once."""
        if len(place) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(place) - 1, [None, pa.py_buffer(np.ascontiguousarray(place, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        if len(self.first) > self.most:
            self._forget()
        known, learn, own = self.known[kind], (self._part, self._piece)[kind], parts.dictionary.to_pylist()
        at = list(map(known.get, own))
        for i, k in enumerate(at):
            if k is None:
                at[i] = known[own[i]] = len(self.first) - 1
                self.flat.extend(learn(own[i]))
                self.first.append(len(self.flat))
        which = np.array(at, np.int64)[parts.indices.to_numpy()]
        first = np.frombuffer(self.first, np.int64)
        start, n = first[which], first[which + 1] - first[which]
        ends = np.cumsum(n)
        ids = np.frombuffer(self.flat, np.uint32)[np.arange(ends[-1]) + np.repeat(start - ends + n, n)] if ends[-1] else np.zeros(0, np.uint32)
        text = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(np.concatenate([[0], ends])[text])

    def _part(self, part: bytes) -> list[int]:
        # ASCII letters and digits stand for themselves
        word = part.decode() if part.isalnum() else part.decode("latin-1").encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tool.model.tokenize(word)]

    def _piece(self, piece: bytes) -> list[int]:
        return self.tool.encode(piece.decode(), add_special_tokens=False).ids


def write_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Encode ``text`` and write files in ascending doc_id. Returns the manifest: part, path, n_docs, n_ids, one row a file."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = files or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / files for i in range(1, files)], 20 * files).alias("q")).first().q if files > 1 else []
    bounds = np.unique(np.array([c for c in cuts or [] if c is not None], np.int64))
    vocabulary = _tokenizer(tokenizer).get_vocab_size(with_added_tokens=True)
    bits = bits_for(max(vocabulary, end_id + 1))
    kind = "<u2" if bits <= 16 else "<u4"
    split = follows_splits(tokenizer)

    def encode(batches):
        encoder, squeeze = Encoder(tokenizer, split), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("doc_id")
            part = np.array([0 if i is None else 1 + int(np.searchsorted(bounds, i, "right")) for i in ids.to_pylist()], np.int32)
            found, at = encoder.encode_column(batch.column("text"))
            # every text's ids and the end id, in one array
            every = np.full(len(found) + len(ids), end_id, kind)
            every[np.arange(len(found)) + np.repeat(np.arange(len(ids)), np.diff(at))] = found
            ends = at + np.arange(len(at))
            made = [squeeze.compress(every[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part), ids, pa.array(made, pa.binary())], names=["part", "doc_id", "ids"])
        del encoder
        _tokenizer.cache_clear()  # the vocabulary would stay with the process

    def write(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        expand, now, writer, temporary, done = zstandard.ZstdDecompressor(), None, None, "", []

        def finish():
            writer.close()
            path = f"{root}/part-{now:08d}.tmids"
            system.move(temporary, path)
            done.append((now, f"part-{now:08d}.tmids", len(writer.lengths), writer.total))

        for batch in batches:
            for part, doc_id, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                if part != now:
                    if writer:
                        finish()
                    now, temporary = part, f"{root}/.{part:08d}-{uuid.uuid4().hex}"
                    writer = Writer(system.open_output_stream(temporary), bits)
                writer.add(doc_id, np.frombuffer(expand.decompress(raw), kind))
        if writer:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "path", "n_docs", "n_ids"])

    encoded = map_arrow(rows, encode, "part int, doc_id long, ids binary")
    placed = encoded.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "doc_id", "ids")
    return saved(map_arrow(placed, write, "part int, path string, n_docs long, n_ids long"), "tokens-manifest")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = manifest.sparkSession
    # one row a file; the files are few (four a shuffle partition unless asked otherwise)
    listed = sorted((r.part, r.path, r.n_ids) for r in manifest.select("part", "path", "n_ids").collect())
    starts, total = [], 0
    for part, path, n in listed:
        starts.append((part, path, total))
        total += n
    todo = spark.createDataFrame(starts, "part int, path string, start long")
    if starts:
        todo = todo.repartition(len(starts))

    def read(batches):
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{path}") as source:
                    rows = [(d, base + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in Reader(source).documents()]
                for a in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 50_000], strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(todo, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files of docs to a new folder in the shared one and return the digest of what is read back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = work_dir(docs.sparkSession, "tokens")
    return read_files(write_files(docs, str(tokenizer), folder), folder)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))


QUERIES = {"op4_tokens": op4_tokens}

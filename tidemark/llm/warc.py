"""WARC derivative builder: metadata and plain-text conversion records out of response records.

A response is a WARC/1.0 record whose block is an HTTP message. Each gives a metadata record (WARC fields: status, every
HTTP header of the source, title, links) and a conversion record (its visible text). Both carry WARC-Refers-To with the
response's id, its target and date, its other WARC headers (as WARC-Source-*), and digests of their own. Ids are
derived from the source's id, so a retried task makes the same records.

Defined results: null html is an empty body; a null url leaves WARC-Target-URI out; null page ids count into the id as
nothing; pages have no date, so their records take the fixed one of ``PAGE_DATE``; repeated pages give records of equal
ids; bodies are decoded whole (chunks, gzip, zlib and raw deflate, to BODY_BYTES), undecodable bytes become U+FFFD, unknown
charsets count as UTF-8; a record whose length is no number has an empty block; records that are no response give nothing; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.extraction import TAG, parse
from tidemark.llm.shared import map_arrow, saved, table

CRLF = b"\r\n"
#: Bytes that a compressed body may expand to; one beyond stays as it was sent.
BODY_BYTES = 1 << 28
#: Encodings of Python that no page is in.
NO_CHARSETS = frozenset("idna punycode undefined unicode_escape raw_unicode_escape".split())
PAGE_DATE = "2024-01-01T00:00:00Z"
_TITLE, _TITLE_END = re.compile(r"<title\b", re.I), re.compile(r"</title", re.I)
_ANCHOR = re.compile(r"<a\b", re.I)
_HREF = re.compile(r"""\bhref\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
#: WARC headers that a derivative has of its own.
_OWN = frozenset("warc-type warc-record-id content-length content-type warc-block-digest warc-refers-to".split())


class Record(NamedTuple):
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def dump(self) -> bytes:
        return CRLF.join([b"WARC/1.0", *[f"{k}: {v}".encode() for k, v in self.headers], b"", self.block]) + CRLF * 2


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(seed: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(seed.encode()).digest()[:16], version=5)}>"


def _fields(raw: bytes) -> list[tuple[str, str]]:
    """Header lines; a line that begins with white space continues the last."""
    found: list[tuple[str, list[str]]] = []
    for line in raw.split(b"\n"):
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and found:
            found[-1][1].append(text.strip())
        elif ":" in text:
            k, _, v = text.partition(":")
            found.append((k.strip(), [v.strip()]))
    return [(k, " ".join(v)) for k, v in found]


def read_records(stream) -> Iterator[Record]:
    """Records of an uncompressed WARC stream (anything with readline and read), one at a time."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = []
        while (line := stream.readline()) and line.strip():
            head.append(line)
        headers = _fields(b"".join(head))
        size = next((v for k, v in headers if k.lower() == "content-length"), "0")
        # a length that is no number leaves an empty block: the next record is found by its first line
        yield Record(headers, stream.read(int(size)) if size.isascii() and size.isdigit() else b"")


def response(page_id, url: str | None, html: str | None) -> Record:
    """The response record of a page."""
    body = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", _id(f"response {'' if page_id is None else page_id} {url} {digest(body)}")), ("WARC-Date", PAGE_DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", " ".join(url.split())))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return Record(headers, block)


def _inflate(raw: bytes, kind: int) -> bytes:
    """The expanded bytes of all members; ``raw`` itself if they are not of this kind or expand beyond BODY_BYTES. What a
    cut stream holds is kept."""
    whole, rest, left = [], raw, BODY_BYTES
    try:
        while rest:
            tool = zlib.decompressobj(kind)
            whole.append(tool.decompress(rest, left + 1))
            left -= len(whole[-1])
            if left < 0:
                return raw
            rest = tool.unused_data if kind == 31 else b""
    except zlib.error:
        if not any(whole):
            return raw
    return b"".join(whole)


def _chunks(body: bytes) -> Iterator[bytes]:
    """The chunks of a body, as far as it can be read."""
    at = 0
    while at < len(body):
        line = body.find(CRLF, at)
        line = len(body) if line < 0 else line
        try:
            n = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return
        if n <= 0:
            return
        yield body[line + 2 : line + 2 + n]
        at = line + 2 + n + 2


def _http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and decoded body."""
    head, _, body = block.partition(b"\r\n\r\n") if b"\r\n\r\n" in block else block.partition(b"\n\n")
    status, _, lines = head.partition(b"\n")
    fields = _fields(lines)
    get = lambda n: next((v.lower() for k, v in fields if k.lower() == n), "")
    if "chunked" in get("transfer-encoding"):
        body = b"".join(_chunks(body))
    coding = get("content-encoding")
    if "gzip" in coding:
        body = _inflate(body, 31)
    elif "deflate" in coding:
        plain = _inflate(body, 15)
        body = plain if plain is not body else _inflate(body, -15)
    return status.strip().decode("latin-1"), fields, body


def links_of(html: str) -> Iterator[str]:
    """The href of each link tag, as it is written. A tag that never ends is none, nor is what stands after it."""
    at = 0
    while anchor := _ANCHOR.search(html, at):
        tag = TAG.match(html, anchor.start())
        if not tag:
            return
        href, at = _HREF.search(tag[0]), tag.end()
        if href:
            yield next(x for x in href.groups() if x is not None)


def title_of(html: str) -> str:
    """What stands in the first title; empty without one that ends."""
    begin = _TITLE.search(html)
    opened = html.find(">", begin.end()) if begin else -1
    end = _TITLE_END.search(html, opened + 1) if opened >= 0 else None
    return html[opened + 1 : end.start()] if end else ""


def visible_text(html: str) -> str:
    """Text of all blocks, one a line."""
    runs = sorted(r for x in parse(html) for r in x.runs)
    return "\n".join(t for t in (" ".join("".join(p).split()) for _, p in runs) if t)


def derive(source: Record) -> list[Record]:
    """The metadata and the conversion record of a response; nothing for other records."""
    if (source.get("WARC-Type") or "").lower() != "response":
        return []
    status, fields, body = _http(source.block)
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    named = _CHARSET.search(kind)
    try:
        charset = codecs.lookup(named[1]).name if named else "utf-8"
        html = body.decode("utf-8" if charset in NO_CHARSETS else charset, "replace")
    except (LookupError, ValueError):  # no such charset, or one that is no encoding of text
        html = body.decode("utf-8", "replace")
    links = list(links_of(html))
    line = lambda v: " ".join(v.split())
    about = [("http-status", status), *[(f"http-header-{k.lower()}", v) for k, v in fields], ("title", line(entities.unescape(title_of(html)))), ("links", str(len(links))), *[("outlink", line(entities.unescape(x))) for x in links]]
    text = visible_text(html).encode()
    made = []
    for kind, content_type, block in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in about).encode()), ("conversion", "text/plain; charset=utf-8", text)):
        origin = source.get("WARC-Record-ID") or ""
        headers = [("WARC-Type", kind), ("WARC-Record-ID", _id(f"{kind} {origin}")), ("WARC-Refers-To", origin)]
        # target and date keep their names, the other headers of the source are marked as such
        headers += [(k if k.lower() in ("warc-target-uri", "warc-date") else f"WARC-Source-{k.removeprefix('WARC-')}", v) for k, v in source.headers if k.lower() not in _OWN]
        headers += [("WARC-Source-Block-Digest", source.get("WARC-Block-Digest") or digest(source.block)), ("WARC-Source-Content-Type", source.get("Content-Type") or "")]
        headers += [("Content-Type", content_type), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
        made.append(Record(headers, block))
    return made


_COLUMNS = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, source_payload_digest string, block_digest string, content_length long, record binary"


def _rows(records: list[Record]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    heads = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Source-Payload-Digest", "WARC-Block-Digest")
    cols = [pa.array([r.get(h) for r in records], pa.string()) for h in heads]
    return pa.RecordBatch.from_arrays([*cols, pa.array([len(r.block) for r in records], pa.int64()), pa.array([r.dump() for r in records], pa.binary())], names=names)


def derive_pages(pages: DataFrame) -> DataFrame:
    """Derived records of a (page_id, url, html) table; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield _rows([d for p, u, h in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True) for d in derive(response(p, u, h))])

    return map_arrow(pages.select("page_id", "url", "html"), run, _COLUMNS)


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write the ``record`` column to one .warc.gz a partition (a gzip member a record); returns path and records (saved)."""

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        from pyspark import TaskContext

        name, temporary, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", f"{root}/.{uuid.uuid4().hex}", 0
        with system.open_output_stream(temporary, compression=None) as sink:
            for batch in batches:
                for raw in batch.column("record"):
                    sink.write(gzip.compress(raw.as_py(), 6, mtime=0))
                    n += 1
        system.move(temporary, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "records"])

    return saved(map_arrow(records.select("record"), run, "path string, records long"), "warc-files")


def read_warc(spark: SparkSession, folder: str, derived: bool = False) -> DataFrame:
    """Records of the .warc and .warc.gz files of a folder, streamed file by file; ``derived``: those derived from them."""
    system, root = fs.FileSystem.from_uri(folder)
    paths = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if re.search(r"\.warc(\.gz)?$", f.path))
    todo = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def run(batches):
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_file(path) as raw, gzip.open(raw) if path.endswith(".gz") else raw as stream:
                    held = []
                    for r in read_records(stream):
                        held += derive(r) if derived else [r]
                        if len(held) >= 256:
                            yield _rows(held)
                            held = []
                    yield _rows(held)

    return map_arrow(todo, run, _COLUMNS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive_pages(table(spark, sf_dir, "pages"))
    return made.withColumn("record", F.decode("record", "UTF-8"))


QUERIES = {"op1_warc": op1_warc}

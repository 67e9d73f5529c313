import gzip
import hashlib
import math
from html.parser import HTMLParser

import numpy as np
import pytest

from tidemark.llm import extraction, neighbours, warc

# op6


@pytest.fixture(scope="module")
def model():
    return extraction.Model().train(extraction.training_pages())


def test_extraction_on_held_out_pages(model):
    right = wrong = missed = 0
    for page in extraction.training_pages(150, 99):
        nodes = extraction.parse(page)
        for i, (x, p) in enumerate(zip(nodes, model.marginals(nodes, len(page)), strict=True)):
            x.label = x.label if x.label is not None else nodes[x.parent].label if i else 0
            right += x.own * (x.label == 1 and p >= 0.5)
            wrong += x.own * (x.label == 0 and p >= 0.5)
            missed += x.own * (x.label == 1 and p < 0.5)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.97


def test_marginals_equal_enumeration(model):
    """Sum-product against all assignments of a small tree."""
    page = '<nav><a href="x">home</a></nav><article><h1>Title of it</h1><p>Some text, and more.</p></article><footer>c</footer>'
    nodes = extraction.parse(page)
    n = len(nodes)
    own = [[sum(extraction.TEMPER * model.node.get(f, (0, 0))[s] for f in extraction.features(x, nodes[0].chars, len(page), nodes[x.parent].tag if i else "")) for s in (0, 1)] for i, x in enumerate(nodes)]
    total, on = 0.0, [0.0] * n
    for code in range(1 << n):
        states = [code >> i & 1 for i in range(n)]
        z = model.root[states[0]] + sum(own[i][s] for i, s in enumerate(states))
        z += sum(model.edge[nodes[i].tag in extraction.FLOW][states[nodes[i].parent]][states[i]] for i in range(1, n))
        w = math.exp(z)
        total += w
        for i, s in enumerate(states):
            on[i] += w * s
    assert model.marginals(nodes, len(page)) == pytest.approx([x / total for x in on], rel=1e-6)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<article>", ""),
        ("<nav><a href=a>Home</a></nav><article><h1>One &amp; two</h1><p>Some <b>bold</b>er\n text<br>here.<p>Second paragraph, as well.</article><footer>&copy; x</footer>", "One & two Some bolder text here. Second paragraph, as well."),
        ("<article><p>Before the comment, text.</p><!-- no > end --><script>if (a<b) x('</p>')</script><style>p{}</style><p>After it, more.</p></article><!-- open", "Before the comment, text. After it, more."),
        ('<article><p title="a > b">Quoted sign in a tag, here.</p></article>', "Quoted sign in a tag, here."),
        ("<main><p>Hello world, this is text.</p><form><label>Name</label><input></form><div class=advert>Buy now</div><p>More text of the main part.</p></main>", "Hello world, this is text. More text of the main part."),
    ],
)
def test_extraction_cases(model, page, text):
    assert model.extract(page) == text


def test_stray_quotes_and_unclosed_elements_keep_the_text():
    said = lambda page: " ".join("".join(piece for node in extraction.parse(page) for _, run in node.runs for piece in run).split())
    assert said('<p class="x"">Hello </p><p class="y">World </p><p class="z">More </p><p class="w">End</p>') == "Hello World More End"
    assert said("<p title='a > \"b'>One </p><p a=\">\" b = '>'>Two </p><p \"c=d>Three </p><p class=>Four</p>") == "One Two Three Four"
    for tag in ("button", "select", "object", "svg", "math", "canvas", "audio", "video", "noscript", "template"):
        assert said(f"<p>One </p><{tag}><p>Two</p>") == "One Two"
    assert said("<p>One</p><style>p{}<p>Two</p>") == "One" and said("<p>One </p><svg>x</svg><p>Two</p>") == "One Two"
    extraction.parse("<button>" * 100_000 + "<head>" * 100_000)


def test_long_and_broken_pages_are_linear(model):
    for page in ("<div>" * 20_000 + "x", '<a href="' * 20_000, "<" * 200_000, "<!--" * 50_000, "<p>word </p>" * 20_000, "<script>" * 5000):
        model.extract(page)


def test_unknown_ends_and_cells_cost_nothing():
    import time

    began = time.process_time()
    for page in ("<ul><span></x>" * 20_000, "<div>" * 20_000 + "<td></td>" * 20_000, "<td><section>" + "<div>" * 20_000 + "<tr></tr>" * 20_000, "<div>" * 20_000 + "<body>" * 20_000):
        extraction.parse(page)
    assert time.process_time() - began < 12


def test_loose_text_in_a_box_without_a_telling_name(model):
    lines = ["The harbour was quiet that morning, and the boats lay still along the wall.", "Nobody had told the crew that the market would stay closed for another week.", "They mended nets, drank coffee and waited for news from the other side of the bay."]
    text = "<br>".join(lines * 3)
    assert model.extract(f'<html><body><div id="wrap">{text}<br></div></body></html>') == " ".join(lines * 3)


class Reader(HTMLParser):
    """The standard library's reader: text outside scripts and the like, cut at block elements."""

    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")
        self.out.append("" if tag in extraction.INLINE else " ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title")
        self.out.append("" if tag in extraction.INLINE else " ")

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)


def read_plainly(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    return "".join(reader.out).split()


def test_all_text_equals_the_standard_reader():
    for page in extraction.training_pages(60, 31):
        assert warc.visible_text(page).split() == read_plainly(page)


def test_extraction_query(spark, sf):
    from tidemark.llm import queries

    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<article><p>Text of this page, yes.</p></article>"), (2, "u", "<article><p>Text of this page, yes.</p></article>")], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extraction.extract_text(pages).collect()))
    assert got == [(0, "", 0), (1, "", 0), (2, "Text of this page, yes.", 23), (2, "Text of this page, yes.", 23)]
    rows = queries()["op6_extraction"](spark, sf).collect()
    assert len(rows) == 50 and all(r.n_chars == len(r.text) for r in rows) and sum(r.n_chars > 0 for r in rows) >= 49
    assert extraction.extract_text(pages.limit(0)).count() == 0


# op8


def brute_nearest(ids, x, k):
    score = x.astype(float) @ x.astype(float).T
    found = {}
    for i in np.flatnonzero(ids % 20 == 0):
        own = [(-score[i, j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i]]
        found[int(ids[i])] = [int(v) for _, v in sorted((round(s, 12), v) for s, v in own)[:k]]
    return found


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(1500, 24)), np.repeat(rng.normal(size=(1, 24)), 400, 0)]).astype(np.float32)
    x *= rng.uniform(0.7, 1.4, (len(x), 1)).astype(np.float32) / np.linalg.norm(x, axis=1, keepdims=True)
    x[1500:] = x[1500]
    ids = rng.permutation(len(x)).astype(np.int64)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    vectors = neighbours.usable(rows)
    got: dict[int, list] = {}
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20, shard_rows=700).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(ids, x, 20)
    at = dict(zip(ids.tolist(), x.astype(float), strict=True))
    assert set(got) == set(want) and all([r for r, *_ in sorted(v)] == list(range(1, 21)) for v in got.values())
    assert all(s == pytest.approx(float(at[q] @ at[v]), abs=1e-9) for q, rows in got.items() for _, v, s in rows)
    assert np.mean([len({v for _, v, _ in got[q]} & set(want[q])) / 20 for q in want]) > 0.95


@pytest.mark.parametrize("d, uneven", [(64, False), (64, True), (256, False)])
def test_recall_on_vectors_without_structure(d, uneven):
    """12,000 Gaussian vectors, the hardest case: the shard widens its beam."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12_000, d))
    x = (x * rng.lognormal(0, 0.5, (len(x), 1)) if uneven else x).astype(np.float32)
    shard = neighbours.Shard(np.arange(len(x)), x, 20)
    own = np.arange(0, 2000, 20)
    asked, found, _ = neighbours.Shard.load(shard.dump()).nearest(own, x[own], 20)
    exact = x[own].astype(float) @ x.T.astype(float)
    exact[np.arange(len(own)), own] = -np.inf
    want = np.argsort(-exact, axis=1)[:, :20]
    assert np.mean([len(set(found[asked == q].tolist()) & set(w.tolist())) / 20 for q, w in zip(own, want, strict=True)]) >= 0.9


def test_double_vectors_keep_their_scores(spark):
    rows = spark.createDataFrame([(0, [1 / 3, 1e-9]), (1, [1 / 7, 2.0]), (2, [1.0, 1 / 9])], "vec_id long, embedding array<double>")
    vectors = neighbours.usable(rows)
    (best, other) = neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0")).orderBy("rank").collect()
    assert (best.vec_id, best.score) == (2, 1 / 3 + 1e-9 / 9) and (other.vec_id, other.score) == (1, 1 / 21 + 2e-9)


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (40, [0.0, 0.0]), (2, [0.5, 0.5]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS shard", "2 AS label", "3 AS vector")
    vectors = neighbours.usable(df)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect())
    rest = lambda q, o: [(q, 1, o, 1.0), (q, 2, 1, 0.5), (q, 3, 2, 0.5), (q, 4, 2, 0.5)]
    assert got == rest(0, 20) + rest(20, 0)
    assert neighbours.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


# op1


def parse_plain(raw):
    """A reader of one record that shares nothing with the operator's."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    assert lines[0] == "WARC/1.0" and rest[len(block) :] == b"\r\n\r\n"
    return headers, block


def test_derived_records(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    by_id = {warc.response(r.page_id, r.url, r.html).get("WARC-Record-ID"): r for r in pages.collect()}
    seen = {"metadata": set(), "conversion": set()}
    for row in warc.derive_pages(pages).collect():
        headers, block = parse_plain(bytes(row.record))
        source = warc.response(*[by_id[headers["WARC-Refers-To"]][c] for c in ("page_id", "url", "html")])
        seen[headers["WARC-Type"]].add(headers["WARC-Refers-To"])
        assert headers["WARC-Block-Digest"] == warc.digest(block) and headers["WARC-Record-ID"] == row.record_id
        assert headers["WARC-Source-Payload-Digest"] == source.get("WARC-Payload-Digest") == warc.digest((by_id[row.refers_to].html or "").encode())
        assert headers["WARC-Source-Block-Digest"] == warc.digest(source.block) and headers["WARC-Target-URI"] == by_id[row.refers_to].url
        assert (headers["WARC-Date"], headers["WARC-Source-Content-Type"]) == (source.get("WARC-Date"), source.get("Content-Type"))
        if headers["WARC-Type"] == "conversion":
            assert block.decode() == warc.visible_text(by_id[row.refers_to].html) and b"<script" not in block
        else:
            assert b"http-header-content-type: text/html; charset=utf-8" in block and b"http-status: HTTP/1.1 200 OK" in block
    assert seen["metadata"] == seen["conversion"] == set(by_id)


def test_warc_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>page {i} ü</p>") for i in range(20)] + [(None, None, None)], "page_id long, url string, html string")
    made = warc.derive_pages(pages)
    files = warc.write_warc(made, str(tmp_path / "out"))
    assert files.agg({"records": "sum"}).first()[0] == 42
    back = warc.read_warc(spark, str(tmp_path / "out"))
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes(r.record) for r in made.collect())
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc.response(r.page_id, r.url, r.html).dump()) for r in pages.collect()))
    derived = warc.read_warc(spark, str(tmp_path / "in"), derived=True)
    assert sorted(bytes(r.record) for r in derived.collect()) == sorted(bytes(r.record) for r in made.collect())


def test_encoded_bodies():
    html = "<p>text ä</p>"
    body = gzip.compress(html.encode("latin-1"))
    chunked = b"5\r\n" + body[:5] + b"\r\n" + f"{len(body) - 5:x}".encode() + b"\r\n" + body[5:] + b"\r\n0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunked
    about, text = warc.derive(warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], block))
    assert text.block.decode() == "text ä" and text.get("WARC-Refers-To") == "<urn:x>" and b"charset=ISO-8859-1" in about.block
    assert warc.derive(warc.Record([("WARC-Type", "request")], b"")) == []
    assert hashlib.sha1(text.block).digest()


def test_bad_charsets_lengths_and_bodies(monkeypatch):
    import io
    import zlib

    html = "<title>T</title><p>Grüße &amp; more</p>".encode()

    def text_of(head, body):
        block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body
        return warc.derive(warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>")], block))[1].block.decode()

    for charset in ("undefined", "idna", "nonsense", "hex", "punycode\x00"):
        assert "more" in text_of(f"Content-Type: text/html; charset={charset}", html)
    raw = zlib.compressobj(wbits=-15)
    for coding, body in (("gzip", gzip.compress(html[:20]) + gzip.compress(html[20:])), ("deflate", zlib.compress(html)), ("deflate", raw.compress(html) + raw.flush()), ("gzip", html)):
        assert text_of(f"Content-Encoding: {coding}", body) == "Grüße & more"
    monkeypatch.setattr(warc, "BODY_BYTES", 1000)
    bomb = gzip.compress(b"x" * 100_000)
    assert warc._inflate(bomb, 31) is bomb and warc._inflate(gzip.compress(b"y" * 1000), 31) == b"y" * 1000
    stream = io.BytesIO(b"WARC/1.0\r\nContent-Length: abc\r\n\r\nlost\r\n\r\nWARC/1.0\r\nContent-Length: 4\r\n\r\nkept\r\n\r\n")
    assert [r.block for r in warc.read_records(stream)] == [b"", b"kept"]


def seconds(f, *how) -> float:
    import time

    begin = time.process_time()
    f(*how)
    return time.process_time() - begin


def test_hostile_pages_take_linear_time():
    """A megabyte of tags that never end, of titles, of end tags without end, and many small chunks and header lines."""
    mb = 1 << 20
    for piece in ("<a ", "<title>", "<title ", "<a href=", '<a href="', "</a ", "<!--", "<p", "<script>", "<script></script ", "<head>", "&", "<a href=x>"):
        page = piece * (mb // len(piece))
        assert seconds(warc.derive, warc.response(1, "u", page)) < 20, piece
        assert seconds(lambda p: [list(warc.links_of(p)), warc.title_of(p)], page) < 3, piece
    chunks = b"".join(b"%x\r\n%b\r\n" % (50, b"y" * 50) for _ in range(mb))
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks + b"0\r\n\r\n"
    assert len(block) > 50 * mb and seconds(warc._http, block) < 5 and warc._http(block)[2] == b"y" * (50 * mb)
    head = b"HTTP/1.1 200 OK\r\nX: y\r\n" + b" z\r\n" * (mb // 4) + b"\r\nbody"
    assert seconds(warc._http, head) < 5 and warc._http(head)[1][0][1].startswith("y z z")


def test_links_and_titles():
    page = '<A HREF = "one">x</a><a class=y href=two>y</a><a title="a > b" href=\'three\'>z</a><abbr href="no"><a name=q><a href>none</a><title>T &amp; U</TITLE><title>second</title>'
    assert list(warc.links_of(page)) == ["one", "two", "three"] and warc.title_of(page) == "T &amp; U"
    assert warc.title_of("<title>never") == "" and warc.title_of("<title") == "" and warc.title_of("<titles>x</titles>") == ""
    assert list(warc._chunks(b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\n\r\n")) == [b"abc", b"de"] and list(warc._chunks(b"zz")) == [] and list(warc._chunks(b"5\r\nab")) == [b"ab"]


def test_formulas_are_text():
    page = "<body><article><p>The area is <math><mi>a</mi><mo>=</mo><msup><mi>r</mi><mn>2</mn></msup><annotation>r^2</annotation></math> units, as was shown.</p></article></body>"
    assert warc.visible_text(page) == "The area is a=r2 units, as was shown."


def test_every_shard_is_searched_through_its_graph(spark, monkeypatch):
    """No task multiplies queries with a whole shard, small shards neither; tasks are a few a shard, without a nested loop."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)).astype(np.float32))], "vec_id long, embedding array<float>")
    vectors = neighbours.usable(rows)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 5)
    found = neighbours.nearest(vectors, vectors, 10, shard_rows=300)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.select("query_id").distinct().count() == 900
    shard = neighbours.Shard(np.arange(400), rng.normal(size=(400, 16)).astype(np.float32), 10)
    searched = []
    whole = shard.graph.search
    shard.graph.search = lambda q, beam, limit=None: searched.append((len(q), beam)) or whole(q, beam, limit)
    shard.nearest(np.arange(50), shard.vectors[:50], 10)
    assert sum(n for n, _ in searched) == 50 and all(b == shard.beam < 400 for _, b in searched)

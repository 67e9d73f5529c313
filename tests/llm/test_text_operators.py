import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import decontamination, jaccard, labelled, mixing, quality, sanitisation, shared, tokens, toxicity
from tidemark.llm import queries as llm_queries


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_words_and_shingles_are_those_of_the_pattern():
    texts = ["A b\tC  d", "", "é x é", "one", "a b c d e f", "A B C D E F"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    w = shared.words(data, offs, shared.SPACE_WORDS)
    assert w.count.tolist() == [4, 0, 3, 1, 6, 6]
    assert w.hash[:4].tolist() == shared.words(np.frombuffer(b"a b c d", np.uint8), np.array([0, 7]), shared.SPACE_WORDS).hash.tolist()
    h, d = shared.shingles(w)
    assert Counter(d.tolist()) == {0: 1, 2: 1, 3: 1, 4: 2, 5: 2}
    assert sorted(h[d == 4]) == sorted(h[d == 5])


# op3


def brute_components(rows):
    sets = {}
    for i, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_equals_brute_force(spark):
    """Families of near copies, chains, frequent passages and copies, where frequent tokens need combinations."""
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(4000)}"
    common = [word() for _ in range(60)]
    rows = []
    for _ in range(6):
        base = [word() for _ in range(int(rng.integers(40, 160)))]
        for _ in range(int(rng.integers(10, 26))):
            own = list(base)
            for _ in range(int(rng.integers(0, 5))):
                own[int(rng.integers(len(own)))] = base[int(rng.integers(len(base)))]
            rows.append(own)
        chain = list(base)
        for _ in range(8):
            chain[int(rng.integers(len(chain)))] = word()
            rows.append(list(chain))
    rows += [common + [word() for _ in range(int(rng.integers(0, 30)))] for _ in range(40)]
    rows += [common] * 12 + [["a", "b"]] * 3 + [[], ["x", "y", "z", "u"]]
    docs = [(i, " ".join(r)) for i, r in enumerate(rows)] + [(9000, None), (9001, "A B")]
    want = brute_components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want
    kept = {r.doc_id for r in jaccard.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {c for _, c in want.values()}


def test_prefix_signatures_never_miss():
    """Sets that link share a signature, whatever classes their tokens have."""
    rng = np.random.default_rng(1)
    for n in [1, 2, 4, 5, 9, 10, 23, 60, 200, 500]:
        universe = rng.choice(1 << 40, 2 * n + 4, replace=False)
        count = dict(zip(universe.tolist(), rng.choice([2, 3, 8, 9, 50, 65535], len(universe)).tolist(), strict=True))
        for _ in range(20):
            gone = int(rng.integers(0, n // 9 + 1))
            x = rng.choice(universe, n, replace=False)
            rest = np.setdiff1d(universe, x)
            y = np.concatenate([x[gone:], rest[:gone]])
            if 9 * (n - gone) >= 4 * 2 * n:
                sig = [set(jaccard.signatures(n, s, np.array([count[t] for t in s.tolist()])).tolist()) for s in (x, y)]
                assert sig[0] & sig[1], (n, gone)


def test_jaccard_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in jaccard.link_components(odd_docs).collect()}
    assert [got[i].n_shingles for i in (2, 3, 4)] == [0, 0, 0] and got[2].component_id == 2
    assert got[6].component_id == 5 and got[7].component_id == 7 and got[None].component_id is None
    assert jaccard.link_components(no_docs).count() == 0
    kept = [r.doc_id for r in jaccard.keep_one(odd_docs).collect()]
    assert sorted(x for x in kept if x) == [1, 2, 3, 4, 5, 7, 8, 9] and kept.count(None) == 1


def test_keep_one_row_of_each_component(spark):
    """Ids that repeat with other texts, null ids, near copies among them: each component keeps one row."""
    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base[:55] + [f"z{k}"] + base[55:]) for k in range(4)]
    other = [" ".join(f"{p}{i}" for i in range(40)) for p in "abc"]
    rows = [(1, other[0]), (1, near[0]), (None, near[1]), (None, near[2]), (None, other[1]), (None, other[1].upper()), (5, near[3]), (5, near[3].upper()), (7, other[2]), (7, other[2]), (8, ""), (8, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    brute = brute_components(list(enumerate(t for _, t in rows)))
    groups = defaultdict(list)
    for i, (n, c) in brute.items():
        groups[c if n else ("empty", i)].append(i)
    got = sorted((tuple(r) for r in jaccard.keep_one(docs).collect()), key=repr)
    assert len(got) == len(groups) == 7
    assert [r for r in got if r[1]] == sorted([(1, other[0]), (1, near[0]), (None, min(x[1] for x in got if x[0] is None and x[1])), (7, other[2])], key=repr)


def test_hot_tokens_take_the_short_way(spark):
    """A passage that most documents share is listed as hot, and the components are still those of brute force."""
    rng = np.random.default_rng(12)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(240):
        own = [f"q{rng.integers(2000)}" for _ in range(int(rng.integers(1, 14)))]
        cut = int(rng.integers(0, len(own) + 1))
        rows.append((i, " ".join(own[:cut] + passage + own[cut:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert len(jaccard.hot_tokens(jaccard.class_table(jaccard.placed(docs, False)))) >= 26
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()}
    assert got == brute_components(rows)


def test_rows_that_stay_are_found_without_a_shuffle_of_texts(spark, tmp_path, monkeypatch):
    """Whatever the ids and however many files and chunks: scattered and repeated ids, and rows of several files."""
    rng = np.random.default_rng(21)
    words = lambda k: " ".join(f"v{k}x{i}" for i in range(12))
    ids = [-(1 << 63), -65, -64, -63, -1, 0, 1, 63, 64, 10**12, (1 << 63) - 1, *map(int, rng.integers(-(1 << 62), 1 << 62, 60))]
    rows = [(d, words(k // 2)) for k, d in enumerate(ids)] + [(500 + k, "") for k in range(3)]
    order = rng.permutation(len(rows)).tolist()
    spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    best = {}
    for d, t in rows[:-3]:
        best[t] = min(best.get(t, d), d)
    want = sorted([(d, t) for t, d in best.items()] + rows[-3:])
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.keep_one(docs, stored=True)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert sorted(tuple(r) for r in kept.collect()) == want
        assert sorted(tuple(r) for r in jaccard.keep_one(docs).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_most_tokens_of_texts_alone_are_not_dealt(spark, monkeypatch):
    """Texts that share little are ruled out by some of their tokens; runs of many tokens of one text stay whole."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(120))) for i in range(300)]
    long = [f"l{k}" for k in range(6000)]
    rows += [(900, " ".join(long)), (901, " ".join([*long, "end"])), (902, " ".join(long[:4700]))]
    rows += [(910 + k, " ".join(f"s{j}" for j in rng.permutation(5)[: k + 1])) for k in range(5)]
    rows += [(None, rows[0][1] + " more"), (950, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, whole = [], jaccard._deal

    def deal(*args):
        dealt.append(whole(*args))
        return dealt[-1]

    monkeypatch.setattr(jaccard, "_deal", deal)
    found = jaccard.link_components(docs).collect()
    got = {r.doc_id: r.component_id for r in found}
    assert got[901] == got[900] == 900 and got[902] == 902 and got[0] == got[None] == 0
    brute = brute_components([(i, t) for i, t in rows if i is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == brute
    size = sum(len(x) for d in dealt for r in d.collect() for x in r[1:])
    assert size < 6 * sum(r.n_shingles for r in found)


# op10


def brute_hits(docs, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for k, t in items:
        ws = word.findall(lower(t))
        for p in range(max(1, len(ws) - window + 1) if ws and k is not None else 0):
            windows[tuple(ws[p : p + window])].add(str(k))
    out = {}
    for i, t in docs:
        ws = word.findall(lower(t))
        hit, found = np.zeros(len(ws), bool), set()
        for size in {len(w) for w in windows}:
            for p in range(len(ws) - size + 1):
                if own := windows.get(tuple(ws[p : p + size])):
                    hit[p : p + size] = True
                    found |= own
        out[i] = (len(ws), int(hit.sum()), len(found), bool(hit.sum() and 20 * hit.sum() >= len(ws)))
    return out


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pool = [f"t{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(pool, n))
    items = [(i, text(int(rng.integers(1, 40)))) for i in range(25)] + [(30, "short one"), (31, None), (None, text(20)), (32, ""), (33, "t1"), (5, text(15))]
    docs = []
    for i in range(60):
        parts = [text(int(rng.integers(0, 60)))]
        if i % 2:
            k = items[int(rng.integers(25))][1]
            parts += [k.upper() if i % 3 else k.replace(" ", ", "), text(int(rng.integers(0, 300)))]
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "short one"), (103, "Short-ONE. t1")]
    want = brute_hits(docs, items)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontamination.BLOCK_BYTES, 900):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.judge(frame, bench, block).collect()}
        assert got == want
    clean = {r.doc_id for r in decontamination.remove_contaminated(frame, bench).collect()}
    assert clean == {i for i, v in want.items() if not v[3]}


def test_longest_matches(spark):
    words = [f"a{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(words[:40]))], "item_id long, text string")
    docs = spark.createDataFrame([(7, "x y " + " ".join(words[5:33]) + " z"), (8, " ".join(words[30:60]))], "doc_id long, text string")
    assert [tuple(r) for r in decontamination.longest_matches(docs, bench).collect()] == [("1", 5, 7, 2, 28)]


def test_decontamination_odd_rows(odd_docs, no_docs, spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.contaminated) for r in decontamination.judge(odd_docs, bench).collect()]
    assert (2, 0, False) in got and got.count((7, 2, True)) == 2 and (5, 30_000, False) in got
    assert decontamination.judge(no_docs, bench).count() == 0
    assert decontamination.judge(odd_docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_longest_match_of_each_document(spark):
    ws = [f"a{i}" for i in range(60)]
    bench = spark.createDataFrame([("x", " ".join(ws[:40])), ("b", " ".join(ws[10:40])), ("s", "solo word")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "q " + " ".join(ws[10:30]) + " q " + " ".join(ws[:15])), (2, "a solo word"), (3, "none"), (4, " ".join(ws[:13] * 3))], "doc_id long, text string")
    got = {r.doc_id: (r.longest_words, r.longest_item, r.longest_start) for r in decontamination.judge(docs, bench, 60).collect()}
    assert got == {1: (20, "b", 1), 2: (2, "s", 1), 3: (0, None, None), 4: (13, "x", 0)}


# op4


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return str(public.path("word_bpe_49k.json"))


def test_bit_fields_round_trip():
    rng = np.random.default_rng(0)
    for bits in (1, 5, 8, 11, 16, 17, 23, 32):
        x = rng.integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
        assert (tokens.unpack(tokens.pack(x, bits), bits, len(x)) == x).all()
    assert [tokens.bits_for(v) for v in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_file_round_trip_and_random_access():
    import io

    import pyarrow as pa

    rng = np.random.default_rng(1)
    docs = [(None, np.array([2], np.uint32))] + [(i, rng.integers(0, 5000, int(rng.integers(0, 400))).astype(np.uint32)) for i in range(50)]
    sink = io.BytesIO()
    sink.close, raw = lambda: None, sink
    writer = tokens.Writer(sink, 13, 256)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    reader = tokens.Reader(pa.BufferReader(raw.getvalue()))
    back = list(reader.documents(700))
    assert [(d, ids.tolist()) for d, _, ids in back] == [(d, ids.tolist()) for d, ids in docs]
    every = np.concatenate([ids for _, ids in docs])
    for a, b in ((0, 1), (250, 260), (256, 512), (100, len(every)), (7, 7)):
        assert (reader.ids(a, b) == every[a:b]).all()


def test_encoder_equals_library(vocabulary, spark, sf):
    e = tokens.Encoder(vocabulary)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", " \n", "a\x1cb", "<|endoftext|> it's don't 's", "a²b ½ naïve__x µ -- 'sfoo it's5 1984 A\u0085B @x #!", "“q” – Ελλάς ΣΑΣ’s", "é İ ŉ", "漢字 😀"]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == e.tool.encode(t, add_special_tokens=False).ids, t[:80]


def test_encoder_equals_library_on_first_code_points(vocabulary):
    e = tokens.Encoder(vocabulary)
    texts = [t for i in range(256) for c in (chr(i),) for t in (c, f"a{c}b", f"#{c}", f"{c}'s 1{c}{c}2 _{c}.", f"é{c}x {c} y", f"漢{c}x {c}")]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == e.tool.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_equals_library_on_random_texts(vocabulary):
    # mixes of the first 256 code points, of others, and of what contractions are made of, some in one step
    rng = random.Random(3)
    first = [chr(i) for i in range(256)]
    more = [*first, *"“”—漢字İßſΣςǅⅧ😀\u0300\u2028\u3000\u00a0\u200b", "<|endoftext|>", "<|", "'re", "'LL"]
    kinds = (first, more, list("abstrelvmdSTREVML''' '123!é"))
    texts = ["".join(rng.choices(kinds[i % 3], k=rng.randint(0, 40))) for i in range(6000)] + [None, "", "x" * 3000]
    e = tokens.Encoder(vocabulary, most=500)
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == e.tool.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_other_vocabularies_go_to_the_library():
    public = pytest.importorskip("public_tokenizers")
    e = tokens.Encoder(str(public.path("byte_bpe_50k.json")))
    assert not e.split
    for t in ("Two  words, it's\nso", "", "é 漢"):
        assert e.encode([t])[0].tolist() == e.tool.encode(t, add_special_tokens=False).ids


def test_token_files_of_documents(vocabulary, spark, odd_docs, no_docs):
    got = tokens.tokenized(odd_docs, vocabulary).orderBy("start").collect()
    tool = tokens._tokenizer(vocabulary)
    start, want = 0, {}
    for r in sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*tool.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[start] = (r.doc_id, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.start: (r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want
    assert tokens.tokenized(no_docs, vocabulary).count() == 0


# op5


def test_mixing_targets_and_rules(spark, odd_docs, no_docs):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 4}" if i % 11 else None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"] and r["size"] == 1 + r.doc_id % 50
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s, t in target.items():
        assert t <= 2 * size[s] + 1e-6 and taken[s] == pytest.approx(t, rel=0.1)
    assert sorted(r.taken for r in got) == sorted(r.taken for r in mixing.mix(docs.repartition(7)).collect())
    assert mixing.emit(docs).count() == sum(r.copies for r in got) and mixing.emit(docs).columns == docs.columns
    assert mixing.mix(odd_docs).count() == odd_docs.count() and mixing.emit(odd_docs).columns == odd_docs.columns
    assert mixing.mix(no_docs).count() == 0


def test_mixing_fills_small_sources(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got == {"a": 20.0, "b": 1665.0 - 20 - 200, "c": 200.0, None: 0.0} or sum(got.values()) == pytest.approx(1665)


def test_mixing_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = c.execute(mixing.ORACLE["op5_mixing"])
    columns = [d[0] for d in found.description]
    ours = sorted(repr(tuple(r[k] for k in columns)) for r in mixing.op5_mixing(spark, sf).collect())
    assert ours == sorted(map(repr, found.fetchall()))


# op9

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    found = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(found))


def test_base_spans_equal_brute_force(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    letters = list("ab1.@-_ 4+()%é😀0x5:")
    texts = ["".join(rng.choice(letters, int(n))) for n in rng.choice([5, 30, 200], 400)]
    texts += [None, "", "4111111111111111 " * 300, "a@b.cd_x@y.z c@d.e@f.g 1.2.3.4.5.6.7.8 000255.1.1.1 256.1.1.1", "a" * 3000 + "@", "9" * 3000, "+1 (017) 555-7713.", "x@y.z" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows.select("text", sanitisation.joined(sanitisation.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    assert [r.s for r in got] == [brute_spans(r.text) for r in got]


def test_terms_that_disclose(spark):
    rng = np.random.default_rng(5)
    filler = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "kappa") for b in "abcdefghijklmnopqrstuvwxyz"]
    rows = []
    for i in range(150):
        words = list(rng.choice(filler, 50))
        if i < 5:
            words[7:7] = ["Zorblax", "wrote", "jo.x@corp.com"]
        if i >= 100:
            words[3:3] = ["wrote"]
        rows.append((i, " ".join(words)))
    rows.append((500, "Only zorblax, here"))
    copy = " ".join(rng.choice(filler, 60)) + " unique_a unique_b boss@firm.org"
    rows += [(600 + i, copy + f" v{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in sanitisation.find_spans(docs).collect()}
    texts = dict(rows)
    terms = {texts[i][a:b].lower() for i, spans in got.items() for kind, a, b in spans if kind == 4}
    assert terms == {"zorblax"} and got[500] == [(4, 5, 12)]
    assert all(len(got[600 + i]) == 1 for i in range(6)) and not any(got[i] for i in range(5, 150))
    clean = {r.doc_id: r.text for r in sanitisation.sanitised(docs).collect()}
    assert clean[500] == "Only [term], here" and clean[600].endswith("[email] v0") and clean[20] == texts[20]


def flagged(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    return {r.doc_id: {texts[r.doc_id][x.start : x.stop].lower() for x in r.spans if x.kind == 4} for r in sanitisation.find_spans(docs).collect()}


def test_near_copies_count_once_and_many_terms_are_flagged(spark):
    rng = np.random.default_rng(8)
    filler = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "kappa") for b in "abcdefghijklmnopqrstuvwxyz"]
    text = lambda: " ".join(rng.choice(filler, 50))
    rows = [(i, text()) for i in range(300)]
    six = ["zorblax", "quimby", "fennwick", "ostrava", "plimsoll", "tarquin"]
    rows += [(400 + i, text() + " " + " ".join(six) + " jo.x@corp.com") for i in range(3)]
    first = " ".join(rng.choice(filler, 120)) + " " + " ".join(six) + " jo.x@corp.com"
    rows += [(500 + i, first + f" variant{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.h: r.g for r in sanitisation.near_copies(docs.selectExpr("doc_id", "text", "xxhash64(text) AS h")).collect()}
    assert len(groups) == 308 and len(set(groups.values())) == 304
    got = flagged(docs)
    assert all(set(six) <= got[i] for i in (400, 401, 402, 500, 501, 502, 503, 504)) and not any(got[i] for i in range(300))


def test_terms_of_entities_in_one_or_two_texts(spark):
    rng = np.random.default_rng(9)
    filler = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "kappa") for b in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(i, " ".join(rng.choice(filler, 20))) for i in range(2500)]
    rows += [(3000, " ".join(rng.choice(filler, 20)) + " Zorblax of Quimby, one@corp.com or +1 555 0100 2000")]
    rows += [(3001 + i, " ".join(rng.choice(filler, 20)) + " Fennwick two@corp.com") for i in range(2)]
    got = flagged(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[3000] == {"zorblax", "quimby"} and got[3001] == got[3002] == {"fennwick"} and not any(got[i] for i in range(2500))


def test_term_spans_equal_brute_force(spark):
    """Counts by sets over the groups of near copies, spans by a plain search for whole words."""
    import math

    rng = np.random.default_rng(21)
    filler = [f"{a}{b}{c}" for a in ("al", "be", "ga", "de", "ka") for b in "abcdefgh" for c in ("on", "ta", "ri")]
    people = [f"p{i}@x.org" for i in range(12)] + ["everyone@x.org"] * 6 + ["+1 (555) 010-4477"]
    rows = []
    for i in range(260):
        ws = list(rng.choice(filler, int(rng.integers(5, 60))))
        if i % 4 == 0:
            ws += [str(rng.choice(people)), f"Rare_{rng.integers(12)}", str(rng.choice(people)), f"Odd{i}"]
            rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, rows[4][1] + " tail"), (903, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_text = {r.text: r.g for r in sanitisation.near_copies(docs.selectExpr("coalesce(text, '') AS text", "coalesce(text, '') AS h")).selectExpr("h AS text", "g").collect()}
    term = lambda t: {w for w in re.split(r"[^\w]+", t.lower()) if len(w) >= 3 and re.search(r"[^\W\d_]", w)}
    holds, bare, whole = defaultdict(set), defaultdict(set), defaultdict(set)
    for _, t in rows:
        g, t = by_text[t or ""], t or ""
        found = [s.split(":") for s in brute_spans(t).split(",") if s]
        for w in term(t):
            whole[w].add(g)
        if found:
            kept = t
            for kind, a, b in sorted(found, key=lambda s: -int(s[1])):
                value = t[int(a) : int(b)]
                holds[kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()].add(g)
                kept = kept[: int(a)] + " " + kept[int(b) :]
            for w in term(kept):
                bare[w].add(g)
    n = len(set(by_text.values()))
    told = set()
    for groups in holds.values():
        for w, own in bare.items():
            if both := len(groups & own):
                ratio = (both + 1) / (len(groups) + 2) * (n + 2) / (max(len(whole[w]), len(own)) + 1)
                if math.log(ratio) / math.log(n / min(len(groups), n - 1)) >= sanitisation.THRESHOLD:
                    told.add(w)
    got = {r.doc_id: sorted((s.start, s.stop) for s in r.spans if s.kind == 4) for r in sanitisation.find_spans(docs).collect()}
    for i, t in rows:
        base = [tuple(map(int, s.split(":")[1:])) for s in brute_spans(t).split(",") if s]
        words = [m.span() for m in re.finditer(r"\w+", t or "") if m[0].lower() in told]
        assert got[i] == [s for s in words if not any(a < s[1] and s[0] < b for a, b in base)], i
    assert any(got.values())


def test_sanitisation_query_counts_its_spans(spark, tmp_path):
    """Every column that the contract fixes, on rows with several spans of one kind and of some kinds only."""
    texts = [None, "", "a@b.cd", "1.2.3.4", "4111111111111111", "+1 (017) 555-7713", "+1 (017) 555-7713 and 1.2.3.4", "a@b.cd c@d.e f@g.hi", "1.2.3.4 5.6.7.8 +1 (017) 555-7713 4111111111111111 a@b.cd", "none"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sanitisation.op9_sanitisation(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        spans = brute_spans(text)
        kinds = [s.split(":")[0] for s in spans.split(",")]
        assert tuple(got[i])[:6] == (i, *[kinds.count(k) for k in BASE], hashlib.sha256(spans.encode()).hexdigest())


def test_sanitisation_odd_rows(odd_docs, no_docs):
    assert sanitisation.find_spans(odd_docs).count() == odd_docs.count()
    assert sanitisation.find_spans(no_docs).count() == 0


# op2, op7


def held_out(spark, sf, found, label, modulus, rest):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r, labels[r.doc_id]) for r in found.collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r, _ in rows)
    return [(r, y) for r, y in rows if r.held_out]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = held_out(spark, sf, llm_queries()["op2_quality"](spark, sf), "quality", 4, 2)
    right = sum(r.predicted == y for r, y in rows) / len(rows)
    kept = [r.predicted for r, y in rows if y == 1]
    assert right > 0.9 and sum(kept) / len(kept) > 0.93


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = held_out(spark, sf, llm_queries()["op7_toxicity"](spark, sf), "toxic", 5, 0)
    assert sum(r.predicted == y for r, y in rows) / len(rows) > 0.93


def test_quality_scores_equal_a_plain_computation(spark):
    """Sizes from the command-line form of the library, the formula written out, the logistic by hand."""
    import math

    import zstandard

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    assert model.weights is not None
    got = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    tools = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=quality.LEVEL, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in docs.collect():
        raw = (r.text or "").encode()
        good, bad = (len(t.compress(raw)) for t in tools)
        n, x = len(raw), 0.0
        if n:
            over, ratio, long = (bad - good) / (n + 16), min(good, bad) / (n + 16), math.log2(1 + n)
            terms = (10 * over, 2 * math.tanh(40 * over), 5 * ratio, 5 * ratio**2, 5 * math.exp(-12 * ratio), long / 10, long * ratio / 2, long**2 / 100)
            x = sum(w * t for w, t in zip(model.weights, terms, strict=False))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, x + model.weights[-1])))), abs=1e-9)


def test_lexicon_matches_equal_a_plain_search():
    """Every word against every pattern."""
    rng = random.Random(4)
    letters = "abcd"
    lexicon = {"".join(rng.choices(letters, k=rng.randint(2, 5))) + rng.choice(("", " ")): rng.random() + 0.1 for _ in range(60)}
    model = toxicity.Model(lexicon, [])
    for _ in range(300):
        text = "".join(rng.choices(letters + " -1", k=rng.randint(0, 60)))
        want = {}
        for m in re.finditer(r"[^\W\d_]+", text):
            fits = [w for p, w in lexicon.items() if (m[0] == p.strip() if p.endswith(" ") else m[0].startswith(p))]
            if fits:
                want[m.start()] = max(fits)
        assert model.matches(text) == pytest.approx(want)


def test_neighbours_of_words_however_far():
    text = "damn" + "." * 5000 + "fine day"
    assert toxicity.pairs_at(text, [0, 5004, 1]) == {0: ["damn fine"], 5004: ["damn fine", "fine day"], 1: []}


def test_folding_and_exceptions():
    assert toxicity.fold("M0R0N 1d10t tr4sh іdiоt id​iot 555-1234 Zo3") == "moron idiot trash idiot idiot 555-1234 zoe"
    sample = [(i, f"you are trash and number {i}", 1) for i in range(40)] + [(100 + i, f"put it in the trash can now, take {i}", 0) for i in range(8)] + [(200 + i, f"nothing wrong with number {i} here", 0) for i in range(200)]
    model = toxicity.train(sample)
    bad, spared, clean = model.score(["you are tr4sh, he said", "in the trash can", "all is well"])
    assert bad > 0.5 > max(spared, clean)


def test_sample_without_a_huge_document_keeps_the_others(spark):
    rows = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality", "CASE WHEN id < 6 THEN repeat('x', 5000) ELSE 'few words' END AS text")
    assert {i for i, *_ in labelled.training_sample(rows, rows, "quality", 1, 9, max_bytes=4000)} == set(range(6, 40))


def test_stages_keep_columns_of_any_name(spark, clashing_docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    rows = {repr(r) for r in clashing_docs.collect()}
    for made in (quality.keep_good(clashing_docs, labels, 0.0), jaccard.keep_one(clashing_docs), decontamination.remove_contaminated(clashing_docs, bench), mixing.emit(clashing_docs)):
        assert made.schema.simpleString() == clashing_docs.schema.simpleString()
        assert {repr(r) for r in made.collect()} <= rows
    assert quality.keep_good(clashing_docs, labels, 0.0).count() == clashing_docs.count()


def test_classifiers_odd_rows(spark, odd_docs, no_docs, sf):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (5, None, None), (None, 1, 1), (7, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert {y for *_, y in labelled.training_sample(odd_docs, labels, "quality", 4, 9)} == {0, 1}
    assert {i for i, *_ in labelled.training_sample(odd_docs, labels, "quality", 4, 9)} == {1, 3}
    plain = odd_docs.select("doc_id", "text")
    assert quality.score(plain, quality.fit(odd_docs, labels)).where("score = 0.5").count() == odd_docs.count()
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for module in (quality, toxicity):
        model = module.fit(*big)
        assert module.score(plain, model).where("score BETWEEN 0 AND 1").count() == odd_docs.count()
        assert module.score(no_docs, model).count() == 0
        assert len(model.score([b""] if module is quality else [""])) == 1


def test_quality_of_few_or_empty_labelled_texts():
    """A few documents a class are enough; texts that are all empty leave the class without any; short ones make the dictionary."""
    good, bad = "A calm and well made sentence about rivers and towns. ", "BUY NOW!!! $$$ click click win "
    for n in (1, 2, 5, 15, 40):
        model = quality.train([(i, (good if i % 2 else bad) * (3 + i % 4), i % 2) for i in range(2 * n)])
        yes, no = model.score([(good * 4).encode(), (bad * 4).encode()])
        assert yes > no
    assert quality.train([(i, "", i % 2) for i in range(80)]) is None
    assert quality.train([(i, "x" if i % 2 else "", i % 2) for i in range(80)]) is None
    tiny = quality.train([(i, "ab" if i % 2 else "zz", i % 2) for i in range(80)])
    mixed = quality.train([(i, "" if i % 8 < 6 else good if i % 2 else bad, i % 2) for i in range(80)])
    assert all(0 <= s <= 1 for m in (tiny, mixed) for s in m.score([b"", b"ab", good.encode()]))
    assert quality.train([]) is None and quality.train([(1, "x", 1)]) is None

"""Phrases, Merkle manifests and resharding against plain computations and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, phrases, sharding

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("module, name", [(phrases, "op11_collocations"), (merkle, "op12_merkle")])
def test_query_matches_sql(spark, sf, module, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = module.QUERIES[name](spark, sf)
    found = db.execute(module.ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(found.fetchall())


# ---------------------------------------------------------------- phrases


def plain_phrases(rows, least, longest=5, top=2000, share=100):
    total, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        many = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in many.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in many.items()):
                continue
            score, cut = min((1000 * a * total[lang] // (count[p[:c]] * count[p[c:]]), c) for c in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), count[p[:cut]], count[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def collocated(df, *how, **more):
    return sorted(tuple(r) for r in phrases.collocations(df, *how, **more).collect())


def test_phrases_match_a_plain_count(spark):
    rng = random.Random(5)
    words = ["New", "york", "é", "😀x", "the", "of", "state", "a\x00b", "Ünion", "x" * 70]
    marks = [" ", "  ", "\t", ", ", ".", "\n", "!?", ";", "\x0b"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choices(marks, [20, 3, 3, 2, 1, 1, 1, 1, 1])[0] for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [("en", None), (None, ""), ("fr", " . , "), ("en", "the state of new york. " * 40)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for least, longest, share in ((4, 5, 100), (30, 3, 60), (300, 5, 100)):
        assert collocated(df, least, longest, 50, share) == plain_phrases(rows, least, longest, 50, share)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """With a counter for every few dozen words nearly all n-grams survive, and the counts are the same."""
    rng = random.Random(6)
    rows = [("en", " ".join(f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(200))) for _ in range(60)]
    monkeypatch.setattr(phrases, "MOST_CELLS", 64)
    monkeypatch.setattr(phrases, "LEAST_CELLS", 64)
    assert collocated(spark.createDataFrame(rows, "lang string, text string"), 8) == plain_phrases(rows, 8)


def test_equal_hashes_are_told_apart(monkeypatch):
    """Where all words hash alike, phrases are still counted by their bytes."""
    monkeypatch.setattr(phrases, "mix64", lambda x: np.zeros_like(x))
    data = np.frombuffer(b"a b a b cc a b", np.uint8)
    part = phrases.Slice(data, np.array([0, 7, 14]), np.zeros(2, np.int64))
    part.hash = np.zeros_like(part.hash)
    found = Counter()
    for batch in phrases.survivors(part, np.array(["en"], object), np.zeros(1, np.uint64), {}, 2):
        for r in batch.to_pylist():
            found[r["k"], r["phrase"]] += r["f"]
    assert found == {(0, ""): 7, (1, "a"): 3, (1, "b"): 3, (1, "cc"): 1, (2, "a b"): 3, (2, "b a"): 1, (2, "cc a"): 1}


def test_counters_stop_at_the_least_count():
    counters = np.zeros(4, np.uint8)
    phrases.add(counters, np.array([1, 1, 3]), np.array([90, 90, 5]), 100)
    phrases.add(counters, np.array([1, 3]), np.array([250, 5]), 100)
    assert counters.tolist() == [0, 100, 0, 10]


def test_phrases_of_odd_rows(clashing_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in clashing_docs.collect()]
    assert collocated(clashing_docs, 20) == plain_phrases(rows, 20)
    assert collocated(no_docs) == []


# ---------------------------------------------------------------- Merkle manifests


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    nodes = defaultdict(list)
    for r in rows:
        own, low = h(*map(field, r)), h(*map(field, (*r[:4], r[4] and r[4].translate(AZ))))
        third = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        nodes[r[2]].append((r[0] is not None, r[0] or 0, own, low if third else own))

    def climb(level):
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for p, i in zip(paths, at, strict=True):
                run = i // 8 * 8
                p.append((level[run:i], level[i + 1 : run + 8]))
            level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
            at = [i // 8 for i in at]
        return level[0] if level else None, paths

    order = sorted(nodes, key=lambda g: (g is not None, (g or "").encode()))
    groups = {}
    for g in order:
        leaves = sorted(nodes[g])
        groups[g] = (leaves, *climb([x[2] for x in leaves]))
    root, tops = climb([groups[g][1] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        leaves, sub, paths = groups[g]
        for (has, i, own, claimed), path in zip(leaves, paths, strict=True):
            node = claimed
            for left, right in path + top:
                node = h(*left, node, *right)
            out.append((i if has else None, own, sub, root, h(*[x for a, b in path + top for x in a + b]), node, node == root))
    return Counter(out)


def merkle_rows(docs, height=None):
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    own = merkle.leaf(*[F.col(c) for c in merkle.COLUMNS])
    low = merkle.leaf(*[merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in merkle.COLUMNS])
    rows = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), own.alias("leaf"), F.when(third, low).otherwise(own).alias("claimed"))
    found = merkle.proofs(merkle.build(rows, height))
    return Counter((r["id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in found.collect())


@pytest.mark.parametrize("height", [1, 2, None])
def test_trees_of_many_blocks_match_a_plain_tree(spark, height):
    """Groups of 1, 8, 9, 64, 65 and 600 leaves, a null group, ids that repeat, null ids and texts."""
    rows, i = [], 0
    for lang, n in (("a", 1), ("b", 8), ("c", 9), (None, 64), ("é", 65), ("z", 600)):
        for _ in range(n):
            rows.append((i // 2 if lang == "z" else i, f"s{i % 3}" if i % 5 else None, lang, i, f"Text {i} ÄÖ" if i % 7 else None))
            i += 1
    rows += [(None, None, "z", None, None), (None, None, "z", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    found = merkle_rows(docs, height)
    assert found == plain_merkle(rows)
    assert 0 < sum(n for r, n in found.items() if not r[-1]) < len(rows)


def test_manifest_of_odd_rows(spark, clashing_docs, no_docs, tmp_path):
    rows = [tuple(r) for r in clashing_docs.select(*merkle.COLUMNS).collect()]
    assert merkle_rows(clashing_docs) == plain_merkle(rows)
    empty = merkle.manifest_of(no_docs)
    assert merkle.proofs(empty).count() == 0 and empty.top.root is None
    made = merkle.manifest_of(clashing_docs)
    made.write(str(tmp_path / "manifest"))
    told = spark.read.json(str(tmp_path / "manifest")).first()
    assert told["root"] == made.top.root and sum(g["leaves"] for g in told["groups"]) == len(rows)


def test_height_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_BLOCKS", 1)
    rows = spark.range(3000).select(F.lit("g").alias("group"), "id", merkle.leaf(F.col("id")).alias("leaf"))
    assert merkle.build(rows).top.height == 4
    monkeypatch.setattr(merkle, "MOST_TOPS", 0)
    with pytest.raises(ValueError, match="groups"):
        merkle.build(rows)


# ---------------------------------------------------------------- resharding


def cheapest(sizes, capacities, old_zones, new_zones):
    """The least cost over all ways to give each unit of each old shard a new one."""
    price = lambda i, j: 0 if i == j else 1 if old_zones[i] == new_zones[j] else 2
    units = [i for i, s in enumerate(sizes) for _ in range(s)]
    best = None
    for way in itertools.product(range(len(capacities)), repeat=len(units)):
        if all(way.count(j) <= c for j, c in enumerate(capacities)):
            cost = sum(price(i, j) for i, j in zip(units, way, strict=True))
            best = cost if best is None else min(best, cost)
    return best


def test_flow_is_the_cheapest():
    rng = random.Random(9)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        sizes = [rng.randint(0, 2) for _ in range(n)]
        capacities = [rng.randint(0, 3) for _ in range(m)]
        capacities[-1] += max(0, sum(sizes) - sum(capacities))
        old_zones, new_zones = [rng.randint(0, 1) for _ in range(n)], [rng.randint(0, 1) for _ in range(m)]
        flow = sharding.transfers(sizes, capacities, old_zones, new_zones)
        assert [sum(b for (i, _), b in flow.items() if i == k) for k in range(n)] == sizes
        assert all(sum(b for (_, j), b in flow.items() if j == k) <= c for k, c in enumerate(capacities))
        cost = sum(b * (0 if i == j else 1 if old_zones[i] == new_zones[j] else 2) for (i, j), b in flow.items())
        assert cost == cheapest(sizes, capacities, old_zones, new_zones)
    with pytest.raises(ValueError, match="do not fit"):
        sharding.transfers([5], [4])


def test_flow_of_many_shards():
    rng = random.Random(10)
    sizes = [rng.randrange(10**9) for _ in range(3000)]
    capacities = sharding.even(sum(sizes), 3500)
    flow = sharding.transfers(sizes, capacities)
    assert sum(b for (i, j), b in flow.items() if i != j) == sum(max(0, s - capacities[i]) for i, s in enumerate(sizes))
    assert len(flow) < 3 * 6500


def test_plan_moves_what_the_flow_says():
    rng = random.Random(11)
    for _ in range(40):
        shards = [[sharding.Part(f"{i}/{k}", rng.randint(1, 50), 1) for k in range(rng.randrange(12))] for i in range(rng.randint(1, 5))]
        sizes = [sum(p.size for p in parts) for parts in shards]
        count = rng.randint(1, 6)
        flow = sharding.transfers(sizes, sharding.even(sum(sizes), count))
        plan = sharding.planned(shards, flow, count)
        known = {p.path: p for parts in shards for p in parts}
        got = Counter()
        for j, parts in enumerate(plan.stay):
            assert all(p.path.startswith(f"{j}/") for p in parts)
            got.update({(j, j): sum(p.size for p in parts)})
        for path, j in plan.move.items():
            got[int(path.split("/")[0]), j] += known[path].size
        for path, parts in plan.split.items():
            assert sum(parts.values()) == known[path].size
            for j, b in parts.items():
                got[int(path.split("/")[0]), j] += b
        assert +got == Counter(flow)


def layout_rows(spark, layout):
    return sharding.read(spark, layout).collect()


def test_shards_are_even_and_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.op13_resharding(spark, sf).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    assert sorted(shards) == list(range(8)) and {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    total = sum(r["size"] for r in rows)
    for part in shards.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 8) < 0.01 * total / 8


def test_files_that_stay_are_not_touched(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(6, "doc_id")
    old = sharding.lay_out(docs, F.pmod("doc_id", F.lit(4)), 4)
    sizes = old.sizes()
    # a fifth shard takes from the others what they have over
    goal = sharding.even(sum(sizes), 5)
    new = sharding.reshard(spark, old, goal)
    before, after = ({p for parts in x.shards for p in parts} for x in (old, new))
    assert before & after and {p.path for p in after - before}.isdisjoint(p.path for p in before)
    moved = sum(max(0, s - c) for s, c in zip(sizes, goal, strict=False))
    split = max(p.size for p in before)
    assert sum(p.size for p in after - before) <= moved + 2 * 5 * split
    assert all(abs(s - c) < 2000 for s, c in zip(new.sizes(), goal, strict=True))
    assert sharding.drop_superseded(spark, old, new) == len(before - after)
    key = lambda df: sorted((r["doc_id"], r["text"] or "", r["source"] or "") for r in df.collect())
    assert key(sharding.read(spark, new)) == key(docs)
    # nothing moves between equal capacities
    assert sharding.reshard(spark, new, new.sizes()) == new


def test_resharding_odd_rows(spark, clashing_docs, no_docs):
    old = sharding.lay_out(clashing_docs, F.lit(1), 2)
    new = sharding.reshard(spark, old, sharding.even(sum(old.sizes()), 3))
    rows = layout_rows(spark, new)
    assert Counter(str(r[c]) for r in rows for c in clashing_docs.columns) == Counter(str(r[c]) for r in clashing_docs.collect() for c in clashing_docs.columns)
    for j in range(3):
        assert sorted(r["tidemark_slot"] for r in rows if r["tidemark_shard"] == j) == list(range(sum(r["tidemark_shard"] == j for r in rows)))
    empty = sharding.lay_out(no_docs, F.lit(0), 1)
    assert empty.sizes() == [0] and layout_rows(spark, sharding.reshard(spark, empty, [0, 0])) == []

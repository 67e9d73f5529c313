"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Base spans: e-mail and IP addresses, card and phone numbers, found by pattern, leftmost and non-overlapping per kind;
matches that fail their check are dropped. The values found are the protected entities. For an entity e in n(e)
different texts and a term t (a run of letters, digits and '_' of ``TERM_CHARS`` characters at least, one of them a
letter) in n(t), the pointwise mutual information over the information of e,

    PMI(e; t) / IC(e) = log(p(t | e) / p(t)) / log(N / n(e)),

is how much of e the term discloses. The two p are Laplace's estimates, (n(e, t) + 1) / (n(e) + 2) and (n(t) + 1) / (N + 2):
few texts count for less, but no entity or term is left out for standing in few. Terms at or above ``THRESHOLD`` for any
entity are disclosed wherever they stand, and their occurrences outside base spans are
spans of kind ``term``. Copies and near copies of a text (by min-hashes of their terms, three quarters of which agree)
count as one text in n(e), n(t), n(e, t) and N, whichever of them holds e or t.

Defined results: null text is empty and has no spans; repeated rows get the same spans; null ids stay; very long texts are
searched whole; overlapping spans of different kinds all stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, release, saved, table

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
THRESHOLD = 0.85
TERM_CHARS = 3
WORD = r"[\p{L}\p{N}_]+"
#: Disclosing terms of a text up to which each of its words is compared with them in place.
FEW_TERMS = 32
#: Near copies: SKETCH least hashes of a text's terms, compared where BAND of them in a row agree; AGREED of them must.
SKETCH, BAND, AGREED = 16, 4, 12

# The contract's patterns, made possessive where a shorter run could not match either, and tried only at the start of a
# run of their first class or where the last match ended: so long runs cost linear time and no stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# what a text must hold for the pattern to be worth a search
HINTS = {"email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9][\x20().0-9-]"}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    back = F.reverse(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """The check of a match."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.right(F.concat(F.lit("000"), p), F.lit(3)) <= "255")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def located(text: Column, pattern: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, value>> of the leftmost non-overlapping matches, starts in code points; of those ``wanted`` only.

    The gaps between matches are what split() leaves; a start is the sum of the gaps and matches before it, summed
    by blocks (as many as each has matches) so that many matches cost little more than few."""
    # each step is bound to a lambda's variable, so nothing is evaluated again for every match

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def steps(m: Column) -> Column:
        one = lambda i: F.length(F.element_at(m["gaps"], i)) + F.when(i > 1, F.length(F.element_at(m["found"], F.greatest(i - 1, F.lit(1))))).otherwise(0)
        return F.struct(m["found"].alias("found"), F.transform(F.sequence(F.lit(1), F.size(m["found"])), one).alias("steps"), F.greatest(F.lit(8), F.sqrt(F.size(m["found"])).cast("int")).alias("block"))

    def sums(m: Column) -> Column:
        one = lambda b: total(F.slice(m["steps"], b * m["block"] + 1, m["block"]))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m["found"]) - 1) / m["block"]).cast("int")), one)
        return F.struct(m["found"].alias("found"), m["steps"].alias("steps"), m["block"].alias("block"), blocks.alias("sums"))

    def places(m: Column) -> Column:
        def one(x: Column) -> Column:
            i = x["i"]
            b = F.floor(i / m["block"]).cast("int")
            return F.struct((total(F.slice(m["sums"], F.lit(1), b)) + total(F.slice(m["steps"], b * m["block"] + 1, i - b * m["block"] + 1))).alias("start"), x["value"].alias("value"))

        every = F.transform(m["found"], lambda value, i: F.struct(i.alias("i"), value.alias("value")))
        return F.transform(every if wanted is None else F.filter(every, lambda x: wanted(x["value"])), one)

    matched = F.array(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")))
    return F.flatten(F.transform(F.transform(F.transform(matched, steps), sums), places))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (index), stop, value>>, sorted."""
    none = F.expr("CAST(array() AS array<struct<start: int, kind: int, stop: int, value: string>>)")

    def of(k: int, kind: str) -> Column:
        good = F.filter(located(text, F.lit(PATTERNS[kind])), lambda m: _holds(kind, m["value"]))
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["value"])).alias("stop"), m["value"].alias("value")))
        return F.when(text.rlike(HINTS[kind]) & text.rlike(PATTERNS[kind]), spans).otherwise(none)

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def _terms(text: Column) -> Column:
    """Distinct lower-cased terms."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+")), lambda t: (F.length(t) >= TERM_CHARS) & t.rlike(r"\p{L}"))


def _bare(text: Column) -> Column:
    """The text without what the patterns find."""
    for kind in KINDS:
        text = F.when(text.rlike(HINTS[kind]), F.regexp_replace(text, PATTERNS[kind], " ")).otherwise(text)
    return text


def _sketch(terms: Column) -> Column:
    """array<int> of the least hash of the terms under each of SKETCH hash functions (nulls where there are no terms)."""

    def least(hs: Column, i: int) -> Column:
        return F.array_min(F.transform(hs, lambda x: F.hash(x, F.lit(i))))

    return F.element_at(F.transform(F.array(F.transform(terms, lambda t: F.xxhash64(t))), lambda hs: F.array(*[least(hs, i) for i in range(SKETCH)])), 1)


def _identity(text: Column) -> Column:
    """16 bytes that tell different texts apart."""
    return F.unhex(F.md5(text))


def maybe_in(column: Column, keys: DataFrame) -> Column:
    """Whether ``column`` may be among the values of the one column of ``keys``: a bitmap of 16 bits a key, of 8 MB at most.
    It only thins out what goes into an exact join."""
    words = 1 << min(20, max(10, (keys.count() // 4).bit_length()))

    def place(key: Column) -> tuple[Column, Column]:
        p = F.pmod(F.xxhash64(key), F.lit(words * 64))
        return F.shiftright(p, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))

    word, mask = place(F.col("key"))
    rows = keys.toDF("key").select(word.alias("word"), mask.alias("mask")).union(keys.sparkSession.range(words).select(F.col("id").cast("int"), F.lit(0).cast("long")))
    # a fixed number of words ends in one row
    bits = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"])).scalar()
    word, mask = place(column)
    return F.get(bits, word).bitwiseAND(mask) != 0


def near_copies(docs: DataFrame) -> DataFrame:
    """h, g and rows of every different text: near copies have one g, the h of one of them."""
    texts = saved(docs.select("h", _sketch(_terms(_bare(F.col("text")))).alias("sketch")).groupBy("h").agg(F.first("sketch").alias("sketch"), F.count("*").alias("rows")), "sanitise-sketches")
    bands = [F.xxhash64(F.lit(b), *[F.col("sketch")[b + j] for j in range(BAND)]) for b in range(0, SKETCH, BAND)]
    keyed = texts.where(F.col("sketch")[0].isNotNull()).select("h", F.explode(F.array(*bands)).alias("key"))
    # each text of a key is held against the key's first; only then are sketches fetched
    firsts = keyed.groupBy("key").agg(F.min("h").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    pairs = keyed.join(firsts, "key").where("first < h").select("h", "first").distinct()
    sketches = texts.select("h", "sketch")
    both = pairs.join(sketches, "h").join(sketches.select(F.col("h").alias("first"), F.col("sketch").alias("other")), "first")
    agreed = F.size(F.filter(F.zip_with("sketch", "other", lambda a, b: a == b), lambda x: x))
    links = saved(both.where(agreed >= AGREED).groupBy("h").agg(F.min("first").alias("g")), "sanitise-links")
    while True:  # a link leads to a smaller h, so the ends are reached; each step halves the way
        ups = links.select(F.col("h").alias("g"), F.col("g").alias("up"))
        if links.join(ups, "g", "left_semi").isEmpty():
            break
        longer = saved(links.join(ups, "g", "left").select("h", F.coalesce("up", "g").alias("g")), "sanitise-links")
        discard(links)
        links = longer
    groups = saved(texts.join(links, "h", "left").select("h", F.coalesce("g", "h").alias("g"), "rows"), "sanitise-groups")
    discard(texts, links)
    release(docs.sparkSession)
    return groups


def _share(n: int, n_e: Column, n_t: Column, n_et: Column) -> Column:
    """PMI(e; t) / IC(e) of N groups."""
    ratio = (n_et + 1) / (n_e + 2) * F.lit(float(n + 2)) / (n_t + 1)
    return F.log(ratio) / F.log(F.lit(float(max(n, 2))) / F.least(n_e, F.lit(max(n, 2) - 1)))


def disclosing_terms(docs: DataFrame, based: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame] | None:
    """The terms that disclose an entity, and (h, t) of the texts that hold one (saved). ``docs`` has text and its identity h,
    ``based`` h, base and the texts that have spans. None if there are none.

    A term in h_t groups that hold entities is in as many groups at least, which rules most terms out before the whole
    corpus is searched for the others."""
    value = lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), F.when(s["kind"] >= 2, _digits(s["value"])).otherwise(F.lower(s["value"])))
    holders = saved(based.where(F.size("base") > 0).select("h", F.array_distinct(F.transform("base", value)).alias("entities"), "text").dropDuplicates(["h"]), "sanitise-holders")
    if holders.isEmpty():
        return None
    groups = near_copies(docs)
    n = groups.where("h = g").count()
    near = holders.join(groups.select("h", "g"), "h")
    beside = near.select("g", F.explode("entities").alias("e")).distinct()
    # entities of the same groups have the same counts with every term: one of them stands for all
    place = [F.bit_xor(F.xxhash64("g")).alias("x"), F.bit_xor(F.xxhash64("g", F.lit(1))).alias("y")]
    often = beside.groupBy("e").agg(F.count("*").alias("n_e"), *place).groupBy("n_e", "x", "y").agg(F.min("e").alias("e")).select("e", "n_e")
    entities = saved(beside.join(often, "e").select("g", "e", "n_e"), "sanitise-entities")
    words = saved(near.select("g", F.explode(_terms(_bare(F.col("text")))).alias("t")).distinct(), "sanitise-words")
    # the least n(t) that any term has: h_t; the greatest n(e, t): n(e)
    most = entities.agg(F.max("n_e")).first()[0]
    held = words.groupBy("t").agg(F.count("*").alias("h_t")).where(_share(n, F.lit(most), F.col("h_t"), F.lit(most)) >= threshold)
    near_pairs = words.join(held, "t").join(entities, "g").where(_share(n, F.col("n_e"), F.col("h_t"), F.col("n_e")) >= threshold)
    pairs = near_pairs.groupBy("e", "n_e", "t", "h_t").agg(F.count("*").alias("n_et"))
    pairs = saved(pairs.where(_share(n, F.col("n_e"), F.col("h_t"), F.col("n_et")) >= threshold).select("t", "h_t", "n_e", "n_et").distinct(), "sanitise-pairs")
    discard(holders, entities, words)
    if pairs.isEmpty():
        return None
    candidates = saved(pairs.select("t").distinct(), "sanitise-candidates")
    every = docs.select("h", F.explode(_terms(F.col("text"))).alias("t")).where(maybe_in(F.col("t"), candidates))
    uses = saved(every.distinct().join(candidates, "t", "left_semi"), "sanitise-uses")
    counts = uses.join(groups.select("h", "g"), "h").select("g", "t").distinct().groupBy("t").agg(F.count("*").alias("n_t"))
    known = pairs.join(counts, "t", "left").withColumn("n_t", F.greatest("n_t", "h_t"))
    told = saved(known.where(_share(n, F.col("n_e"), F.col("n_t"), F.col("n_et")) >= threshold).select("t").distinct(), "sanitise-terms")
    kept = saved(uses.join(told, "t", "left_semi").select("h", "t"), "sanitise-kept")
    discard(groups, pairs, candidates, uses)
    release(docs.sparkSession)
    return told, kept


def _occurrences(docs: DataFrame, uses: DataFrame) -> DataFrame:
    """h and spots (array<struct<start, kind, stop>>) of the terms t in the texts h of ``uses``: every word of such a text
    is looked up among the text's terms, in place if they are few, else by a join."""
    of_text = saved(uses.groupBy("h").agg(F.collect_list("t").alias("terms")), "sanitise-texts")
    own = docs.select("h", "text").where(maybe_in(F.col("h"), of_text.select("h"))).groupBy("h").agg(F.first("text").alias("text"))
    texts = saved(own.join(of_text, "h"), "sanitise-texts")
    spot = lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), (m["start"] + F.length(m["value"])).alias("stop"))
    own_words = located(F.col("text"), F.lit(WORD), lambda value: F.array_contains("terms", F.lower(value)))
    few = texts.where(F.size("terms") <= FEW_TERMS).select("h", F.transform(own_words, spot).alias("spots"))
    many = texts.where(F.size("terms") > FEW_TERMS).select("h", F.explode(located(F.col("text"), F.lit(WORD))).alias("m")).withColumn("t", F.lower("m.value"))
    many = many.join(uses, ["h", "t"]).groupBy("h").agg(F.array_sort(F.collect_list(spot(F.col("m")))).alias("spots"))
    found = saved(few.union(many), "sanitise-spots")
    discard(of_text, texts)
    return found


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), base and spans (base and terms), each array<struct<start, kind, stop, ...>>."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", _identity(F.col("text")))
    searched = texts.withColumn("base", base_spans(F.col("text")))
    based = saved(searched.select("doc_id", "h", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "sanitise-base")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    found = disclosing_terms(texts, based)
    if found is None or found[1].isEmpty():
        return based.select("doc_id", "h", "base", plain.alias("spans"))
    spots = _occurrences(texts, found[1])
    both = based.drop("text").join(spots, "h", "left")
    outside = F.filter("spots", lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return both.select("doc_id", "h", "base", F.when(F.col("spots").isNotNull(), F.array_sort(F.concat(plain, outside))).otherwise(plain).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span generalised to its kind in brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{k}]") for k in (*KINDS, TERM)])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    spans = find_spans(docs).select("h", "spans").dropDuplicates(["h"])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", _identity(F.col("text")))
    return texts.join(spans, "h").select("doc_id", whole.alias("text"))


def op9_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    # a function of two arguments would get each span's place as the second
    count = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]  # noqa: B023
    return found.select("doc_id", *count, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op9_sanitisation": op9_sanitisation}

"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding: lower case, look-alike letters of other alphabets to Latin ones, invisible characters out, digits and signs
that stand for letters inside or at the ends of words to those letters, everything else to one space. The lexicon
holds words and word beginnings; weights are log-odds of document frequencies in labelled documents. Matches inside
an exception phrase (a lexicon word beside a neighbour that labelled clean documents share and toxic ones do not)
do not count. The sums, normalised by length, go through a logistic calibration. Ids, languages and sources are no inputs.

Defined results: null and empty texts score as texts without matches; very long texts are scanned whole; repeated
rows score alike; without labels of both classes every score is 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.labelled import training_sample
from tidemark.llm.shared import fit_logistic, map_arrow, sigmoid, table, with_columns

# fixed values: letters that look like Latin ones
LOOKALIKES = "аaеeоoрpсcхxуyіiѕsјjкkмmтtнhвbԁdɡgһhαaοoεeιiρpτtυuνvκk"
# fixed values: digits and signs that stand for letters
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_LETTERS = str.maketrans({**dict(zip(LOOKALIKES[::2], LOOKALIKES[1::2], strict=True)), **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}, **dict.fromkeys("\u00ad\u200b\u200c\u200d\u2060\ufeff", None)})
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in _LETTERS) + "]")
_DIGITS = str.maketrans(SUBSTITUTES)
_STAND_IN = re.compile(r"[013457@$!]+")
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = range(4, 8)


def _letter(m: re.Match) -> str:
    """A run of digits or signs as letters, if it stands in a word, begins one (no '!') or ends one (digits only)."""
    text, a, b = m.string, m.start(), m.end()
    after = b < len(text) and text[b].isalpha()
    before = a > 0 and text[a - 1].isalpha()
    if after and (before or "!" not in m[0]) or before and not after and m[0].isdigit() and not (b < len(text) and text[b].isalnum()):
        return m[0].translate(_DIGITS)
    return m[0]


def fold(text: str) -> str:
    """Lower case, look-alikes to Latin letters, invisible characters out, digits and signs in words to letters."""
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_LETTERS)
    return _STAND_IN.sub(_letter, text)


class Model:
    """lexicon: pattern -> weight, where a pattern is 'word ' (to its end) or 'beginning'; exceptions: 'word word'."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str], weights: np.ndarray | None = None):
        self.lexicon, self.exceptions, self.weights, self._machine = lexicon, set(exceptions), weights, None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def matches(self, folded: str) -> dict[int, float]:
        """Start of each matched word -> the greatest weight there."""
        if not self.lexicon:
            return {}
        if self._machine is None:
            made = ahocorasick.Automaton()
            both: dict[str, list[float]] = {}
            for p, w in self.lexicon.items():
                both.setdefault(p.rstrip(" "), [0.0, 0.0])[p.endswith(" ")] = w
            for p, (beginning, whole) in both.items():
                made.add_word(p, (len(p), beginning, whole))
            made.make_automaton()
            self._machine = made
        at: dict[int, float] = {}
        n = len(folded)
        for end, (size, beginning, whole) in self._machine.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalpha():
                continue
            weight = max(beginning, whole) if end + 1 == n or not folded[end + 1].isalpha() else beginning
            if weight > at.get(start, 0.0):
                at[start] = weight
        return at

    def inputs(self, text: str) -> list[float]:
        folded = fold(text)
        at = self.matches(folded)
        if at and self.exceptions:
            beside = pairs_at(folded, at)
            at = {k: w for k, w in at.items() if self.exceptions.isdisjoint(beside[k])}
        total, n = sum(at.values()), max(1, text.count(" ") + text.count("\n"))
        return [total / 10, total / math.sqrt(n), 10 * total / n, math.log1p(total), max(at.values(), default=0.0), math.log1p(n) * bool(at) / 5]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = np.array([self.inputs(t) for t in texts], float).reshape(-1, 6)
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def pairs_at(folded: str, starts: Iterable[int]) -> dict[int, list[str]]:
    """The words at ``starts``, each with its left and with its right neighbour, however far off."""
    every = [(m.start(), m[0]) for m in _WORD.finditer(folded)]
    number = {start: i for i, (start, _) in enumerate(every)}
    found = {}
    for start in starts:
        i = number.get(start)
        pairs = [] if i is None else [(j, j + 1) for j in (i - 1, i) if 0 <= j < len(every) - 1]
        found[start] = [f"{every[j][1]} {every[k][1]}" for j, k in pairs]
    return found


def _counts(texts: list[str]) -> Counter:
    """Documents of each word ('word ') and of each beginning of a longer word."""
    found: Counter = Counter()
    for t in texts:
        every = set(_WORD.findall(t))
        found.update([f"{w} " for w in every])
        found.update({w[:k] for w in every for k in _PREFIXES if len(w) > k})
    return found


def learn_lexicon(toxic: Counter, n_toxic: int, clean: Counter, n_clean: int, least: int = 4, z: float = 3.2, most: int = 5000) -> dict[str, float]:
    """Patterns whose log-odds are above 2 and stand ``z`` deviations above zero; the ``most`` surest of them."""
    found = []
    for p, k in toxic.items():
        k0 = clean.get(p, 0)
        if k < least or k < 2 * k0:
            continue
        odds = math.log((k + 0.5) / (n_toxic - k + 0.5)) - math.log((k0 + 0.5) / (n_clean - k0 + 0.5))
        sure = odds / math.sqrt(1 / (k + 0.5) + 1 / (k0 + 0.5))
        if odds > 2 and sure >= z:
            found.append((sure, p, odds))
    return {p: w for _, p, w in sorted(found, reverse=True)[:most]}


def learn_exceptions(lexicon: dict[str, float], toxic: list[str], clean: list[str], least: int = 3) -> list[str]:
    """Pairs of neighbouring words, one of them in the lexicon, in ``least`` clean documents and no toxic one."""
    model = Model(lexicon, [])
    found = [Counter(), Counter()]
    for seen, texts in zip(found, (toxic, clean), strict=True):
        for t in texts:
            seen.update({p for pairs in pairs_at(t, model.matches(t)).values() for p in pairs})
    return sorted(p for p, k in found[1].items() if k >= least and p not in found[0])


def train(sample: list[tuple[int, str, int]]) -> Model:
    """Lexicon from one half and calibration inputs from the other, both ways; the final lexicon is from both."""
    if len({y for *_, y in sample}) < 2:
        return Model({}, [])
    rows = [[(fold(t), t, y) for i, (_, t, y) in enumerate(sample) if i % 2 == h] for h in (0, 1)]
    folded = {(h, y): [f for f, _, k in rows[h] if k == y] for h in (0, 1) for y in (0, 1)}
    counts = {k: _counts(v) for k, v in folded.items()}

    def lexicon(halves):
        of = {y: sum((counts[h, y] for h in halves), Counter()) for y in (0, 1)}
        texts = {y: [t for h in halves for t in folded[h, y]] for y in (0, 1)}
        found = learn_lexicon(of[1], len(texts[1]), of[0], len(texts[0]))
        return found, learn_exceptions(found, texts[1], texts[0])

    x, y = [], []
    for h in (0, 1):
        model = Model(*lexicon([h]))
        x += [model.inputs(t) for _, t, _ in rows[1 - h]]
        y += [k for *_, k in rows[1 - h]]
    return Model(*lexicon([0, 1]), fit_logistic(np.array(x), np.array(y, float), l2=0.5))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 2000, max_bytes: int = 12 << 20) -> Model:
    """Learn from at most ``rows`` labelled documents a class and ``max_bytes`` of text (documents whose crc32 mod 5 is not 0)."""
    return train(training_sample(docs, labels, "toxic", 5, 0, rows, max_bytes))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every column of docs, then ``score``; one pass, no shuffle."""
    schema = with_columns(docs.schema, ("score", T.DoubleType()))
    names = [f.name for f in schema][:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 5000 lexicon entries and their exceptions

    def run(batches):
        scorer = shared.value
        for batch in batches:
            texts = batch.column("text")
            got = scorer.score([t.as_py() or "" for t in texts])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(got, pa.float64())], names=[*names, "score"])

    return map_arrow(docs, run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}

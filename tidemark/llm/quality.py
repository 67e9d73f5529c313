"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from good and one from bad labelled text. A text is compressed under
both; the difference of the two sizes, and the lesser size, over the length of the text are the inputs of a logistic
calibration, with the logarithm of the length and its square beside them: what a size means depends on the length. It is
fitted on labelled documents that no dictionary has seen. Ids, languages and sources are no inputs.

Defined results: null and empty texts have no compressed size and get the calibrated score at zero inputs;
very long texts are compressed whole, in one stream; repeated rows are scored alike; where a class has no labelled document with
text the score is 0.5 for all and ``keep_good`` keeps all; labelled documents too few or too short for a trained dictionary
are the dictionary themselves; other columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.labelled import training_sample
from tidemark.llm.shared import fit_logistic, map_arrow, sigmoid, table, text_buffers, with_columns

THRESHOLD = 0.7
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


class Model:
    """Dictionaries and calibration; picklable. Compressors are made once a worker."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None = None):
        self.good, self.bad, self.weights, self._tools = good, bad, weights, None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "_tools": None}

    def _compressors(self):
        if self._tools is None:
            made = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._tools = made
        return self._tools

    def inputs(self, texts: list[memoryview | bytes]) -> np.ndarray:
        good, bad = self._compressors()
        sizes = np.array([(len(t), len(good.compress(t)), len(bad.compress(t))) for t in texts], float).reshape(-1, 3)
        n, g, b = sizes.T
        some = n > 0
        length = np.where(some, n, 1)
        long = np.log2(1 + n)
        over = (b - g) / (length + 16)
        ratio = np.where(some, np.minimum(g, b) / (length + 16), 0.0)
        # a repeated text shrinks under either dictionary: its size against the usual one of its length
        return np.column_stack([10 * np.where(some, over, 0), 10 * np.where(some, np.tanh(40 * over), 0) / 5, 5 * ratio, 5 * np.square(ratio), 5 * np.where(some, np.exp(-ratio * 12), 0), long / 10, long * ratio / 2, np.square(long) / 100])

    def score(self, texts: list[memoryview | bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 0.5)
        x = self.inputs(texts)
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of texts; where they are too few or too short to train one, the texts themselves serve."""
    if len(texts) >= 8:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, texts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(texts)[-DICTIONARY_BYTES:]


def train(sample: list[tuple[int, str, int]]) -> Model | None:
    """Every second document of a class builds its dictionary; the others calibrate, weighted as they are. A class of one document
    has it do both. None where a class has no document with text."""
    by = {y: [t.encode() for _, t, k in sample if k == y] for y in (0, 1)}
    if not all(map(any, by.values())):
        return None
    n = max(1, min(len(by[0]), len(by[1])) // 2 * 2)
    used = {y: set(range(0, n, 2)) if n > 1 else set() for y in (0, 1)}
    made = {y: _dictionary(by[y][:n:2]) or _dictionary([t for t in by[y] if t]) for y in (0, 1)}
    model = Model(made[1], made[0])
    rest = {y: [t for i, t in enumerate(by[y]) if i not in used[y]] for y in (0, 1)}
    x = model.inputs(rest[0] + rest[1])
    y = np.array([0] * len(rest[0]) + [1] * len(rest[1]), float)
    model.weights = fit_logistic(x, y, l2=0.3)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = 2000, max_bytes: int = 12 << 20) -> Model:
    """Learn from at most ``rows`` labelled documents a class and ``max_bytes`` of text (documents whose crc32 mod 4 is not 2)."""
    return train(training_sample(docs, labels, "quality", 4, 2, rows, max_bytes)) or Model(b"", b"")


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Every column of docs, then the score as ``name``; one pass, no shuffle."""
    schema = with_columns(docs.schema, (name, T.DoubleType()))
    names = [f.name for f in schema][:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches):
        scorer = shared.value
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            view = memoryview(data)
            got = scorer.score([view[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(got, pa.float64())], names=[*names, name])

    return map_arrow(docs, run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with the columns of docs."""
    model = fit(docs, labels)
    if model.weights is None:  # without labels of both classes nothing can be rejected
        return docs
    return score(docs, model, "tidemark_score").where(F.col("tidemark_score") >= threshold).drop("tidemark_score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}

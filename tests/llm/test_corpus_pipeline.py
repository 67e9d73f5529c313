import zlib

import numpy as np

import __spark_entry__
import corpus_pipeline
from tidemark.llm import decontamination, jaccard, mixing, quality, shared
from tidemark.llm.tokens import _tokenizer


def test_stages_against_plain_versions(spark):
    """Each stage on its own input: decisions are those of the operators' rows, applied plainly."""
    sf = "/root/testdata/sf0.01"  # the smallest tables that a classifier can be learnt from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(shared.saved(stage(spark, inputs[-1], sf), "test-stage"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert inputs[-1].columns == docs.columns
    rows = [[tuple(r) for r in x.collect()] for x in inputs]
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")

    model = quality.fit(inputs[0], labels)
    assert sorted(rows[1]) == sorted(r for r in rows[0] if model.score([(r[1] or "").encode()])[0] >= 0.7)
    leaders = {r.component_id for r in jaccard.link_components(inputs[1]).collect()}
    assert sorted(rows[2]) == sorted(r for r in rows[1] if r[0] in leaders)
    dirty = {r.doc_id for r in decontamination.judge(inputs[2], bench).collect() if r.contaminated}
    assert sorted(rows[3]) == sorted(r for r in rows[2] if r[0] not in dirty)
    copies = {r.doc_id: r.copies for r in mixing.mix(inputs[3]).collect()}
    assert sorted(rows[4]) == sorted(r for r in rows[3] for _ in range(copies[r[0]]))
    import public_tokenizers

    tool, start, want = _tokenizer(str(public_tokenizers.path("word_bpe_49k.json"))), 0, []
    for r in sorted(rows[4]):
        ids = np.array([*tool.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(rows[5]) == want


def test_registered():
    known = __spark_entry__.queries()
    assert "pipeline" in known and [sum(k.startswith(f"op{n}_") for k in known) for n in range(1, 11)] == [1] * 10

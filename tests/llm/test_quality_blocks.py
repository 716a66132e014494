"""op3: the evidence of a long text comes from all of it."""

import math

import numpy as np
import zstandard

from sparkweft.llm import quality


def prose(rng, vocabulary, size):
    return " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), size // 4))[:size]


def test_evidence_of_every_part():
    rng = np.random.default_rng(4)
    good, bad = ([" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(6)) for _ in range(300)] for _ in range(2))
    dicts = [quality._dictionary([prose(rng, v, 4000).encode() for _ in range(150)]) for v in (good, bad)]

    def evidence(text):  # y - x
        x, y = (quality._size(quality._compressor(d, quality.LEVEL), text.encode()) for d in dicts)
        return y - x

    block = quality.BLOCK
    head, tail = prose(rng, good, 2 * block), prose(rng, bad, 14 * block)
    assert evidence(head) > 0 > evidence(tail)
    assert evidence(head + tail) < 0 and np.isclose(evidence(head + tail), evidence(head) + evidence(tail))
    assert np.isclose(evidence(head + tail), evidence(tail + head))


def test_scores_by_hand(spark):
    """The scores of a fitted model against the library's own calls, block by block; equal dictionaries in size."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert 0.9 < len(model.good) / len(model.bad) < 1.1
    some = docs.orderBy("doc_id").limit(60)
    got = {r["doc_id"]: r["score"] for r in quality.quality_table(some, model).collect()}
    for r in some.collect():
        raw, sizes = (r["text"] or "").encode(), []
        for content in (model.good, model.bad):
            size = 0
            for i in range(0, len(raw), quality.BLOCK):
                c = zstandard.ZstdCompressionDict(content)
                c.precompute_compress(level=quality.LEVEL)
                size += len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=c, write_content_size=False, write_dict_id=False).compress(raw[i : i + quality.BLOCK]))
            sizes.append(size)
        x, y = sizes
        d = (y - x + 64 * model.average) / (len(raw) + 64)
        z = model.weights[0] + model.weights[1] * d + sum(w * max(d - k, 0) for w, k in zip(model.weights[2:], model.bends, strict=True))
        assert math.isclose(got[r["doc_id"]], 1 / (1 + math.exp(-z)), rel_tol=1e-9, abs_tol=1e-12)


def test_sample_does_not_depend_on_layout(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    assert quality.fit_quality(docs, labels) == quality.fit_quality(docs.repartition(5), labels.repartition(3))

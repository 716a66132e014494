"""The pipeline's near copies against all pairs compared."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from sparkweft.llm import near_copies, simhash


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows):
    """doc_id by doc_id: the least of its group, and the similar pairs of different words."""
    at, sets, ids = defaultdict(list), {}, [k for k, _ in rows]
    for k, t in rows:
        sets[k] = plain_shingles(t)
        for s in sets[k] or {()}:
            at[s].append(k)
    root, pairs = {k: k for k in ids}, []

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in ids:
        shared = Counter(o for s in sets[k] or {()} for o in at[s] if o < k)
        for o, n in shared.items():
            if n * 5 >= 4 * (len(sets[k] or {()}) + len(sets[o] or {()}) - n):
                x, y = sorted((find(k), find(o)))
                root[y] = x
                pairs.append((o, k))
    return {k: find(k) for k in ids}, pairs


def test_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rng = np.random.default_rng(3)
    for k in range(40):  # 200 words of which some are changed: similarities on both sides of 0.8
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((10_000_000 + 10 * k, " ".join(base)))
        for j in range(1, 4):
            edited = list(base)
            for i in rng.integers(0, 200, 2 * j + k % 3):
                edited[i] = f"x{j}"
            rows.append((10_000_000 + 10 * k + j, " ".join(edited)))
    want, pairs = plain_components(rows)
    texts = dict(rows)
    bits = [(simhash.fingerprint(texts[a], 5) ^ simhash.fingerprint(texts[b], 5)).bit_count() for a, b in pairs if near_copies.words(texts[a]) != near_copies.words(texts[b])]
    assert len(bits) > 60 and max(bits) > 8  # what four bits do not reach
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()}
    assert got == want
    kept = corpus_pipeline.keep_one_each(spark, df, None)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_chain(spark):
    """A group whose ends are not similar to each other, in one bucket or in several."""
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([f"y{i}" if i < 12 * k else w for i, w in enumerate(base)])) for k in range(8)]
    df = spark.createDataFrame([*rows, (50, None), (51, " ")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()} == {**{k: 0 for k in range(8)}, 50: 50, 51: 50}

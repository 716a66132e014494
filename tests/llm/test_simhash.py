"""op2 against a quadratic version, and the promise of the Golay keys."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkweft.llm import queries, simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """{fingerprint: smallest id reachable} by comparing all pairs."""
    fps = sorted({f for _, f in rows})
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for k, f in rows:
        r = find(fps.index(f))
        if k is not None:
            least[r] = min(least.get(r, k), k)
    return {f: least.get(find(i)) for i, f in enumerate(fps)}


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_keys_meet(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    keys = [set(simhash.bucket_keys(np.array([v], np.uint64))[1].tolist()) for v in (x, y)]
    assert keys[0] & keys[1]


def test_golay():
    table, count = simhash.golay_tables()
    assert Counter(count.tolist()) == {6: 1771, 1: 277}  # the code is perfect: 1771 words lie 3 bits off
    assert simhash._syndrome(simhash.GENERATOR) == 0 and table.shape == (2048, 6)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbÉ \t .", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def chained():
    """Fingerprints in chains, clusters and alone, with ids in disorder."""
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(40):
        x = int(rng.integers(0, 2**63))
        fps.append(x)
        for _ in range(int(rng.integers(0, 25))):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    centre = int(rng.integers(0, 2**63))
    fps += [centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)][:900]
    ids = rng.permutation(len(fps)).tolist()
    return list(zip(ids, fps, strict=True))


def test_components(spark, monkeypatch):
    rows = chained()
    want = plain_components(rows)
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    monkeypatch.setattr(simhash, "SLICE", 64)  # many tiles
    df = spark.createDataFrame([(signed(f),) for f in {f for _, f in rows}], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for f, least in want.items():
        groups.setdefault(least, set()).add(signed(f))
    for members in groups.values():
        roots = {found.get(m, m) for m in members}
        assert len(roots) == 1
    assert len({found.get(signed(f), signed(f)) for f in want}) == len(groups)
    with pytest.raises(ValueError):
        simhash.links(df, 5)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(7, None, "a", "b"), (3, "", "a", "b"), (9, " \t", "a", "b"), (5, long, "a", "b"), (4, long.upper(), "a", "b"), (4, long.upper(), "a", "b"), (1, "one two", "a", "b"), (None, "one two", "a", "b"), (None, "alone here", "a", "b")]
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert Counter(got) == Counter([(7, 3), (3, 3), (9, 3), (5, 4), (4, 4), (4, 4), (1, 1), (None, 1), (None, None)])
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf):
    docs = [(r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_components(docs)
    got = queries.op2_simhash(spark, sf).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(k, f"{f:016x}", want[f]) for k, f in docs} and len(got) == len(docs)
    assert simhash.fingerprints(spark.range(1).select("id", F.lit("x").alias("text")), key="id").first()["fp"] is not None


def test_hot_buckets_stay_small(spark, monkeypatch):
    """A bucket far over SLICE: no task gathers more than two slices of it, and its links are those of all pairs."""
    monkeypatch.setattr(simhash, "SLICE", 128)
    rng = np.random.default_rng(9)
    low = int(rng.integers(0, 1 << 43))  # one exact segment and one Golay word for all, the third at random
    fps = sorted({low | int(x) << 43 for x in rng.integers(0, 1 << 21, 3000)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    sizes, gathered, tiled = [], simhash._gathered, simhash._tiled

    def watched(f):
        def run(rows):
            out = f(rows)
            sizes.append(out.agg(F.max(F.size("xs") + F.size("ys"))).first()[0] or 0)
            return out

        return run

    monkeypatch.setattr(simhash, "_gathered", watched(gathered))
    monkeypatch.setattr(simhash, "_tiled", watched(tiled))
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    assert len(sizes) == 2 and max(sizes) < 4 * 128
    least = plain_components(list(enumerate(fps)))
    groups = {}
    for f, s in zip(fps, signed, strict=True):
        groups.setdefault(least[f], set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)

"""op7 and op8: the same rows on any layout, plain Python versions of both, and their SQL."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from test_sharding_mixing import ODD, SCHEMA, plain_targets

from sparkweft.llm import mixing, queries, sharding


def bits(*parts):
    return int(hashlib.md5("|".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16)


def uniform(*parts):
    return (bits(*parts) + 0.5) / (1 << 52)


def plain_shards(rows, n=8):
    """(doc_id, size, crc, shard, slot, grown) of (doc_id, text) rows."""
    out, cells = [], defaultdict(list)
    for k, t in rows:
        raw = (t or "").encode()
        best = lambda m: max(range(m), key=lambda i: -1 / math.log(uniform("shard", k, i)))
        size, crc = len(raw) + 1, zlib.crc32(raw)
        cells[best(n)].append((bits("slot", k, size, crc) % sharding.BUCKETS, k is None, k or 0, size, crc, k, best(n + 1)))
    for shard, members in cells.items():
        out += [(m[5], m[3], m[4], shard, slot, m[6]) for slot, m in enumerate(sorted(members))]
    return Counter(out)


def plain_copies(rows, seed=42):
    """(doc_id, size, source, copies) of (doc_id, text, source) rows."""
    by = defaultdict(list)
    for k, t, s in rows:
        by[s].append((len((t or "").encode().split()), k))
    targets = plain_targets({s: sum(n for n, _ in v) for s, v in by.items()})
    out = []
    for s, v in by.items():
        def place(x):
            n, k = x
            low = max(n.bit_length() - 5, 0)
            return (-(16 * low + (n >> low)), bits("part", seed, k, n) % 16, -n, bits("order", seed, k), k is None, k or 0)

        total = sum(n for n, _ in v)
        rate, u = targets[s] / total if total else 0.0, uniform("offset", seed, s)
        for i, (n, k) in enumerate(sorted(v, key=place)):
            out.append((k, n, s, min(math.floor((i + 1) * rate + u) - math.floor(i * rate + u), math.ceil(rate))))
    return Counter(out)


def shard_rows(df):
    return Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["grown_shard"]) for r in sharding.assign_shards(df, [1.0] * 8).collect())


def copy_rows(df):
    return Counter((r["key"], r["size"], r["source"], r["copies"]) for r in mixing.with_copies(df).collect())


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_plain_versions(spark, sf, which):
    docs = spark.createDataFrame(ODD, SCHEMA) if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "source").collect()
    assert shard_rows(docs) == plain_shards([(r[0], r[1]) for r in rows])
    assert copy_rows(docs) == plain_copies([tuple(r) for r in rows])


def test_any_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n, df in ((4, docs), (37, docs), (200, docs.repartition(7))):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            mixed = Counter(r["doc_id"] for r in mixing.mix_documents(df).select("doc_id").collect())
            got.append((shard_rows(df), copy_rows(df), mixed))
        assert got[0] == got[1] == got[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("name", ["op7_rendezvous", "op8_systematic_mix"])
def test_sql(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    df = queries.queries()[name](spark, d)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want)


def test_size_classes(spark):
    rows = spark.range(5000).select("id", mixing.size_class(mixing.F.col("id")).alias("c")).orderBy("id").collect()
    assert [r["c"] for r in rows[:32]] == list(range(32))
    assert all(0 <= b["c"] - a["c"] <= 1 for a, b in zip(rows[:-1], rows[1:], strict=True))


def test_copies_of_alike_rows_are_dealt_out(spark):
    """Rows without an id and of equal sizes: each different row as often as its places in the sum say."""
    rows = [(None, f"a b c {i % 5}", "en", "s", i) for i in range(60)] + [(None, "a b c 0", "en", "s", 0)] * 40 + [(i, "w " * 50, "en", "t", 0) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sums = Counter()
    for r in mixing.with_copies(df).collect():
        sums[r["key"], r["size"], r["source"]] += r["copies"]
    got, n = Counter(), Counter((r[0], len(r[1].split()), r[3]) for r in rows)
    each = Counter()
    for r in mixing.mix_documents(df).collect():
        got[r["doc_id"], len(r["text"].split()), r["source"]] += 1
        each[tuple(r)] += 1
    assert got == +sums
    key = (None, 4, "s")
    assert abs(each[(None, "a b c 0", "en", "s", 0)] - 41 * sums[key] / n[key]) <= 1

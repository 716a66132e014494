"""The pipeline against brute force: each stage's kept rows, and the rows of run()."""

import hashlib
from collections import Counter

import public_tokenizers
from test_near_copies import plain_components

import corpus_pipeline
from sparkweft.llm import bpe, mixing, quality


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mix", "encode"] and corpus_pipeline.ORACLE_SQL is None


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = [r for r, s in zip(rows, model.scores([r["text"] for r in rows]), strict=True) if s >= quality.THRESHOLD]
    least, _ = plain_components([(r["doc_id"], r["text"]) for r in good])  # all pairs of five-word shingle sets
    one_each = [r for r in good if r["doc_id"] == least[r["doc_id"]]]
    stage = lambda i, d: corpus_pipeline.STAGES[i][1](spark, d, sf)
    first = stage(0, docs)
    assert first.columns == docs.columns and Counter(r["doc_id"] for r in first.collect()) == Counter(r["doc_id"] for r in good)
    kept = spark.createDataFrame(one_each, docs.schema)
    copies = Counter()
    for r in mixing.with_copies(kept).collect():
        copies[r["key"]] += r["copies"]
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    want = Counter()
    for r in one_each:
        ids = enc.encode_ordinary(r["text"])
        want[(r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())] += copies[r["doc_id"]]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want


def test_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string"
    rows = [(1, "same words here now", "en", "s", 1, "x", "y"), (1, "same words here now", "en", "s", 1, "x", "y"), (2, "same words here now", "en", None, 1, "x", "y"), (None, "same words here now", "en", "s", 1, "x", "y"), (None, "no other text", "en", "s", 1, "x", "y"), (None, "no other text", "en", "s", 1, "x", "y"), (3, None, "en", "s", 0, "x", "y"), (4, "", "en", "s", 0, "x", "y")]
    df = spark.createDataFrame(rows, schema)
    one = corpus_pipeline.keep_one_each(spark, df, sf)
    assert one.columns == df.columns and Counter((r["doc_id"], r["text"]) for r in one.collect()) == Counter([(1, "same words here now"), (None, "no other text"), (3, None)])
    # An id with two texts: each group keeps its row. Texts without an id: one a group.
    two = [(1, "a b c d e f", "en", "s", 1, "x", "y"), (1, "g h i j k l", "de", "s", 1, "x", "y"), (2, "g h i j k l", "en", "t", 1, "x", "y"), (None, "g h i j k l", "en", "t", 1, "x", "y"), (None, "m n o p", "en", "t", 1, "x", "y")]
    got = [tuple(r) for r in corpus_pipeline.keep_one_each(spark, spark.createDataFrame(two, schema), sf).collect()]
    assert Counter(got) == Counter([two[0], two[1], two[4]])
    long = " ".join(f"w{i}" for i in range(60_000))
    some = spark.createDataFrame([(1, long, "en", "s", 1, "x", "y"), (2, long + " end", "en", "s", 1, "x", "y"), (3, None, "en", None, 1, "x", "y"), (3, None, "en", None, 1, "x", "y")], schema)
    assert [r["doc_id"] for r in corpus_pipeline.keep_one_each(spark, some, sf).orderBy("doc_id").collect()] == [1, 3]
    encoded = corpus_pipeline.encode_bpe(spark, some, sf).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in encoded) == Counter([(1, len(long)), (2, len(long) + 4), (3, 0), (3, 0)])
    for f in (corpus_pipeline.keep_good, corpus_pipeline.keep_one_each, corpus_pipeline.mix_sources):
        assert f(spark, df.limit(0), sf).count() == 0 and f(spark, df, sf).columns == df.columns

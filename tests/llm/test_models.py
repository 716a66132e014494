"""op3, op6, op9 and op10: held-out accuracy, brute force and whole probabilities."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sparkweft.llm import html_blocks as H
from sparkweft.llm import language_model as L
from sparkweft.llm import quality, queries, topk

# --- op3 --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.01"
    return d, {r["doc_id"]: r for r in queries.op3_quality(spark, d).collect()}


def test_quality_held_out(spark, scored):
    d, rows = scored
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for k, r in rows.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(rows[k]["score"], q) for k, q in labels.items() if rows[k]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9 and np.mean([s >= 0.3 for s in good]) > 0.95


def test_quality_odd_rows(spark, scored):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "x y", "a"), (3, "!! " * 100_000, "b")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    rows = quality.quality_table(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows) and not next(r for r in rows if r["doc_id"] is None)["held_out"]
    assert rows[0]["score"] == rows[1]["score"] == rows[2]["score"]  # nothing to go by
    kept = quality.score_documents(docs, model)
    assert kept.columns == ["doc_id", "text", "score", "predicted"] and kept.count() == 5
    none = quality.fit_quality(docs.limit(0), labels.limit(0))
    assert quality.quality_table(docs.limit(0), none).count() == 0 and quality.quality_table(docs, none).first()["score"] == 0.5


# --- op6 --------------------------------------------------------------------------------------------------------------


def test_topk_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(queries.OP6_SQL + " ORDER BY 1, 2").fetchall()
    df = queries.op6_exact_topk(spark, sf)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert [tuple(r) for r in df.orderBy("query_id", "rank").collect()] == want


def brute(rows, k=10):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in ok if i % 100 == 0}:
        a = next(v for i, v in ok if i == q)
        scores = [(-int(a[: min(len(a), len(v))] @ v[: min(len(a), len(v))]), i) for i, v in ok if i != q]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def test_topk_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(400)]
    rows += [(401, None), (402, [1.0, None]), (403, [float("nan")] * 6), (404, [float("inf")] + [1.0] * 5), (None, [9.0] * 6), (405, [3.0]), (406, []), (407, rows[0][1]), (408, rows[0][1]), (500, [1e6] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df).collect()} == brute(rows)
    clash = df.selectExpr("*", "vec_id AS key", "'x' AS v", "1 AS cell", "2 AS ids", "3 AS rank").repartition(5)
    assert {tuple(r) for r in topk.top_k(clash).collect()} == brute(rows)
    twice = spark.createDataFrame([*rows[:50], (0, [5.0] * 6), (7, rows[7][1])], "vec_id long, embedding array<double>")
    a, b = (sorted(map(tuple, topk.top_k(twice.repartition(n)).collect())) for n in (1, 6))
    assert a == b and len(a) == 10
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(few).collect()} == brute(rows[:4])
    assert topk.top_k(df.limit(0)).count() == 0


def test_blocks_are_pruned():
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(20_000, 8)) * 100 + np.repeat(rng.normal(size=(200, 8)) * 2000, 100, axis=0)).astype(np.int64)
    best, scores, scored = topk.search(np.array([-1]), rows[:1], np.arange(20_000), rows, 10, block=100)
    want = sorted(((-int(s), i) for i, s in enumerate(rows @ rows[0])))[:10]
    assert best[0].tolist() == [i for _, i in want] and scores[0].tolist() == [-s for s, _ in want] and scored < 60


def test_most_blocks_are_pruned_whatever_the_order_of_ids():
    """Clustered vectors in random order: rows are put into blocks by likeness, and a first pass gives a threshold."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(100, 64)) * 300
    rows = (centres[rng.integers(0, 100, 12_800)] + rng.normal(size=(12_800, 64)) * 30).astype(np.int64)
    ids, asked = np.arange(12_800), rng.choice(12_800, 40, replace=False)
    seeds = rng.choice(12_800, 1000, replace=False)
    blind = topk.Range(ids, rows).search(asked, rows[asked], 10)
    least = topk.least_scores(asked, rows[asked], seeds, rows[seeds], 10)
    best, scores, scored = topk.Range(ids, rows).search(asked, rows[asked], 10, least)
    for q, a in enumerate(asked.tolist()):
        want = sorted((-int(s), i) for i, s in enumerate(rows @ rows[a]) if i != a)[:10]
        assert best[q].tolist() == [i for _, i in want] and scores[q].tolist() == [-s for s, _ in want]
    blocks = 40 * -(-12_800 // topk.BLOCK)
    assert scored <= blind[2] and scored < 0.15 * blocks
    # Four ranges, with 32 rows of a cluster each: blocks of no more rows, and the threshold shared.
    split = [topk.Range(ids[k::4], rows[k::4], 16).search(asked, rows[asked], 10, least)[2] for k in range(4)]
    assert sum(split) < 0.3 * 40 * 4 * 200


# --- op9 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("page", "want"), [
    ("", []), (None, []), ("plain &amp; text", ["plain & text"]), ("<p>a<p>b", ["a", "b"]), ("<p>a <b>b</b>\n\t c<br>d</p>e", ["a b c d", "e"]),
    ("<script>var x='</p>'</script><p>x</p><style>p{}</style>", ["x"]), ("<p>x<!-- y --></p><!-- cut", ["x"]), ("<p>1 < 2 &lt; 3</p>", ["1 < 2 < 3"]), ("<ul><li>a<li>b</ul>", ["a", "b"]), ("<p>a</p><p", ["a"]),
    ("<a title='>'>t</a>", ["t"]), ("<p>&nbsp;</p><p>x&copy</p>", ["x©"]), ("</div><p>x</p></p>", ["x"]), ("<script>never closed", []),
])
def test_blocks(page, want):
    assert [b.text for b in H.blocks(page)] == want


def test_block_paths():
    b = H.blocks('<div class="postBody main-text"><ul><li>a<li>b</ul><p>c</div><p>d')
    assert [x.path for x in b] == [("t:div", "c:post", "c:body", "c:main", "c:text", "t:ul", "t:li")] * 2 + [("t:div", "c:post", "c:body", "c:main", "c:text", "t:p"), ("t:p",)]


def test_gradient():
    """The way back against differences."""
    rng = np.random.default_rng(0)
    model = H.Labeller({k: v.astype(np.float64) for k, v in H.Labeller.fresh(rng).w.items()})
    data = H.invented_pages(3, 11)
    pages, labels = [H.describe(b) for b, _ in data], [y for _, y in data]
    _, grad = model.gradient(pages, labels)
    for name in ("xf", "hb", "out", "bf", "path"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        was, losses = model.w[name][at], []
        for step in (1e-2, -1e-2):
            model.w[name][at] = was + step
            losses.append(model.gradient(pages, labels)[0])
        model.w[name][at] = was
        assert abs((losses[0] - losses[1]) / 2e-2 - grad[name][at]) < 2e-3 + 0.05 * abs(grad[name][at])


def test_main_text(spark, sf):
    model = H.trained()
    data = H.invented_pages(200, 999)  # held-out pages
    kept = model.keep([b for b, _ in data])
    wrong = sum(int((k != (y > 0.5)).sum()) for k, (_, y) in zip(kept, data, strict=True))
    assert wrong / sum(len(y) for _, y in data) < 0.02
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op9_main_text(spark, sf).collect()}
    want = {r["page_id"]: "\n".join(b.text for b in H.blocks(r["html"]) if "t:article" in b.path) for r in pages.collect()}
    assert sum(got[k]["text"] == v for k, v in want.items()) >= 0.98 * len(want) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    odd = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 1), (2, "u", "<p>", 1), (3, "u", "<article>" + "<p>Word and word again.</p>" * 3000, 1)], "page_id long, url string, html string, text int")
    rows = sorted(H.extract(odd, model).collect(), key=lambda r: r["page_id"])
    assert [r["n_chars"] for r in rows][:3] == [0, 0, 0] and rows[3]["text"].count("\n") == 2999
    assert H.extract(odd.limit(0), model).count() == 0


# --- op10 -------------------------------------------------------------------------------------------------------------


def base_scores(rows):
    tokens = [(k, [*(t or "").encode().lower().split(), None]) for k, t in rows]
    c = Counter(w for k, ws in tokens if k is None or zlib.crc32(str(k).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    return n, [(k, len(ws), sum(w in c for w in ws), sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for k, ws in tokens]


def test_language_model(spark, sf, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 2500)  # most words are joined
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, want = base_scores([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r for r in L.score_documents(docs).collect()}
    assert len(got) == len(want)
    for k, size, known, base in want:
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (size, known, n, zlib.crc32(str(k).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def invented_lexicon(n=3000, least=100):
    rng = np.random.default_rng(2)
    counts = np.sort(rng.integers(5, 500, n))[::-1].astype(np.int64)
    kinds, placed = rng.integers(0, L.KINDS, n).astype(np.int32), int((counts >= least).sum())
    other, other_words = np.bincount(kinds[placed:], counts[placed:], L.KINDS), np.bincount(kinds[placed:], minlength=L.KINDS).astype(float)
    return L.Lexicon(pa.array([b"w%d" % i for i in range(n)]), counts, kinds, placed, int(counts.sum()), n, other, other_words)


@pytest.mark.parametrize("most", [1, 7, 300, 4095])
def test_row_sums(most):
    rng = np.random.default_rng(most)
    rows = np.minimum(rng.integers(0, 1 << 12, 4096), rng.integers(0, most + 1, 4096)).astype(np.int32)  # from one row to some thousands
    grad = rng.normal(size=(4096, 5)).astype(np.float32)
    want = np.zeros((1 << 12, 5))
    np.add.at(want, rows, grad)
    where, total = L._row_sums(rows, grad)
    counts = np.bincount(rows, minlength=1 << 12)[where]
    assert sorted(where.tolist()) == np.unique(rows).tolist() and (np.diff(counts) <= 0).all() and counts[0] > L.LAYERS
    assert np.abs(total - want[where]).max() < 1e-3
    one, total = L._row_sums(np.array([3], np.int32), grad[:1])
    assert one.tolist() == [3] and (total == grad[:1]).all()


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    lex = invented_lexicon()
    model = L.Model(lex, rng.normal(0, 0.5, L.Model.n_weights(lex)).astype(np.float32))
    assert (model.side - 1) ** 3 < lex.placed <= model.side**3
    context = [7, 1800]
    every = [*range(L.KINDS), *range(L.KINDS, L.KINDS + lex.placed)]  # a kind once, each placed word
    ids = np.array([x for last in every for x in (*context, last)], np.int32)
    each = model.log10(ids, np.arange(0, len(ids), 3))[0][2::3]
    rest = lex.kind_logs
    # A kind's words and one unknown word share the kind's probability.
    shares = np.array([sum((c + L.SMOOTH) / 10 ** rest[k] for c, kk in zip(lex.counts[lex.placed :], lex.kinds[lex.placed :], strict=True) if kk == k) + L.SMOOTH / 10 ** rest[k] for k in range(L.KINDS)])
    assert np.allclose(shares, 1)
    assert abs((10.0**each).sum() - 1) < 1e-3


def test_model_by_plain_loops():
    """Probabilities from the weights, token by token; and that a step goes down the gradient."""
    rng = np.random.default_rng(4)
    lex = invented_lexicon(400, 60)
    model = L.Model(lex, rng.normal(0, 0.5, L.Model.n_weights(lex)).astype(np.float32))
    s, ids = model.side, rng.integers(0, L.KINDS + len(lex.head), 60).astype(np.int32)
    starts = np.array([0, 1, 20])
    got, classes = model.log10(ids, starts)
    n = [*lex.counts[: lex.placed].tolist(), *[0] * (s**3 - lex.placed)]

    def log_softmax(z, k):
        return (z[k] - math.log(sum(math.exp(x) for x in z))) / math.log(10)

    def hashed(*parts):
        return int(model._hash(*(np.array([p]) for p in parts))[0])

    log = lambda x, of: math.log(x / of) if x else -60.0
    top = [*(lex.kind_tokens + L.SMOOTH), *(sum(n[i * s * s : (i + 1) * s * s]) for i in range(s))]
    for i, w in enumerate(ids.tolist()):
        begin = max(x for x in starts.tolist() if x <= i)
        last, skip = (int(ids[i - k]) if i - k >= begin else lex.start for k in (1, 2))
        rank = w - L.KINDS
        klass = w if w < L.KINDS else L.KINDS + rank // (s * s) if rank < lex.placed else int(lex.kinds[rank])
        near = [hashed(last), hashed(skip), hashed(last, skip)]
        want = log_softmax([log(c, sum(top)) + sum(float(t[r, k]) for t, r in zip(model.tables[:3], near, strict=True)) for k, c in enumerate(top)], klass)
        if 0 <= rank < lex.placed:
            a, b = rank // (s * s), rank // s
            parts, members = [sum(n[(a * s + j) * s : (a * s + j + 1) * s]) for j in range(s)], n[b * s : (b + 1) * s]
            want += log_softmax([log(c, sum(parts)) + float(model.tables[3][hashed(a, last), k]) for k, c in enumerate(parts)], b % s)
            want += log_softmax([log(c, sum(members)) + float(model.tables[4][hashed(b + s, last), k]) for k, c in enumerate(members)], rank % s)
        assert classes[i] == klass and abs(got[i] - want) < 1e-3
    for _ in range(5):
        model.learn(ids, starts)
    assert model.log10(ids, starts)[0].sum() > got.sum()


def test_language_model_on_any_layout(spark, sf, monkeypatch):
    """The same scores whatever the partitions, with several slices a round."""
    monkeypatch.setattr(L, "SLICE_TOKENS", 6000)
    monkeypatch.setattr(L, "MODEL_COUNT", 8)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    was, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n, df in ((4, docs), (13, docs.repartition(7))):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append({r["doc_id"]: r["score"] for r in L.score_documents(df).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0].keys() == got[1].keys() and all(math.isclose(v, got[1][k], rel_tol=1e-6) for k, v in got[0].items())


def test_the_model_grows_with_the_corpus(spark):
    sizes = []
    for n in (1, 8):
        rows = [(i, " ".join(f"w{(i * 31 + j * j) % (60 * n)}" for j in range(200))) for i in range(150 * n)]
        lex = L.lexicon(L.count_words(spark.createDataFrame(rows, "doc_id long, text string")))
        sizes.append((lex.placed, L.Model.n_weights(lex)))
    assert sizes[1][0] > 4 * sizes[0][0] and sizes[1][1] > 2 * sizes[0][1]


def test_language_model_odd_rows(spark):
    rows = [(1, None, 1, 1), (2, "", 1, 1), (3, "É é A a", 1, 1), (3, "É é A a", 1, 1), (None, "x \t\x0b y", 1, 1), (30, "word " * 60_000, 1, 1), (5, "z" * 5000, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, score int")
    n, want = base_scores([(r[0], r[1]) for r in rows])
    got = L.score_documents(df).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    for r, w in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(want, key=key), strict=True):
        assert (r["doc_id"], r["n_tokens"], r["n_known"]) == w[:3] and math.isclose(r["base_score"], w[3], rel_tol=1e-9) and math.isfinite(r["score"])
    assert L.score_documents(df.limit(0)).count() == 0
    unseen = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:3]
    alone = L.score_documents(spark.createDataFrame([(k, "a b") for k in unseen], "doc_id long, text string")).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isclose(r["base_score"], 0, abs_tol=1e-9) for r in alone)


def test_calibration_stays_finite():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.ones((400, 1)), rng.normal(size=(400, 6))], axis=1)
    y = (x[:, 1] > 0).astype(float)  # told apart without error
    w = np.array(quality._logistic(x, y))
    assert np.abs(w).max() < 50 and ((x @ w > 0) == (y > 0.5)).mean() > 0.97
    constant = np.ones((10, 7))
    assert np.isfinite(quality._logistic(constant, np.r_[np.zeros(5), np.ones(5)])).all()
    assert len(quality._dictionary([b"too little"])) == 10

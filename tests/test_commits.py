"""Commits as deltas: against the graph rewritten, protected types, batches in order, compaction, two writers."""

import pytest

from sparkweft.graph import Graph
from sparkweft.operators import store as S
from sparkweft.session import GraphSession
from sparkweft.streaming.incremental import UpsertSink


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def graph_of(spark, tag, files, extra=()):
    nodes = [(f"{f}#{i}", "FUNCTION" if i % 2 else "ENRICHED", f"{tag}{i}", f) for f in files for i in range(4)] + list(extra)
    edges = [(f"{f}#{i}", f"{f}#{i + 1}", "CALLS") for f in files for i in range(3)] + [("other", f"{files[0]}#0", "DERIVED", f'{{"__file_context":"{files[0]}"}}')]
    return Graph.of(spark, nodes, edges)


def test_deltas_equal_rewriting(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/db", compact_at=3)
    kept = graph_of(spark, "a", ["1.js", "2.js", "3.js"], [("other", "MODULE", "o", "o.js")])
    store.write("g", kept)
    for step, (files, protected) in enumerate([(["1.js"], ()), (["2.js", "1.js"], ("ENRICHED",)), (["9.js"], ()), (["3.js", "gone.js"], ())]):
        new = graph_of(spark, f"v{step}", files[:1])
        want = S.commit_batch(kept, files, new.nodes, new.edges, protected)
        manifest, delta = store.commit("g", files, new.nodes, new.edges, protected)
        got = store.read("g")
        assert rows(got.nodes) == rows(want.graph.nodes) and rows(got.edges) == rows(want.graph.edges)
        assert rows(delta) == rows(want.delta)
        assert manifest["nodes"] == got.nodes.count() == sum(manifest["types"].values()) and manifest["edges"] == got.edges.count()
        assert len(manifest["deltas"]) == (step + 1) % 3
        kept = Graph(spark.createDataFrame(got.nodes.collect(), got.nodes.schema), spark.createDataFrame(got.edges.collect(), got.edges.schema))
    assert [m["version"] for m in store.snapshots("g")] == [1, 2, 3, 4, 5]
    assert rows(store.read("g", 1).nodes) != rows(store.read("g").nodes)
    whole = store.compact("g")
    assert not whole["deltas"] and rows(store.read("g").nodes) == rows(kept.nodes)
    assert store.clear("g")["nodes"] == 0 and store.read("g").nodes.isEmpty() and rows(store.read("g", 6).nodes) == rows(kept.nodes)


def test_many_files_are_joined(spark):
    g = graph_of(spark, "a", [f"{i}.js" for i in range(6)])
    named = [f"{i}.js" for i in range(3)]
    none = Graph(g.nodes.limit(0), g.edges.limit(0))
    long = [*named, *(f"x{i}" for i in range(S.LISTED))]
    want = S.commit_batch(g, named, none.nodes, none.edges).graph
    for files in (long, spark.createDataFrame([(f,) for f in named * 2], "file string")):
        got = S.commit_batch(g, files, none.nodes, none.edges).graph
        assert rows(got.nodes) == rows(want.nodes) and rows(got.edges) == rows(want.edges)
        assert rows(S.dependent_files(g, files)) == rows(S.dependent_files(g, named))


def test_a_batch_is_its_commits_in_order(spark, tmp_path):
    node = lambda i, kind, name, file: Graph.of(spark, [(i, kind, name, file)], []).nodes
    empty = Graph.of(spark, [("x", "X")], []).edges.limit(0)
    steps = [
        (["a.js"], node("n", "FUNCTION", "zz first", "a.js").union(node("early", "FUNCTION", "e", "a.js")), ()),
        (["b.js"], node("m", "ENRICHED", "m", "b.js"), ("ENRICHED",)),
        (["a.js"], node("n", "FUNCTION", "aa last", "a.js"), ()),
        (["b.js"], node("k", "FUNCTION", "k", "b.js"), ()),
    ]
    one, many = (GraphSession(S.Store(spark, f"file://{tmp_path}/{x}"), "g") for x in "ab")
    for s in (one, many):
        s.commit(["b.js"], node("kept", "ENRICHED", "kept", "b.js"), empty)
    with one.batch(kind="both"):
        for files, nodes, protected in steps:
            one.commit(files, nodes, empty, protected, step="inner")
    for files, nodes, _ in steps:
        many.commit(files, nodes, empty, ("ENRICHED",))
    assert rows(one.graph.nodes) == rows(many.graph.nodes)
    assert {r["id"]: r["name"] for r in one.graph.nodes.collect()} == {"n": "aa last", "m": "m", "k": "k", "kept": "kept"}
    assert one.store.snapshots("g")[-1]["tags"] == {"step": "inner", "kind": "both"}
    with one.batch():
        one.commit(["a.js"], node("n", "X", "n", "a.js"), empty)
        one.abort()
    assert one.graph.nodes.where("node_type = 'X'").isEmpty()


def test_two_writers(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/db")
    g = graph_of(spark, "a", ["1.js"])
    store.write("g", g)
    assert store._claim("g", 2) and not store._claim("g", 2)  # another writer is at version 2
    store.TRIES = 2
    with pytest.raises(S.Conflict):
        store.commit("g", ["1.js"], g.nodes, g.edges)
    store.STALE = -1  # it died
    assert store.commit("g", ["1.js"], g.nodes, g.edges)[0]["version"] == 2
    store.tag("g", 1, release="one")
    store.tag("g", 1, release="two")
    assert rows(store.read("g", tag=("release", "two")).nodes) == rows(g.nodes)
    with pytest.raises(KeyError):
        store.tag("g", 99, x="y")


def test_sink_compacts(spark, tmp_path):
    sink = UpsertSink(spark, f"file://{tmp_path}/sink", ["k"], "seq", "k bigint, seq bigint, v string", compact_at=3)
    assert sink.read().isEmpty()
    want = {}
    for b in range(10):
        batch = [(k, b * 10 + k % 3 - (25 if k == 5 else 0), f"b{b}") for k in range(b % 4, 8)]
        for k, seq, v in batch:
            if k not in want or (seq, b) >= want[k][:2]:
                want[k] = (seq, b, v)
        df = spark.createDataFrame(batch, "k long, seq long, v string")
        sink.put(df, b)
        if b == 4:
            sink.put(df, b)  # run again
        assert {r["k"]: r["v"] for r in sink.read().collect()} == {k: x[2] for k, x in want.items()}
        assert sink.batches() < 3
    assert len(sink._whole("bases", "upto=")) <= 2

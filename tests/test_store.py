import pytest
from pyspark.sql import functions as F

from sparkweft.graph import Graph
from sparkweft.operators import guarantees as GR
from sparkweft.operators import history as H
from sparkweft.operators import resolve as R
from sparkweft.operators import store as S
from sparkweft.sources import history as SH
from sparkweft.streaming.incremental import stream_commits, windowed_counts


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


@pytest.fixture
def g(spark):
    return Graph.of(spark, [("a", "FUNCTION", "a", "1.js"), ("b", "FUNCTION", "b", "2.js"), ("e", "ENRICHED", "e", S.enrichment_file("x", "1.js"))], [("a", "b", "CALLS"), ("b", "a", "CALLS"), ("b", "e", "LINKS", '{"__file_context":"1.js"}')])


def test_upsert_and_merge(spark):
    old = spark.createDataFrame([("x", 1), ("y", 1)], "id string, v int")
    new = spark.createDataFrame([("x", 2, 1), ("x", 3, 2), ("z", 9, 0)], "id string, v int, seq int")
    assert rows(S.upsert(old, new, ["id"], "seq")) == [("x", 3), ("y", 1), ("z", 9)]
    batches = spark.createDataFrame([("x", 1, 1), ("x", 2, 3), ("y", 1, 1), ("z", 1, 2)], "id string, v int, batch int")
    dead = spark.createDataFrame([("x", 2), ("y", 1), ("z", 1)], "id string, batch int")
    assert rows(S.merge(batches, dead, ["id"], "batch")) == [("x", 2), ("z", 1)]  # deleted, then written again
    assert S.should_compact(4) and not S.should_compact(3)


def test_commit(spark, g):
    new = Graph.of(spark, [("a", "FUNCTION", "a2", "1.js"), ("n", "CALL", "n", "1.js")], [("n", "a", "CALLS")])
    done = S.commit_batch(g, ["1.js"], new.nodes.withColumn("content_hash", F.lit(5).cast("long")), new.edges)
    assert rows(done.graph.nodes, "id", "name") == [("a", "a2"), ("b", "b"), ("e", "e"), ("n", "n")]
    assert rows(done.graph.edges, "src", "dst") == [("b", "a"), ("n", "a")]
    assert rows(done.delta) == [("a", "FUNCTION", "modified"), ("n", "CALL", "added")]
    assert rows(S.delta_counts(done.delta)) == [(1, 0, 1, ["CALL", "FUNCTION"])]
    kept = S.commit_batch(g, ["1.js"], g.nodes.limit(0), g.edges.limit(0), protected=["FUNCTION"])
    assert rows(kept.graph.nodes, "id") == [("a",), ("b",), ("e",)]


def test_store(spark, g, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}/db")
    first = s.write("main", g, {"kind": "full"})
    s.write("main", S.commit_batch(g, ["1.js"], g.nodes.limit(0), g.edges.limit(0)).graph)
    assert s.databases() == ["main"] and [m["version"] for m in s.snapshots("main")] == [1, 2] and first["types"] == {"FUNCTION": 2, "ENRICHED": 1}
    assert s.read("main").nodes.count() == 2 and s.read("main", tag=("kind", "full")).nodes.count() == 3
    s.tag("main", 2, kind="less")
    assert rows(s.diff("main", 1, 2)) == [("a", "FUNCTION", "removed")] and s.snapshots("main")[1]["tags"] == {"kind": "less"}
    assert s.drop("main") and s.databases() == []
    with pytest.raises(KeyError):
        s.read("main")
    with pytest.raises(ValueError):
        s.read("../x")


def test_stamp_and_files(spark):
    df = spark.createDataFrame([('{"a":"1","_source":"old"}',), (None,)], "m string")
    assert rows(df.select(S.stamped(F.col("m"), 3, "new"))) == [('{"_generation":"3","_source":"new"}',), ('{"a":"1","_generation":"3","_source":"new"}',)]
    now = spark.createDataFrame([("a", 1), ("b", 5), ("n", 1)], "path string, mtime long")
    was = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "path string, mtime long")
    assert rows(S.changed_files(now, was)) == [("a", "same"), ("b", "changed"), ("d", "deleted"), ("n", "new")]


def test_guarantees(g):
    rules = [GR.Guarantee("lonely", "called", 'violation(X) :- node(X, "FUNCTION"), \\+ edge(_, X, "CALLS").', "error", ("*.js",)), GR.Guarantee("none", "no e", 'violation(X) :- node(X, "ENRICHED").')]
    assert rows(GR.summary(g, rules)) == [("lonely", "error", 0, True), ("none", "error", 1, False)]
    assert [x.id for x in GR.affected_by(rules, ["CALLS"])] == ["lonely"]
    assert GR.load(GR.export(rules)) == rules


def test_git_log(spark):
    text = "h1\x1f2024-01-02\x1fAnn\x1fA@x.org\x1ffirst\n\n3\t1\tsrc/{old => new}/a.js\n-\t-\tpic.png\nx"
    c = SH.parse_git_log(spark.createDataFrame([(text,)], "value string"))
    assert [tuple(f) for f in c.first()["files"]] == [("src/new/a.js", 3, 1), ("pic.png", 0, 0)]
    known = c.withColumn("author_ref", F.lower("author_email"))
    assert rows(H.churn(known)) == [("pic.png", 1, 0, 0), ("src/new/a.js", 1, 3, 1)]
    assert rows(H.normalized_authors(c)) == [("a@x.org", "Ann", ["A@x.org"], ["Ann"])]
    assert H.new_commits(c, c).isEmpty()


def test_notes(spark):
    note = '---\nid: kb:d1\ntype: decision\nstatus: "active"\nrelates_to: [kb:a, "kb:b"]\n---\nBody.\n'
    r = SH.parse_notes(spark.createDataFrame([("p.md", note)], "path string, value string")).first()
    assert (r["id"], r["kind"], r["status"], r["relates_to"], r["text"]) == ("kb:d1", "DECISION", "active", ["kb:a", "kb:b"], "Body.")


def test_resolvers(spark):
    nodes = [
        ("m1", "MODULE", "a", "src/a.js"), ("m2", "MODULE", "b", "src/lib/b.js"), ("b->imp", "IMPORT_BINDING", "go", "src/a.js", '{"source":"./lib/b","importedName":"run"}'), ("ns", "IMPORT_BINDING", "u", "src/a.js", '{"source":"./lib/b.js","importedName":"*"}'),
        ("run", "FUNCTION", "run", "src/lib/b.js", None, True), ("c1", "CALL", "go", "src/a.js"), ("c2", "CALL", "u.run", "src/a.js"), ("c3", "CALL", "here", "src/a.js"), ("here", "FUNCTION", "here", "src/a.js"), ("herev", "VARIABLE", "here", "src/a.js"),
        ("x[in:K]", "CALL", "this.m", "src/a.js"), ("K.m", "METHOD", "m", "src/a.js", '{"className":"K"}'), ("K", "CLASS", "K", "src/a.js", '{"extends":"Base<T>, Other"}'), ("Base", "CLASS", "Base", "src/lib/b.js"), ("Base.m", "METHOD", "m", "src/lib/b.js", '{"className":"Base"}'),
        ("ref", "REFERENCE", "here", "src/a.js"), ("glob", "REFERENCE", "console.log", "src/a.js"),
    ]
    g = Graph.of(spark, nodes, [("K", "K.m", "HAS_METHOD"), ("Base", "Base.m", "HAS_METHOD"), ("K", "Base", "EXTENDS"), ("c3", "Base.m", "CALLS")])
    assert rows(R.import_edges(g), "src", "dst") == [("b->imp", "m2"), ("ns", "m2")]
    assert rows(R.cross_file_calls(g), "src", "dst") == [("c1", "run"), ("c2", "run")]
    assert rows(R.same_file_calls(g), "src", "dst") == [("c3", "here"), ("x[in:K]", "K.m")]
    assert rows(R.local_references(g, ["console"]), "src", "dst") == [("ref", "here")]
    assert rows(R.type_edges(g, ["EXTENDS"]), "src", "dst", "edge_type") == [("K", "Base", "EXTENDS")]
    assert rows(R.virtual_dispatch(g), "src", "dst", "edge_type") == [("K.m", "Base.m", "OVERRIDES"), ("c3", "K.m", "DISPATCHES_TO")]
    assert rows(R.table_references(g, ["console"], "GLOBAL").edges, "src", "dst") == [("glob", "GLOBAL:console")]


def test_stream_commits(spark, tmp_path):
    schema = "id string, node_type string, name string, file string, exported boolean, content_hash bigint, metadata string"
    for i, name in enumerate(("old", "new")):
        spark.createDataFrame([("a", "FUNCTION", name, "1.js", True, i, None), (f"only{i}", "FUNCTION", "o", "1.js", True, 1, None)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/k={i}")
    store = S.Store(spark, f"file://{tmp_path}/db")
    stream = spark.readStream.schema(schema + ", k int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("k")
    none = lambda batch, _: spark.createDataFrame([], "src string, dst string, edge_type string, metadata string")
    q = stream_commits(stream, store, "live", none, f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert len(store.snapshots("live")) == 2 and rows(store.read("live").nodes, "id", "name") in ([("a", "new"), ("only1", "o")], [("a", "old"), ("only0", "o")])


def test_windowed_counts(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()

import pytest
from pyspark.sql import functions as F

from sparkweft import cli, render
from sparkweft.graph import Graph
from sparkweft.operators import knowledge as K
from sparkweft.operators.store import Store
from sparkweft.session import GraphSession, QueryTimeout


@pytest.fixture
def session(spark, tmp_path):
    g = Graph.of(spark, [("m", "MODULE", "m", "a.js"), *((f"f{i}", "FUNCTION", f"f{i}", "a.js", f'{{"line":{i}}}') for i in range(5)), ("v", "VARIABLE", "v", "a.js")], [*(("m", f"f{i}", "CONTAINS") for i in range(5)), ("f0", "f1", "CALLS"), ("f0", "v", "WRITES_TO"), ("v", "f1", "ASSIGNED_FROM")])
    s = GraphSession(Store(spark, f"file://{tmp_path}/db"), "main")
    s.commit(["a.js"], g.nodes, g.edges)
    return s


def test_query(session):
    a = session.query('node(X, "FUNCTION")', limit=2)
    assert [r["X"] for r in a.rows.collect()] == ["f0", "f1"] and a.more
    assert session.query("MATCH (f:FUNCTION) RETURN f.id AS id", "cypher", count=True).count == 5
    assert session.query('node(X, "FUNCTON")').hints == ["no node_type 'FUNCTON'; did you mean FUNCTION?"]
    session.load_rules('busy(X) :- edge(X, _, "CALLS").')
    assert session.query("busy(X)").rows.first()["X"] == "f0"
    session.declare_fields(line="int")
    assert session.graph.nodes.where("field_line > 3").count() == 1
    assert session.query('edge(X, Y, "CALLS")', explain=True).plan.steps == ["edge"]


def test_limit(session):
    with pytest.raises(QueryTimeout), session.limited(0.5):
        slow = F.udf(lambda x: __import__("time").sleep(5) or x, "long")
        session.spark.range(4).select(slow("id")).collect()


def test_batches(session, spark):
    empty = session.graph.edges.limit(0)
    with session.batch(kind="two"):
        for f in ("b.js", "c.js"):
            session.commit([f], Graph.of(spark, [(f, "MODULE", f, f)], []).nodes, empty)
        assert session.is_batching and len(session.store.snapshots("main")) == 1
    assert session.graph.nodes.count() == 9 and session.store.snapshots("main")[-1]["tags"] == {"kind": "two"}
    with pytest.raises(ZeroDivisionError), session.batch():
        session.commit(["b.js"], session.graph.nodes.limit(0), empty)
        1 / 0
    assert session.graph.nodes.count() == 9 and not session.is_batching
    session.register("alias", lambda g: Graph(g.nodes.limit(0), g.edges.where("edge_type = 'CALLS'").withColumn("edge_type", F.lit("SEES"))))
    for _ in range(2):  # what a plug-in derived before is replaced
        session.enrich("alias")
        assert session.graph.edges.where("edge_type = 'SEES'").count() == 1
    with pytest.raises(PermissionError):
        GraphSession(session.store, "main", read_only=True).commit([], session.graph.nodes, empty)


def test_describe_and_cli(session, capsys):
    text = render.describe(session.graph, "m", 2)
    assert text.startswith("MODULE m {") and "> calls f1" in text and "x4" in text
    assert "=> writes v" in render.describe(session.graph, "f0", 1, "security") and "calls" not in render.describe(session.graph, "f0", 1, "security")
    assert render.narrate(session.graph, "v").startswith("backward: chain (")
    assert render.trace_shape({"a": 1, "b": 5, "c": 5, "d": 5}, "a") == "fan-out" and render.trace_shape({"a": 20, "b": 1, "c": 1}, "a") == "fan-in"
    assert {r["archetype"]: r["n"] for r in render.by_archetype(session.graph.edges).collect()} == {"contains": 5, "flow_out": 1, "write": 1, "flow_in": 1}
    for args in (["stats"], ["ls", "FUNCTION"], ["query", 'node(X, "MODULE")'], ["describe", "m"], ["who", "f1"], ["doctor"]):
        assert cli.main([session.store.root, "main", *args], session.spark) == 0
    assert "MODULE" in capsys.readouterr().out


def test_knowledge(spark):
    notes = spark.createDataFrame([("d1", "DECISION", "active", "Use it", ["src/a.js", "gone"]), ("d2", "DECISION", "active", "Better", ["d1"]), ("f1", "FACT", "active", "Known", None)], "id string, kind string, status string, text string, relates_to array<string>")
    known = spark.createDataFrame([("src/a.js",)], "id string")
    assert [r["id"] for r in K.query(notes, kind="DECISION", text="use").collect()] == ["d1"]
    assert [tuple(r) for r in K.dangling_references(notes, known).collect()] == [("d1", "gone")]
    assert [r["id"] for r in K.query(notes, dangling=known).collect()] == ["d1"]
    after = K.supersede(notes, "d1", "d2")
    assert K.decisions_for(notes, "src").count() == 1 and K.decisions_for(after, "src").count() == 0
    assert {tuple(r) for r in K.stats(after).collect()} == {("DECISION", "superseded", 1), ("DECISION", "active", 1), ("FACT", "active", 1)}
    g = Graph.of(spark, [("n1", "FUNCTION", "f", "a.js"), ("n2", "CLASS", "f", "a.js")], [])
    found = K.resolve_addresses(spark.createDataFrame([("a.js:CLASS:f",), ("a.js:f",), ("b.js:f",)], "address string"), g)
    assert {tuple(r) for r in found.collect()} == {("a.js:CLASS:f", "n2"), ("a.js:f", "n1"), ("b.js:f", None)}

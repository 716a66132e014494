import pytest
from pyspark.sql import functions as F

from sparkweft.graph import Graph
from sparkweft.operators import code_queries as Q
from sparkweft.operators import primitives as P
from sparkweft.operators import traverse as T


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def cycle(spark):
    return Graph.of(spark, [("A", "X"), ("B", "X"), ("C", "Y")], [("A", "B", "E"), ("B", "A", "E"), ("B", "C", "F")])


def test_bfs(cycle):
    assert rows(T.bfs(cycle, ["A"], 5)) == [("A", 0), ("B", 1), ("C", 2)]
    assert rows(T.bfs(cycle, ["A"], 0)) == [("A", 0)]
    assert rows(T.bfs(cycle, ["A"], 5, ["E"])) == [("A", 0), ("B", 1)]
    assert rows(T.bfs(cycle, ["C"], 5, direction="in")) == [("A", 2), ("B", 1), ("C", 0)]
    assert rows(T.dfs(cycle, ["A"], 2)) == [("A",), ("B",), ("C",)]
    assert T.is_reachable(cycle, "A", "C") and not T.is_reachable(cycle, "C", "A") and not T.is_reachable(cycle, "A", "C", max_depth=1)


def test_traverse_checks(cycle):
    found, cut = T.traverse(cycle, ["A"], 5, cap=2)
    assert cut and rows(found, "id", "depth") == [("A", 0), ("B", 1)]
    for starts, depth in (([], 1), (["A"], 21), (["A"], -1), (["Z"], 1)):
        with pytest.raises(ValueError):
            T.traverse(cycle, starts, depth)
    with pytest.raises(ValueError):
        T.steps(cycle.edges, "sideways")


def test_chain_marks_cycles(spark, cycle):
    seeds = spark.createDataFrame([("A", "A")], "origin string, node string")
    assert rows(T.chain(seeds, cycle.edges.where("edge_type = 'E'").select("src", "dst"))) == [("A", "A", 0, False), ("A", "A", 2, True), ("A", "B", 1, False)]


def test_primitives(cycle):
    assert P.node_exists(cycle, "A") and not P.node_exists(cycle, "Z")
    assert rows(P.neighbors(cycle, "B", direction="both")) == [("A",), ("C",)]
    assert [len(c) for c in P.in_chunks(cycle.nodes, 2)] == [2, 1]
    df, more = P.page(cycle.nodes.select("id"), 2)
    assert rows(df) == [("A",), ("B",)] and more
    assert rows(P.page_after(cycle.nodes.select("id"), P.cursor("B"))) == [("C",)]
    with pytest.raises(ValueError):
        P.page_after(cycle.nodes, "Zm9v")


@pytest.fixture(scope="module")
def code(spark):
    nodes = [
        ("mod", "MODULE", "m", "a.js"), ("f", "FUNCTION", "f", "a.js", '{"line":1,"endLine":9}'), ("g", "FUNCTION", "g", "a.js", '{"line":20,"endLine":29}'), ("h", "FUNCTION", "h", "b.js"),
        ("s", "SCOPE", "if", "a.js", '{"conditional":true,"condition":"x > 1"}'), ("c1", "CALL", "g", "a.js", '{"line":3}'), ("c2", "CALL", "o.h", "a.js", '{"line":22}'), ("c3", "CALL", "lost", "a.js", '{"line":50}'),
        ("v", "VARIABLE", "v", "a.js"), ("w", "VARIABLE", "w", "a.js"), ("one", "LITERAL", "1", "a.js", '{"value":1}'), ("two", "LITERAL", "2", "a.js", '{"value":"2"}'), ("par", "PARAMETER", "par", "a.js"), ("t", "EXPRESSION", "ternary", "a.js"),
        ("env", "EXPRESSION", "process.env.X", "a.js"), ("ref", "REFERENCE", "r", "a.js"), ("gr", "guarantee", "G", None),
    ]
    edges = [
        ("mod", "f", "CONTAINS"), ("mod", "g", "CONTAINS"), ("f", "s", "HAS_SCOPE"), ("s", "c1", "CONTAINS"), ("g", "c2", "CONTAINS"), ("mod", "c3", "CONTAINS"), ("c1", "g", "CALLS"), ("c2", "h", "CALLS"),
        ("v", "t", "ASSIGNED_FROM"), ("t", "one", "HAS_CONSEQUENT"), ("t", "par", "HAS_ALTERNATE"), ("two", "v", "WRITES_TO"), ("w", "ref", "ASSIGNED_FROM"), ("ref", "v", "READS_FROM"), ("w", "env", "DERIVES_FROM"),
        ("c1", "g", "CALL_RETURNS"), ("gr", "mod", "GOVERNS"),
    ]
    return Graph.of(spark, nodes, edges)


def test_calls(code):
    assert rows(Q.calls_in(code, ["f"]), "call", "target", "resolved") == [("c1", "g", True)]
    assert rows(Q.calls_in(code, ["f"], transitive=True), "origin", "call", "level") == [("f", "c1", 0), ("f", "c2", 1)]
    assert rows(Q.containing(code, ["c1", "c2", "c3"]), "origin", "node") == [("c1", "f"), ("c2", "g"), ("c3", "mod")]
    assert rows(Q.find_calls(code, "h", "o"), "id", "target") == [("c2", "h")]
    assert rows(Q.calls_by_position(code)) == [("f", "c1"), ("g", "c2")]
    assert rows(Q.callers(code, "G"), "id", "via") == [("c1", "call")]
    assert rows(Q.find_guards(code, ["c1"]), "id", "condition") == [("s", "x > 1")]
    assert rows(Q.call_tree(code, "g")) == [("c1", 0)]


def test_values(code):
    found = rows(Q.trace_values(code, ["v", "w", "c1", "c2"]), "origin", "id", "value", "reason")
    assert found == [("c1", "c1", None, "implicit_return"), ("c2", "c2", None, "call_result"), ("v", "one", "1", None), ("v", "par", None, "parameter"), ("v", "two", "2", None), ("w", "env", None, "nondeterministic"), ("w", "ref", None, "no_sources")]
    assert rows(Q.value_set(Q.trace_values(code, ["v"]))) == [("v", ["1", "2"], True)]
    assert ("v", "t", None, "max_depth") in rows(Q.trace_values(code, ["v"], 0), "origin", "id", "value", "reason")
    assert rows(Q.trace_alias(code, ["w"]), "node", "depth") == [("t", 2), ("v", 1), ("w", 0)]
    assert ("par", 3) in rows(Q.trace_dataflow(code, "ref"), "id", "depth") and ("w", 2) in rows(Q.trace_dataflow(code, "v", "both"), "id", "depth")


def test_values_of_repeated_nodes(spark):
    nodes = [("v", "VARIABLE", "v", "a.js")] + 2 * [("e", "EXPRESSION", "sum", "a.js"), ("one", "LITERAL", "1", "a.js"), ("par", "PARAMETER", "p", "a.js")]
    g = Graph.of(spark, nodes, [("v", x, "ASSIGNED_FROM") for x in ("e", "one", "par")])
    found = rows(Q.trace_values(g, ["v"]), "origin", "id", "value", "unknown", "reason")
    assert found == [("v", "e", None, True, "no_sources"), ("v", "one", "1", False, None), ("v", "par", None, True, "parameter")]


def test_impact(code):
    callers, modules, targets = Q.impact(code, "h")
    assert rows(callers, "id", "depth", "direct") == [("f", 2, False), ("g", 1, True)] and rows(targets) == [("h",)] and rows(modules) == [("a.js", 2)]
    assert rows(callers.where("id = 'f'"), "chain") == [(["h", "g", "f"],)]
    found, score = Q.blast_radius(code, "g")
    assert rows(found, "id", "depth") == [("c1", 1)] and score["score"] == 13 and score["level"] == "MEDIUM"


def test_context(code):
    context = Q.node_context(code, "g").collect()
    assert [r["edge_type"] for r in context] == ["CALLS", "CALL_RETURNS", "CONTAINS", "CONTAINS"]
    assert Q.subgraph(code, "mod", 0).nodes.count() == 4 and Q.subgraph(code, "f", 1).edges.count() == 1
    overview = rows(Q.file_overview(code, "a.js").where("kind = 'function'"), "name", "members")
    assert overview == [("f", ["g"]), ("g", ["o.h"])]
    assert Q.node_at(code, "a.js", 3, 0).first()["id"] == "c1" and Q.node_at(code, "a.js", 45, 0).first()["id"] == "c3"
    assert [tuple(r) for r in Q.similar_names(code.nodes, "FI").limit(3).collect()] == [("f", 1), ("1", 2), ("2", 2)]


def test_upward_stops(spark):
    g = Graph.of(spark, [("m", "MODULE"), ("k", "CLASS"), ("x", "CALL")], [("m", "k", "CONTAINS"), ("k", "x", "CONTAINS")])
    kind = F.col("node_type")
    seeds = spark.createDataFrame([("x", "x")], "origin string, node string")
    assert rows(T.upward(seeds, g, ["CONTAINS"], kind == "MODULE", kind == "CLASS")) == []
    assert rows(T.upward(seeds, g, ["CONTAINS"], kind == "MODULE", F.lit(False))) == [("x", "m", 2)]


def test_simple_trace_counts_repeated_edges(spark):
    """Two equal rows of an edge are two of the fan, and a repeated node's row makes no more of them."""
    nodes = [("v", "VARIABLE", "v")] + 3 * [("e", "EXPRESSION", "sum")] + [("f", "EXPRESSION", "sum"), ("one", "LITERAL", "1"), ("two", "LITERAL", "2")]
    g = Graph.of(spark, nodes, 2 * [("v", "e", "ASSIGNED_FROM")] + [("v", "f", "ASSIGNED_FROM"), ("e", "one", "DERIVES_FROM"), ("e", "two", "DERIVES_FROM")])
    assert rows(Q.simple_trace(g, "v", fan=2), "id", "depth", "source") == [("e", 1, None), ("e", 1, None), ("one", 2, "literal"), ("two", 2, "literal"), ("v", 0, None)]


def test_chain_reads_its_moves_once(spark, cycle, monkeypatch):
    written = []
    monkeypatch.setattr(T, "settled", lambda df, name, real=T.settled: (written.append(name), real(df, name))[1])
    seeds = spark.createDataFrame([("A", "A")], "origin string, node string")
    assert rows(T.chain(seeds, cycle.edges.where("edge_type = 'E'").select("src", "dst")), "node", "depth") == [("A", 0), ("A", 2), ("B", 1)]
    assert written.count("nexts") == 1

"""Cypher and Datalog on small graphs."""

import pytest

from sparkweft.graph import Graph
from sparkweft.plans import cypher as C
from sparkweft.plans import datalog as D


@pytest.fixture(scope="module")
def g(spark):
    nodes = [
        ("m", "MODULE", "m", "a.js"), ("f", "FUNCTION", "f", "a.js", '{"line":1,"async":true}', True), ("g", "FUNCTION", "g", "a.js", '{"line":"5"}', False),
        ("s", "SCOPE", None, "a.js"), ("c", "CALL", "g", "a.js", '{"object":"x"}'), ("p", "PARAMETER", "p", "a.js"), ("k", "CLASS", "K", "b.js"), ("v", "VARIABLE", "v", "b.js"),
        ("r", "http:route", "r", "b.js"), ("q", "http:request", "q", "b.js"),
    ]
    edges = [("m", "f", "CONTAINS"), ("f", "s", "HAS_SCOPE"), ("s", "c", "CONTAINS"), ("c", "g", "CALLS", '{"argIndex":0}'), ("f", "p", "HAS_PARAMETER"), ("k", "v", "CONTAINS"), ("g", "f", "NEXT"), ("f", "g", "NEXT")]
    return Graph.of(spark, nodes, edges)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("text", "want"), [
    ("MATCH (f:FUNCTION) RETURN f.name AS n", [("f",), ("g",)]),
    ("MATCH (f:FUNCTION) WHERE f.line = 1 RETURN f.id AS n", [("f",)]),  # a text "5" is no number
    ("MATCH (f:FUNCTION) WHERE f.line = '5' RETURN f.id AS n", [("g",)]),
    ("MATCH (f:FUNCTION) WHERE NOT f.async = true RETURN f.id AS n", [("g",)]),  # null is false before NOT
    ("MATCH (f:FUNCTION) WHERE f.async IS NULL RETURN f.id AS n", [("g",)]),
    ("MATCH (f:FUNCTION {name: 'f'})-[:NEXT]->(x) RETURN x.id AS n", [("g",)]),
    ("MATCH (x)<-[e:CALLS]-(c:CALL) RETURN x.id AS n", [("g",)]),
    ("MATCH (f)-[:NEXT]-(g:FUNCTION {name: 'g'}) RETURN f.id AS n", [("f",), ("f",)]),  # one row an edge
    ("MATCH (m:MODULE)-[:CONTAINS|HAS_SCOPE*2..3]->(x) RETURN x.id AS n", [("c",), ("s",)]),
    ("MATCH (f:FUNCTION)-[:NEXT*0..5]->(x) RETURN f.id AS a, x.id AS b", [("f", "f"), ("f", "g"), ("g", "f"), ("g", "g")]),
    ("MATCH (a)-[:NEXT]->(b)-[:NEXT]->(a) RETURN a.id AS n", [("f",), ("g",)]),
    ("MATCH (x:http:route) RETURN x.id AS n", [("r",)]),
    ("MATCH (n:FUNCTION) RETURN COUNT(*) AS n", [(2,)]),
    ("MATCH (n) WHERE n.name STARTS WITH 'f' OR n.name ENDS WITH 'K' RETURN n.id AS n", [("f",), ("k",)]),
    ("MATCH (n:FUNCTION) RETURN n.line ORDER BY n.line DESC, n.id LIMIT 1", [("5",)]),
    ("MATCH (n) WHERE n.name = null RETURN n.id AS n", []),
    ("MATCH (n:FUNCTION) WHERE n.name <> 1 RETURN n.id AS n", [("f",), ("g",)]),
])
def test_cypher(g, text, want):
    assert rows(C.cypher(g, text)) == want


def test_cypher_names_and_nulls(g):
    df = C.cypher(g, "MATCH (n:FUNCTION) RETURN n.name, COUNT(n)")
    assert df.columns == ["n.name", "COUNT(n)"]
    found = C.cypher(g, "MATCH (n) WHERE n.file = 'a.js' RETURN n.id AS id, n.name AS name ORDER BY n.name LIMIT 1").collect()
    assert [tuple(r) for r in found] == [("s", None)]


@pytest.mark.parametrize("text", ["", "MATCH (n", "MATCH (n) RETURN", "MATCH (n)<-[]->(m) RETURN n", "MATCH (n) RETURN n LIMIT 1.5", "MATCH (n) RETURN m.x", "MATCH (n) RETURN FOO(n)", "MATCH (n)-[*3..1]->(m) RETURN n", "MATCH (n) RETURN n.a AS x, n.b AS x", "MATCH (n) § RETURN n"])
def test_cypher_errors(g, text):
    with pytest.raises(C.CypherError):
        C.cypher(g, text)


@pytest.mark.parametrize(("query", "columns", "want"), [
    ('node(X, "FUNCTION")', "X", [("f",), ("g",)]),
    ('node(X, "http:*")', "X", [("q",), ("r",)]),
    ('attr(X, "object", "x"), node(X, T)', "XT", [("c", "CALL")]),
    ('node(X, "FUNCTION"), \\+ edge(_, X, "CALLS")', "X", [("f",)]),
    ('node(X, "FUNCTION"), attr(X, "exported", "true")', "X", [("f",)]),
    ('edge(X, Y, "NEXT"), neq(X, "g")', "XY", [("f", "g")]),
    ('attr(X, "name", N), (eq(N, "K") ; starts_with(N, "v"))', "X", [("k",), ("v",)]),
    ('attr_edge(X, Y, "CALLS", "argIndex", V)', "XYV", [("c", "g", "0")]),
    ('incoming("g", X, "CALLS")', "X", [("c",)]),
    ('node(X, "CALL"), parent_function(X, F)', "XF", [("c", "f")]),
    ('parent_function("p", F)', "F", [("f",)]),
    ('node(X, "VARIABLE"), parent_function(X, F)', "XF", []),
    ('path("f", X)', "X", [("c",), ("f",), ("g",), ("p",), ("s",)]),
    ('node(X, "VARIABLE"), \\+ path(X, _)', "X", [("v",)]),
    ('node(X, "FUNCTION"), edge(X, X, "NEXT")', "X", []),
])
def test_datalog(g, query, columns, want):
    assert rows(D.Datalog(g).query(query), *columns) == want


def test_datalog_rules(g):
    program = """
    step(X, Y) :- edge(X, Y, "NEXT"). % a cycle
    reach(X, Y) :- step(X, Y).
    reach(X, Z) :- reach(X, Y), reach(Y, Z).
    even("z"). even(X) :- step(Y, X), odd(Y). odd(X) :- step(Y, X), even(Y). even("f").
    """
    d = D.Datalog(g, program)
    assert rows(d.relation("reach")) == [("f", "f"), ("f", "g"), ("g", "f"), ("g", "g")]
    assert rows(d.relation("even")) == [("f",), ("z",)]
    assert rows(d.relation("odd")) == [("g",)]
    assert rows(d.query('reach("f", X), \\+ even(X)')) == [("g",)]
    assert rows(d.query('even("q")')) == []
    assert rows(d.query('even("z")')) == [(True,)]


def test_violations_and_explain(g):
    found = D.violations(g, 'violation(X) :- node(X, "FUNCTION"), \\+ edge(_, X, "CALLS").')
    assert rows(found) == [("f", "FUNCTION", "f", "a.js")]
    df, plan = D.Datalog(g).explain('edge(X, Y, T), node(X, "CALL")')
    assert df.count() == 1 and plan.steps == ["edge", "node"] and plan.warnings == ["Full edge scan"] and plan.rows[0] == 8


@pytest.mark.parametrize("program", ["p(X) :- \\+ node(X, \"A\").", "p(X, Y) :- node(X, \"A\").", "p(X) :- node(X, \"A\")", "p(1).", "node(X, \"A\") :- edge(X, _, \"B\").", "p(_) :- node(X, \"A\").", 'p(X) :- node(X, "A"), \\+ p(X).', 'p(X) :- neq(X, "a"), starts_with(X, Y), q(X).', "p(X) :- edge(X)."])
def test_datalog_errors(g, program):
    with pytest.raises(D.DatalogError):
        D.Datalog(g, program).relation("p")

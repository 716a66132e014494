"""Explain and hints in Cypher, rules in YAML and in the graph, ignore files, versions by type, answers of bounded size."""

import pytest

from sparkweft.graph import Graph
from sparkweft.operators import code_queries as C
from sparkweft.operators import guarantees as GR
from sparkweft.operators import primitives as P
from sparkweft.operators import store as S
from sparkweft.plans.cypher import CypherError, explain
from sparkweft.session import GraphSession
from sparkweft.sources import history as SH


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def g(spark):
    return Graph.of(spark, [("m", "MODULE", "m", "src/a.js"), *((f"f{i}", "FUNCTION", f"f{i}", "src/a.js", f'{{"line":{i + 2}}}') for i in range(4))], [*(("m", f"f{i}", "CONTAINS") for i in range(4)), ("f0", "f1", "CALLS"), ("f1", "f2", "CALLS")])


def test_explain(g):
    steps = explain(g, "MATCH (m:MODULE)-[:CONTAINS]->(f:FUNCTION)-[:CALLS*1..2]->(x) WHERE f.name <> 'f9' AND NOT x.file IS NULL RETURN f.name AS name, COUNT(x) AS n ORDER BY n DESC LIMIT 3", True)
    assert [(s.operator, s.rows) for s in steps] == [("NodeScan", 1), ("Expand", 4), ("VarLengthExpand", 3), ("Filter", 3), ("Aggregate", None), ("Sort", None), ("Limit", None)]
    assert steps[1].detail == "-[:CONTAINS]->(f:FUNCTION)" and steps[2].detail == "-[:CALLS*1..2]->(x)" and steps[3].detail == "((f.name <> 'f9') AND NOT (x.file IS NULL))"
    assert [s.operator for s in explain(g, "MATCH (f) RETURN f.id")] == ["NodeScan", "Project"] and explain(g, "MATCH (f) RETURN f.id")[0].rows is None
    with pytest.raises(CypherError):
        explain(g, "MATCH (")


def test_session(spark, g, tmp_path):
    s = GraphSession(S.Store(spark, f"file://{tmp_path}/db"), "main")
    s.commit(["src/a.js"], g.nodes, g.edges)
    a = s.query("MATCH (f:FUNCTON)-[:CALS]->(x) RETURN f.id AS id", "cypher", explain=True)
    assert a.hints == ["no node_type 'FUNCTON'; did you mean FUNCTION?", "no edge_type 'CALS'; did you mean CALLS?"] and a.plan[0].operator == "NodeScan"
    page = s.query('node(X, "FUNCTION")', limit=3)
    assert page.rows.count() == 3 and page.more
    log = s.query_log()
    assert log.count() == 2 and P.slow_queries(log, 0, 1).count() == 1 and P.latency_stats(log).first()["queries"] == 2
    with s.batch():
        s.commit(["src/b.js"], Graph.of(spark, [("b", "MODULE", "b", "src/b.js")], []).nodes, g.edges.limit(0))
        assert s.pending.nodes.count() == 6 and s.graph.nodes.count() == 5
    assert s.graph.nodes.count() == 6 and s.pending.nodes.count() == 6
    assert P.capped("short") == "short" and P.capped("x" * 20, 5).startswith("xxxxx\n\n[cut: 15 more")


def test_yaml(g):
    rules = [GR.Guarantee("a", 'the "first": #1', 'violation(X) :- node(X, "FUNCTION"),\n  \\+ edge(_, X, "CALLS").', "error", ("src/*.js", "b: c")), GR.Guarantee("b", "b", 'violation(X) :- node(X, "NONE").', "warning")]
    assert GR.load_yaml(GR.export_yaml(rules)) == rules and GR.load_yaml(GR.export_yaml([])) == []
    by_hand = "# rules\nversion: 1\n\nguarantees:\n  - id: x\n    name: 'it''s'\n    rule: |\n      violation(X) :-\n        node(X, \"A\").\n\n    governs: [\"**/*.js\", b.js]  \n  - id: y\n    rule: 'violation(X) :- node(X, \"B\").'\n    severity: warning # mild\n    governs:\n      - c.js\n"
    x, y = GR.load_yaml(by_hand)
    assert (x.name, x.rule, x.governs) == ("it's", 'violation(X) :-\n  node(X, "A").', ("**/*.js", "b.js"))
    assert (y.name, y.severity, y.governs) == ("y", "warning", ("c.js",)) and rows(GR.check(g, y)) == []
    held = GR.create(GR.create(g, rules[0]), rules[1])
    assert GR.stored(held) == rules and rows(held.edges.where("edge_type = 'GOVERNS'").select("src", "dst")) == [("GUARANTEE:a", "m")]
    assert GR.stored(GR.create(held, GR.Guarantee("a", "new", rules[1].rule)))[0].name == "new"
    left = GR.delete(held, "a")
    assert [r.id for r in GR.stored(left)] == ["b"] and left.edges.where("edge_type = 'GOVERNS'").isEmpty()
    with pytest.raises(ValueError):
        GR.create(g, GR.Guarantee("bad", "bad", "violation(X :-"))


def test_ignored_files(spark, tmp_path):
    for f in ("a.js", "b.log", "keep.log", "build/x.js", "src/build/y.js", "src/z.js", "src/out/z.js", "docs/q.js", ".hidden/h.js", "src/sub dir/s.js"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    found = lambda **k: [r["path"] for r in SH.discover(spark, f"file://{tmp_path}", ["**/*.js", "*.js", "*.log"], **k).collect()]
    everything = ["a.js", "b.log", "build/x.js", "docs/q.js", "keep.log", "src/build/y.js", "src/out/z.js", "src/sub dir/s.js", "src/z.js"]
    assert found() == everything
    (tmp_path / ".gitignore").write_text("# logs\n*.log\n!keep.log\nbuild/\n/docs\nsrc/out\nsub\\ dir  \n")
    assert found() == ["a.js", "keep.log", "src/z.js"] and found(ignore=False) == everything
    assert found(exclude=["src/**"]) == ["a.js", "keep.log"]


def test_versions_by_type(spark):
    meta = lambda **k: "{" + ",".join(f'"{a}":{b}' for a, b in k.items()) + "}"
    main = [("1", "FUNCTION", "f", "a.js", meta(line=1, params='["x"]', note='"old"')), ("2", "FUNCTION", "g", "a.js", meta(line=9)), ("3", "MODULE", "a.js", "a.js", meta(contentHash='"h"')), ("4", "CALL_SITE", "c", "a.js", meta(line=3, column=1, callee='"f"')), ("5", "HTTP_REQUEST", "r", "a.js", meta(url='"/u"', method='"GET"')), ("6", "OTHER", "o", "a.js", meta(line=1))]
    local = [("a", "FUNCTION", "f", "a.js", meta(line=1, params='["x"]', note='"new"')), ("b", "FUNCTION", "g", "a.js", meta(line=10)), ("c", "MODULE", "a.js", "a.js", meta(contentHash='"k"')), ("d", "CALL_SITE", "c", "a.js", meta(line=3, column=1, callee='"g"')), ("e", "HTTP_REQUEST", "r", "b.js", meta(url='"/u"', method='"POST"')), ("f", "NEW", "n", "a.js")]
    got = dict(rows(S.classify_nodes(Graph.of(spark, main, []).nodes, Graph.of(spark, local, []).nodes)))
    by = {k.split(":")[0].split("->")[0]: v for k, v in got.items() if not k.startswith("FUNCTION")}
    assert got["FUNCTION:f:a.js"] == "unchanged" and got["FUNCTION:g:a.js"] == "modified"
    assert by == {"a.js": "modified", "CALL_SITE": "modified", "HTTP_REQUEST": "modified", "OTHER": "deleted", "NEW": "added"}


def test_source_preview(spark, g):
    files = spark.createDataFrame([("src/a.js", "\n".join(f"line {i}" for i in range(1, 40))), ("src/b.js", None)], "file string, content string")
    got = C.source_preview(g, files, "f3", around=2, after=1).collect()
    assert [(r["line"], r["text"]) for r in got] == [(i, f"line {i}") for i in range(3, 9)]
    assert C.source_preview(g, files, "m").isEmpty()

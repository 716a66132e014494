"""Joins with hot keys, and the operators over them, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sparkweft.graph import Graph
from sparkweft.operators import joins
from sparkweft.operators import resolve as R


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def moved(df):
    """Rows that the stages of df's plan hand to a shuffle, by adaptive execution's own count."""
    df.write.format("noop").mode("overwrite").save()
    return str(df._jdf.queryExecution().executedPlan())


def test_product_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEFT", 4)
    monkeypatch.setattr(joins, "RIGHT", 3)
    left = [("hot", f"a{i}") for i in range(23)] + [("cold", "a0"), ("left", "a1")]
    right = [("hot", f"b{i}") for i in range(17)] + [("cold", "b0"), ("right", "b1")]
    found = joins.product(spark.createDataFrame(left, "k string, a string"), spark.createDataFrame(right, "k string, b string"), "k", "a", "b")
    assert pairs(found, "k", "a", "b") == sorted((k, a, b) for k, a in left for x, b in right if k == x)


@pytest.mark.parametrize("small", [0, 1000])
def test_meet(spark, monkeypatch, small):
    monkeypatch.setattr(joins, "SMALL", small)
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4)], "k string, v int")
    found = joins.meet(rows, spark.createDataFrame([("x", "X"), ("z", "Z")], "k string, dst string"), "k")
    assert pairs(found, "v", "dst") == [(1, "X"), (2, "X")]
    assert "SortMergeJoin" not in moved(found)  # a key's rows are not sorted in one task


@pytest.mark.parametrize("listed", [1, 4096])
def test_division(spark, monkeypatch, listed):
    """Equal sets on both sides, common and rare methods, an empty and an unknown method."""
    monkeypatch.setattr(R, "LISTED", listed)
    rng = random.Random(3)
    has = {f"s{i}": {rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))} for i in range(60)}
    want = {f"i{i}": {rng.choice("abcdefgh" if i else "z") for _ in range(rng.randint(1, 4))} for i in range(80)} | {"odd": {None, "a"}}
    rows = lambda of: [(x, m) for x, ms in of.items() for m in ms] * 2
    found = R.interface_satisfaction(spark.createDataFrame(rows(has), "struct string, method string"), spark.createDataFrame(rows(want), "interface string, method string"))
    assert pairs(found, "struct", "interface") == sorted((s, i) for s in has for i in want if want[i] <= has[s])


def test_division_of_equal_sets_is_done_once(spark):
    """Of 300 structs and 300 interfaces with the same eight methods, one of each is compared."""
    both = spark.range(300).crossJoin(spark.range(8).toDF("m")).select(F.concat(F.lit("x"), "id").alias("struct"), F.concat(F.lit("m"), "m").alias("method"))
    found = R.interface_satisfaction(both, both.withColumnRenamed("struct", "interface"))
    assert found.count() == 90_000
    store, arr = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, arr, spark._jvm.java.util.ArrayList())
    assert max(stages.apply(i).shuffleWriteRecords() for i in range(min(40, stages.size()))) < 20_000


def test_routes_and_templates(spark):
    """Every request and route over a few parts, free ones on both sides, against all pairs compared."""
    rng = random.Random(5)
    text = lambda free: "/" + "/".join(rng.choice(["a", "b", rng.choice(free)]) for _ in range(rng.randint(0, 3)))
    asked = {f"q{i}": (rng.choice(["get", "POST"]), text(["c", "${x}", ":id"])) for i in range(150)}
    routes = {f"r{i:03}": (rng.choice(["GET", "post"]), text([":id", "{x}", "*", "${x}"])) for i in range(60)}
    parts = lambda t: [x for x in t.split("/") if x]
    free = lambda x: x in (":id", "{x}", "*", "${x}")
    want = []
    for q, (how, url) in asked.items():
        a, best = parts(url), []
        for r, (way, path) in routes.items():
            b = parts(path)
            if how.upper() == way.upper() and len(a) == len(b) and all(x == y or free(x) or free(y) for x, y in zip(a, b)):
                best.append((a != b, sum(map(free, b)), r))
        if best:
            want.append((q, min(best)[2]))
    made = lambda of, c: spark.createDataFrame([(k, *v) for k, v in of.items()], f"id string, method string, {c} string")
    found = R.match_routes(made(asked, "url"), made(routes, "path"))
    assert pairs(found, "request", "route") == sorted(want)
    assert "SortMergeJoin" not in moved(found)


def test_overrides_are_dispatched_once(spark):
    """A call of two methods that one method overrides reaches it once; a hot base reaches all of its overrides."""
    classes, up = [f"K{i}" for i in range(30)], [("K1", "K0"), ("K2", "K1")] + [(f"K{i}", "K0") for i in range(3, 30)]
    g = Graph.of(
        spark, [(k, "CLASS") for k in classes] + [(f"{k}.m", "METHOD", "m") for k in classes],
        [(a, b, "EXTENDS") for a, b in up] + [(k, f"{k}.m", "HAS_METHOD") for k in classes] + [("c1", "K0.m", "CALLS"), ("c1", "K1.m", "CALLS"), ("c2", "K0.m", "CALLS"), ("c2", "K0.m", "CALLS")],
    )
    sent = [(a, b) for a, b, t in pairs(R.virtual_dispatch(g), "src", "dst", "edge_type") if t == "DISPATCHES_TO"]
    assert sent == sorted((c, f"K{i}.m") for c in ("c1", "c2") for i in range(1, 30))


def test_operators_of_one_name(spark):
    g = Graph.of(spark, [(f"e{i}", "OPERATOR_CALL", None, None, '{"operator":"+","left_type":"K%d"}' % (i % 3)) for i in range(30)] + [("m", "METHOD", "operator+", None, '{"className":"K1"}'), ("free", "FUNCTION", "operator+")], [])
    found = R.operator_calls(g)
    assert pairs(found, "src", "dst") == sorted((f"e{i}", "m" if i % 3 == 1 else "free") for i in range(30))
    assert "SortMergeJoin" not in moved(found)


def test_cross_file_calls_take_bindings_along(spark):
    """Bindings meet modules by path and calls by name, without a join back on the binding's id."""
    nodes = [("a", "IMPORT_BINDING", "f", "x/a.js", '{"source":"./m","importedName":"g"}'), ("s", "IMPORT_BINDING", "ns", "x/a.js", '{"source":"./m.ts","importedName":"*"}'), ("p", "IMPORT_BINDING", "pkg", "x/a.js", '{"source":"pkg"}')]
    nodes += [("m", "MODULE", "m", "x/m.ts"), ("g", "FUNCTION", "g", "x/m.ts", None, True), ("c1", "CALL", "f", "x/a.js"), ("c2", "CALL", "ns.g", "x/a.js"), ("c3", "CALL", "ns", "x/a.js"), ("c4", "CALL", "f.g", "x/a.js"), ("c5", "CALL", "pkg", "x/a.js")]
    found = R.cross_file_calls(Graph.of(spark, nodes, []))
    assert pairs(found, "src", "dst") == [("c1", "g"), ("c2", "g")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") <= 3

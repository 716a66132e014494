"""Climbing, closure and division over whole tables, against plain Python."""

from collections import defaultdict

from sparkweft import catalog


def rows(spark, sf, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{table}.parquet").select(*columns).collect()]


def test_parents_of_all_orders(spark, sf):
    nation = dict(rows(spark, sf, "customer", "c_custkey", "c_nationkey"))
    orders = rows(spark, sf, "orders", "o_orderkey", "o_custkey")
    got = [tuple(r) for r in catalog.QUERIES["parent_lookup"](spark, sf).select("origin", "node", "depth").collect()]
    assert sorted(got) == sorted((f"ORDER:{o}", f"NATION:{nation[c]}", 2) for o, c in orders if c in nation)


def test_closure_of_all_orders(spark, sf):
    nation, region = dict(rows(spark, sf, "customer", "c_custkey", "c_nationkey")), dict(rows(spark, sf, "nation", "n_nationkey", "n_regionkey"))
    up = {f"NATION:{n}": f"REGION:{r}" for n, r in region.items()} | {f"CUSTOMER:{c}": f"NATION:{n}" for c, n in nation.items()} | {f"ORDER:{o}": f"CUSTOMER:{c}" for o, c in rows(spark, sf, "orders", "o_orderkey", "o_custkey")}
    want = set()
    for x in up:
        y = x
        while y in up:
            y = up[y]
            want.add((x, y))
    assert {tuple(r) for r in catalog.QUERIES["datalog_recursive_path"](spark, sf).select("a0", "a1").collect()} == want


def test_division_by_all_orders(spark, sf):
    brand = dict(rows(spark, sf, "part", "p_partkey", "p_brand"))
    has, want = defaultdict(set), defaultdict(set)
    for o, s, p in rows(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_partkey"):
        has[f"SUPPLIER:{s}"].add(brand[p])
        want[f"ORDER:{o}"].add(brand[p])
    found = [tuple(r) for r in catalog.QUERIES["interface_satisfaction"](spark, sf).select("struct", "interface").collect()]
    assert sorted(found) == sorted((s, o) for s in has for o in want if want[o] <= has[s])

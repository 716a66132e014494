"""Open variable-length patterns reach the end of a long chain."""

from sparkweft.graph import Graph
from sparkweft.plans.cypher import cypher


def test_long_chain(spark):
    nodes = spark.createDataFrame([(f"n{i}", "EVENT", f"n{i}", "f", False, None, None) for i in range(27)], "id string, node_type string, name string, file string, exported boolean, content_hash long, metadata string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "NEXT", None) for i in range(26)] + [("n26", "n24", "NEXT", None)], "src string, dst string, edge_type string, metadata string")
    g = Graph(nodes, edges)
    for hops, first in (("*", 1), ("*2..", 2), ("*22..", 22)):
        found = cypher(g, f"MATCH (a:EVENT)-[:NEXT{hops}]->(b) WHERE a.name = 'n0' RETURN b.name AS name").collect()
        assert sorted(r["name"] for r in found) == sorted(f"n{i}" for i in range(first, 27))

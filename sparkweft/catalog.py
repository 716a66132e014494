"""The registered queries over the tables' graph view, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_code  # noqa: F401  its queries register themselves
from .functions import attributes as A
from .graph import Graph
from .operators import code_queries, guarantees, history, primitives, resolve, store, traverse
from .plans.cypher import cypher
from .plans.datalog import Datalog
from .registry import QUERIES, SQL, query  # noqa: F401
from .sources.relational import EVENT_TYPES, read, relational_graph

EVENTS = tuple(f"event:{e}" for e in EVENT_TYPES)


def graph(spark: SparkSession, sf_dir: str, nodes: tuple = ("REGION",), edges: tuple = ("IN_REGION",)) -> Graph:
    return relational_graph(spark, sf_dir, nodes, edges)


# --- scans ----------------------------------------------------------------------------------------------------------


@query("SELECT 'CUSTOMER:' || c_custkey AS id, c_name AS name FROM customer WHERE 'CUSTOMER:' || c_custkey IN ('CUSTOMER:7', 'CUSTOMER:77', 'CUSTOMER:123456789')")
def point_lookup(spark, d):
    return primitives.get_nodes(graph(spark, d, ("CUSTOMER",)), ["CUSTOMER:7", "CUSTOMER:77", "CUSTOMER:123456789"]).select("id", "name")


@query("SELECT 'NATION:' || n_nationkey AS id, 'NATION:' || n_name || '@geo/' || n_regionkey AS identifier FROM nation")
def node_identifier(spark, d):
    return primitives.identifiers(graph(spark, d, ("NATION",)))


@query("SELECT 'SUPPLIER:' || s_suppkey AS id, s_name AS name, 'crm/suppliers' AS file FROM supplier")
def node_scan_type(spark, d):
    return primitives.find_by_type(relational_graph(spark, d), "SUPPLIER").select("id", "name", "file")


@query("SELECT 'EVENT:' || event_id AS id, 'event:' || event_type AS node_type, 'events/' || user_id AS file FROM events")
def type_prefix_scan(spark, d):
    return primitives.find_by_type(relational_graph(spark, d), "event:*").select("id", "node_type", "file")


@query("SELECT 'CUSTOMER:' || c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 10 = 0")
def attr_exact(spark, d):
    return primitives.find_by_attributes(graph(spark, d, ("CUSTOMER",)), "CUSTOMER", file="crm/BUILDING", exported=True).select("id", "name")


@query("SELECT 'PART:' || p_partkey AS id, p_name AS name FROM part WHERE contains(p_name, 'an') AND contains('catalog/' || p_brand, '#2')")
def attr_substring(spark, d):
    return primitives.find_by_attributes(graph(spark, d, ("PART",)), "PART", name="an", file="#2", substring=True).select("id", "name")


@query("SELECT 'ORDER:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def meta_filter(spark, d):
    return primitives.find_by_attributes(graph(spark, d, ("ORDER",)), "ORDER", name="1-URGENT", metadata={"status": "F"}).select("id")


@query("SELECT 'EVENT:' || event_id AS id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def meta_dotted_path(spark, d):
    return graph(spark, d, EVENTS).nodes.select("id", A.json_attribute(F.col("metadata"), "props.k").alias("k")).where("k IS NOT NULL")


@query("SELECT 'CUSTOMER:' || o_custkey AS src, 'ORDER:' || o_orderkey AS dst, 'PLACED' AS edge_type FROM orders WHERE o_custkey = 7")
def out_edges(spark, d):
    return primitives.outgoing(graph(spark, d, edges=("PLACED",)), "CUSTOMER:7", ["PLACED"]).select("src", "dst", "edge_type")


@query("SELECT DISTINCT 'ORDER:' || l_orderkey AS src, 'PART:' || l_partkey AS dst FROM lineitem WHERE l_partkey = 11")
def in_edges(spark, d):
    return primitives.incoming(graph(spark, d, edges=("CONTAINS_PART",)), "PART:11", ["CONTAINS_PART"]).select("src", "dst")


@query("SELECT DISTINCT 'SUPPLIER:' || l_suppkey AS id FROM lineitem WHERE l_partkey = 11 UNION SELECT DISTINCT 'ORDER:' || l_orderkey FROM lineitem WHERE l_partkey = 11")
def neighbors(spark, d):
    return primitives.neighbors(graph(spark, d, edges=("SUPPLIED_BY", "CONTAINS_PART")), "PART:11", direction="both")


@query("SELECT 'out' AS direction, 'PLACED' AS edge_type, count(*) AS n FROM orders WHERE o_custkey = 7 HAVING count(*) > 0 UNION ALL SELECT 'out', 'IN_NATION', 1 FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'out', 'PARENT', 1 FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'in', 'PARENT', count(*) FROM orders WHERE o_custkey = 7 HAVING count(*) > 0")
def neighbors_grouped(spark, d):
    return primitives.neighbors_by_type(graph(spark, d, edges=("PLACED", "IN_NATION", "PARENT")), "CUSTOMER:7").select("direction", "edge_type", "n")


_ALL_NODES = """SELECT 'REGION' AS node_type, count(*) AS n FROM region UNION ALL SELECT 'NATION', count(*) FROM nation UNION ALL SELECT 'CUSTOMER', count(*) FROM customer
UNION ALL SELECT 'SUPPLIER', count(*) FROM supplier UNION ALL SELECT 'PART', count(*) FROM part UNION ALL SELECT 'ORDER', count(*) FROM orders
UNION ALL SELECT 'event:' || event_type, count(*) FROM events GROUP BY 1 UNION ALL SELECT 'DOCUMENT', count(*) FROM documents UNION ALL SELECT 'TURN', count(*) FROM conversations"""
_ALL_EDGES = """SELECT 'IN_REGION' AS edge_type, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders
UNION ALL SELECT 'CONTAINS_PART', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
UNION ALL SELECT 'PARENT', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)
UNION ALL SELECT 'NEXT_EVENT', count(*) - count(DISTINCT user_id) FROM events UNION ALL SELECT 'NEXT_TURN', count(*) - count(DISTINCT conv_id) FROM (SELECT DISTINCT conv_id, turn FROM conversations)
UNION ALL SELECT 'SAME_SOURCE', count(*) - count(DISTINCT source) FROM documents"""


@query(_ALL_NODES)
def count_nodes_by_type(spark, d):
    return primitives.count_nodes_by_type(relational_graph(spark, d))


@query(_ALL_EDGES)
def count_edges_by_type(spark, d):
    return primitives.count_edges_by_type(relational_graph(spark, d))


@query(f"SELECT (SELECT CAST(sum(n) AS BIGINT) FROM ({_ALL_NODES})) AS node_count, (SELECT CAST(sum(n) AS BIGINT) FROM ({_ALL_EDGES})) AS edge_count")
def graph_totals(spark, d):
    return primitives.totals(relational_graph(spark, d))


@query("SELECT 'PART:' || p_partkey AS id FROM part WHERE 'PART:' || p_partkey > 'PART:150' ORDER BY id LIMIT 25")
def cursor_page(spark, d):
    return primitives.page_after(graph(spark, d, ("PART",)).nodes.select("id"), primitives.cursor("PART:150"), 25)


@query("SELECT 'SUPPLIER:' || s_suppkey AS id FROM supplier ORDER BY id LIMIT 10 OFFSET 20")
def offset_page(spark, d):
    return primitives.page(graph(spark, d, ("SUPPLIER",)).nodes.select("id"), 10, 20)[0]


@query("SELECT DISTINCT 'ORDER:' || o_orderkey AS dst FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_parts(spark, d):
    g = graph(spark, d, ("ORDER",), ("CONTAINS_PART",))
    return g.nodes.join(g.edges.select(F.col("src").alias("id")), "id", "left_anti").select(F.col("id").alias("dst"))


@query("SELECT 'CUSTOMER:' || o_custkey AS src, 'ORDER:' || o_orderkey AS dst FROM orders WHERE o_custkey % 10 = 0")
def dangling_edges(spark, d):
    g = graph(spark, d, ("CUSTOMER", "ORDER"), ("PLACED",))
    return primitives.dangling_edges(Graph(g.nodes.where("NOT (node_type = 'CUSTOMER' AND exported)"), g.edges)).select("src", "dst")


@query("SELECT 'SUPPLIER:' || s_suppkey AS id, 'SUPPLIER' AS node_type, s_name AS name FROM supplier WHERE s_suppkey BETWEEN 1 AND 3 UNION ALL SELECT 'GHOST:1', 'UNKNOWN', NULL")
def ids_with_records(spark, d):
    ids = spark.createDataFrame([("SUPPLIER:1",), ("SUPPLIER:2",), ("SUPPLIER:3",), ("GHOST:1",)], "id string")
    return primitives.with_nodes(ids, graph(spark, d, ("SUPPLIER",))).select("id", "node_type", "name").where("node_type = 'UNKNOWN' OR name IS NOT NULL")


@query("SELECT quantile_disc(value, 0.5) AS p50, count(*) AS queries FROM events")
def latency_percentiles(spark, d):
    return primitives.latency_stats(read(spark, d, "events"), "value").select("p50", "queries")


# --- Cypher ---------------------------------------------------------------------------------------------------------


@query("SELECT n_name AS name, count(*) AS cnt FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY cnt DESC, name LIMIT 5")
def cypher_expand_agg(spark, d):
    return cypher(graph(spark, d, ("CUSTOMER", "NATION"), ("IN_NATION",)), "MATCH (c:CUSTOMER)-[:IN_NATION]->(n:NATION) RETURN n.name AS name, COUNT(c) AS cnt ORDER BY cnt DESC, name LIMIT 5")


@query("SELECT 'CUSTOMER:' || c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING' AND NOT contains(c_name, '9')")
def cypher_filter_project(spark, d):
    return cypher(graph(spark, d, ("CUSTOMER",)), "MATCH (c:CUSTOMER) WHERE c.acctbal > 5000 AND c.segment <> 'BUILDING' AND NOT c.name CONTAINS '9' RETURN c.id AS id, c.name AS name")


@query("SELECT c_name AS customer, count(*) AS parts FROM customer JOIN orders ON o_custkey = c_custkey JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY c_name")
def cypher_two_hop(spark, d):
    return cypher(graph(spark, d, ("CUSTOMER", "ORDER", "PART"), ("PLACED", "CONTAINS_PART")), "MATCH (c:CUSTOMER)-[:PLACED]->(o:ORDER {status: 'O'})-[:CONTAINS_PART]->(p:PART) RETURN c.name AS customer, COUNT(*) AS parts")


@query("SELECT 'NATION:' || n_nationkey AS nation, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def cypher_incoming(spark, d):
    return cypher(graph(spark, d, ("SUPPLIER", "NATION"), ("IN_NATION",)), "MATCH (n:NATION)<-[r:IN_NATION]-(s:SUPPLIER) RETURN n.id AS nation, COUNT(s) AS n")


@query("SELECT 'SUPPLIER:' || l_suppkey AS other FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey = 11) UNION ALL SELECT 'ORDER:' || l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 11)")
def cypher_undirected(spark, d):
    return cypher(graph(spark, d, ("PART", "SUPPLIER", "ORDER"), ("SUPPLIED_BY", "CONTAINS_PART")), "MATCH (p:PART {id: 'PART:11'})-[:SUPPLIED_BY|CONTAINS_PART]-(x) RETURN x.id AS other")


@query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t)
SELECT 'TURN:' || a.conv_id || ':' || a.turn AS start, 'TURN:' || b.conv_id || ':' || b.turn AS goal FROM o a JOIN o b ON a.conv_id = b.conv_id AND b.k - a.k BETWEEN 1 AND 3
WHERE a.turn = 0 AND b.turn IN (SELECT turn FROM t)""")
def cypher_var_length(spark, d):
    g = graph(spark, d, ("TURN",), ("NEXT_TURN",))
    g = Graph(g.nodes.dropDuplicates(["id"]), g.edges)
    return cypher(g, "MATCH (a:TURN)-[:NEXT_TURN*1..3]->(b:TURN) WHERE a.turn = 0 RETURN a.id AS start, b.id AS goal")


@query("SELECT 'PART:' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand FROM part ORDER BY brand ASC NULLS FIRST, id LIMIT 40")
def cypher_order_limit_nulls(spark, d):
    g = graph(spark, d, ("PART",))
    halved = g.nodes.withColumn("metadata", F.when(F.substring_index("id", ":", -1).cast("long") % 2 == 0, F.col("metadata")))
    return cypher(Graph(halved, g.edges), "MATCH (p:PART) RETURN p.id AS id, p.brand AS brand ORDER BY p.brand, p.id LIMIT 40")


@query("SELECT p_name AS name FROM part WHERE (starts_with(p_brand, 'Brand#4') OR ends_with(p_brand, '3')) AND contains(p_name, 'a')")
def cypher_string_preds(spark, d):
    return cypher(graph(spark, d, ("PART",)), "MATCH (p:PART) WHERE (p.brand STARTS WITH 'Brand#4' OR p.brand ENDS WITH '3') AND p.name CONTAINS 'a' RETURN p.name AS name")


@query("SELECT p_brand AS brand, count(*) AS n, min(p_size) AS least, max(p_size) AS most, avg(p_size) AS mean FROM part WHERE p_size IS NOT NULL GROUP BY p_brand")
def cypher_aggregates(spark, d):
    return cypher(graph(spark, d, ("PART",)), "MATCH (p:PART) WHERE p.size IS NOT NULL RETURN p.brand AS brand, COUNT(p) AS n, MIN(p.size) AS least, MAX(p.size) AS most, AVG(p.size) AS mean")


# --- Datalog --------------------------------------------------------------------------------------------------------


@query("SELECT 'CUSTOMER:' || c_custkey AS C, 'REGION:' || n_regionkey AS R FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY'")
def datalog_join(spark, d):
    g = graph(spark, d, ("CUSTOMER", "NATION"), ("IN_NATION", "IN_REGION"))
    return Datalog(g).query('node(C, "CUSTOMER"), attr(C, "segment", "MACHINERY"), edge(C, N, "IN_NATION"), edge(N, R, "IN_REGION")').select("C", "R")


@query("SELECT 'ORDER:' || o_orderkey AS a0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def datalog_negation(spark, d):
    return Datalog(graph(spark, d, ("ORDER",), ("CONTAINS_PART",)), 'violation(X) :- node(X, "ORDER"), \\+ edge(X, _, "CONTAINS_PART").').relation("violation")


@query("SELECT 'ORDER:' || o_orderkey AS a0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def datalog_wildcard_source(spark, d):
    """Orders that no part points at, over the edges turned round."""
    g = graph(spark, d, ("ORDER",), ("CONTAINS_PART",))
    turned = Graph(g.nodes, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "metadata"))
    return Datalog(turned, 'unused(X) :- node(X, "ORDER"), \\+ edge(_, X, "CONTAINS_PART").').relation("unused")


@query("SELECT 'NATION:' || a.n_nationkey AS A, 'NATION:' || b.n_nationkey AS B FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def datalog_neq(spark, d):
    return Datalog(graph(spark, d, ("NATION",))).query('edge(A, R, "IN_REGION"), edge(B, R, "IN_REGION"), neq(A, B)').select("A", "B")


@query("SELECT 'CUSTOMER:' || c_custkey AS a0 FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') UNION SELECT 'SUPPLIER:' || s_suppkey FROM supplier WHERE starts_with(s_name, 'S') AND NOT contains(s_name, '1')")
def datalog_union_rules(spark, d):
    program = """
    party(X) :- node(X, "CUSTOMER"), (attr(X, "segment", "BUILDING") ; attr(X, "segment", "FURNITURE")).
    party(X) :- node(X, "SUPPLIER"), attr(X, "name", N), starts_with(N, "S"), \\+ string_contains(N, "1").
    """
    return Datalog(graph(spark, d, ("CUSTOMER", "SUPPLIER")), program).relation("party")


@query("SELECT 'PART:' || p_partkey AS P FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND CAST(p_size AS VARCHAR) = '7' OR p_brand = 'Brand#13' AND p_size = 7")
def datalog_attr_reverse(spark, d):
    brand = read(spark, d, "part").agg(F.min("p_brand")).first()[0]
    return Datalog(graph(spark, d, ("PART",))).query(f'attr(P, "size", "7"), (attr(P, "brand", "{brand}") ; attr(P, "brand", "Brand#13")), node(P, "PART")').select("P")


@query("SELECT 'ORDER:' || l_orderkey AS O, 'PART:' || l_partkey AS P FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) = 2")
def datalog_attr_edge(spark, d):
    return Datalog(graph(spark, d, edges=("CONTAINS_PART",))).query('edge(O, P, "CONTAINS_PART"), attr_edge(O, P, "CONTAINS_PART", "lines", "2")').select("O", "P")


_ANCESTORS = """WITH RECURSIVE parent AS (SELECT 'ORDER:' || o_orderkey AS a, 'CUSTOMER:' || o_custkey AS b FROM orders
UNION ALL SELECT 'CUSTOMER:' || c_custkey, 'NATION:' || c_nationkey FROM customer UNION ALL SELECT 'NATION:' || n_nationkey, 'REGION:' || n_regionkey FROM nation),
up AS (SELECT a, b FROM parent UNION SELECT up.a, p.b FROM up JOIN parent p ON up.b = p.a) """


@query(_ANCESTORS + "SELECT a AS a0, b AS a1 FROM up")
def datalog_recursive_path(spark, d):
    return Datalog(graph(spark, d, ("ORDER",), ("PARENT",)), 'above(X, Y) :- edge(X, Y, "PARENT"). above(X, Z) :- above(X, Y), edge(Y, Z, "PARENT").').relation("above")


@query("SELECT 'REGION:' || n_regionkey AS T FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7 UNION SELECT 'NATION:' || c_nationkey FROM customer WHERE c_custkey = 7")
def datalog_path(spark, d):
    return Datalog(graph(spark, d, ("CUSTOMER",), ("PARENT",))).query('path("CUSTOMER:7", T)')


# --- traversal ------------------------------------------------------------------------------------------------------


_PARTS = """WITH RECURSIVE e AS (SELECT DISTINCT 'PART:' || l_partkey AS a, 'SUPPLIER:' || l_suppkey AS b FROM lineitem), m AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT 'PART:11' AS id, 0 AS depth UNION SELECT m.b, r.depth + 1 FROM r JOIN m ON m.a = r.id WHERE r.depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY id"""


@query(_PARTS)
def bfs_depth(spark, d):
    return traverse.bfs(graph(spark, d, edges=("SUPPLIED_BY",)), ["PART:11"], 2, ["SUPPLIED_BY"], "both")


@query(_PARTS.replace("SELECT id, min(depth) AS depth FROM r GROUP BY id", "SELECT DISTINCT id FROM r"))
def dfs_set(spark, d):
    g = graph(spark, d, edges=("SUPPLIED_BY",))
    return traverse.dfs(Graph(g.nodes, g.edges.union(g.edges.select("dst", "src", "edge_type", "metadata"))), ["PART:11"], 2)


@query("""SELECT 'REGION:1' AS id, 0 AS depth UNION ALL SELECT 'NATION:' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'CUSTOMER:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def reachability_back(spark, d):
    return traverse.reachability(graph(spark, d, edges=("PARENT",)), "REGION:1", 2, ["PARENT"], backward=True)


@query("SELECT 'ORDER:' || o_orderkey AS origin, 'NATION:' || c_nationkey AS node, 2 AS depth FROM orders JOIN customer ON o_custkey = c_custkey")
def parent_lookup(spark, d):
    g = graph(spark, d, ("NATION", "CUSTOMER", "REGION"), ("PARENT",))
    up = Graph(g.nodes, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "metadata"))
    orders = read(spark, d, "orders").select(F.concat(F.lit("ORDER:"), F.col("o_orderkey").cast("string")).alias("origin"))
    kind = F.col("node_type")
    return traverse.upward(orders.select("origin", F.col("origin").alias("node")), up, ["PARENT"], kind == "NATION", kind == "REGION")


@query("""WITH o AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), s AS (SELECT * FROM o WHERE event_id IN (3, 33, 333))
SELECT 'EVENT:' || s.event_id AS origin, 'EVENT:' || o.event_id AS node, CAST(o.k - s.k AS INTEGER) AS depth FROM s JOIN o USING (user_id) WHERE o.k - s.k BETWEEN 0 AND 5""")
def alias_chain(spark, d):
    moves = graph(spark, d, edges=("NEXT_EVENT",)).edges.select("src", "dst")
    seeds = spark.createDataFrame([(f"EVENT:{i}",) * 2 for i in (3, 33, 333)], "origin string, node string")
    return traverse.chain(seeds, moves, 5).select("origin", "node", "depth")


# --- store ----------------------------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upsert_latest(spark, d):
    return store.latest(read(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], F.col("event_id"))


@query("SELECT 'PART:' || p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 10 <> 0")
def tombstone_filter(spark, d):
    g = graph(spark, d, ("PART",))
    return store.without(g.nodes, g.nodes.where("exported").select("id"), ["id"]).select("id", "name")


@query("SELECT 'PART:' || p_partkey AS id, p_size + CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 0 END AS size FROM part WHERE p_partkey % 4 <> 0 OR p_partkey % 3 = 0 AND p_partkey % 8 <> 0")
def compaction_merge(spark, d):
    part = read(spark, d, "part").select(F.concat(F.lit("PART:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").alias("size"), F.col("p_partkey").alias("k"))
    batches = part.select("id", "size", F.lit(1).alias("batch")).union(part.where("k % 3 = 0").select("id", F.col("size") + 100, F.lit(3)))
    dead = part.where("k % 4 = 0").select("id", F.when(F.col("k") % 8 == 0, 4).otherwise(2).alias("batch"))
    return store.merge(batches, dead, ["id"], "batch")


def _versions(spark, d):
    part = read(spark, d, "part").select(F.concat(F.lit("PART:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("PART").alias("node_type"), "p_retailprice", "p_partkey")
    price = F.when(F.col("p_partkey") % 5 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    hashed = lambda df, c: df.select("id", "node_type", F.xxhash64(c).alias("content_hash"))
    return hashed(part.where("p_partkey % 10 <> 0"), F.col("p_retailprice")), hashed(part.where("p_partkey % 7 <> 0"), price)


@query("""SELECT change, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 10 = 0 AND p_partkey % 7 <> 0 THEN 'added' WHEN p_partkey % 10 <> 0 AND p_partkey % 7 = 0 THEN 'removed'
WHEN p_partkey % 10 <> 0 AND p_partkey % 5 = 0 THEN 'modified' END AS change FROM part) WHERE change IS NOT NULL GROUP BY change""")
def commit_delta(spark, d):
    return store.node_delta(*_versions(spark, d)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'added' AS side, count(*) AS n FROM part WHERE p_partkey % 7 <> 0 AND (p_partkey % 10 = 0 OR p_partkey % 5 = 0)
UNION ALL SELECT 'removed', count(*) FROM part WHERE p_partkey % 10 <> 0 AND (p_partkey % 7 = 0 OR p_partkey % 5 = 0)""")
def snapshot_diff(spark, d):
    old, new = _versions(spark, d)
    return store.row_diff(old, new).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'NATION:' || n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS name FROM nation WHERE n_regionkey <> 1 OR n_nationkey % 2 = 0""")
def commit_batch(spark, d):
    g = graph(spark, d, ("NATION",))
    new = g.nodes.where("file = 'geo/1'").where(F.substring_index("id", ":", -1).cast("int") % 2 == 0).withColumn("name", F.concat(F.upper("name"), F.lit("!")))
    return store.commit_batch(g, ["geo/1"], new, g.edges.limit(0)).graph.nodes.select("id", "name")


@query("SELECT DISTINCT 'crm/' || c_mktsegment AS file FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION SELECT DISTINCT 'crm/suppliers' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def dependent_files(spark, d):
    return store.dependent_files(graph(spark, d, ("NATION", "CUSTOMER", "SUPPLIER"), ("IN_NATION",)), ["geo/1"])


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 'added' WHEN p_partkey % 7 = 0 THEN 'deleted' WHEN p_partkey % 5 = 0 THEN 'modified' ELSE 'unchanged' END AS change FROM part WHERE NOT (p_partkey % 10 = 0 AND p_partkey % 7 = 0)")
def version_classes(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size")
    local = part.where("k % 7 <> 0").withColumn("p_size", F.when(F.col("k") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return store.classify_versions(part.where("k % 10 <> 0"), local, "k", ["p_name", "p_size"])


@query("SELECT 'BUILDINGS' AS node_type, 'BUILDING' AS close_to UNION ALL SELECT 'MACHNERY', 'MACHINERY'")
def similar_types_levenshtein(spark, d):
    known = read(spark, d, "customer").select(F.col("c_mktsegment").alias("node_type"))
    return store.suspicious_types(spark.createDataFrame([("BUILDINGS",), ("MACHNERY",), ("SPACESHIP",), ("BUILDING",)], "node_type string"), known, "node_type")


# --- history --------------------------------------------------------------------------------------------------------


def _commits(spark, d):
    """One commit for each order: its parts' brands are the files."""
    lines = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    files = lines.groupBy("l_orderkey", "p_brand").agg(F.sum("l_quantity").cast("int").alias("added"), F.count(F.lit(1)).cast("int").alias("removed"))
    grouped = files.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("catalog/"), "p_brand").alias("path"), "added", "removed")).alias("files"))
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("CUSTOMER:"), F.col("o_custkey").cast("string")).alias("author_ref"))
    return orders.join(grouped, "l_orderkey").select(F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("hash"), "date", "author_ref", "files")


_FILES = """WITH f AS (SELECT l_orderkey AS h, 'catalog/' || p_brand AS path, sum(l_quantity) AS added, count(*) AS removed FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
c AS (SELECT h, path, added, removed, strftime(o_orderdate, '%Y-%m-%d') AS date, 'CUSTOMER:' || o_custkey AS author FROM f JOIN orders ON o_orderkey = h) """


@query(_FILES + "SELECT path, count(*) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM c WHERE date >= '1995-01-01' GROUP BY path")
def churn(spark, d):
    return history.churn(_commits(spark, d), since="1995-01-01")


@query(_FILES + """, t AS (SELECT path, count(*) AS n FROM c GROUP BY path)
SELECT a.path AS path, b.path AS other, count(*) AS together, count(*) / any_value(t.n) AS support FROM c a JOIN c b ON a.h = b.h AND a.path <> b.path JOIN t ON t.path = a.path GROUP BY a.path, b.path HAVING count(*) / any_value(t.n) >= 0.1""")
def co_change(spark, d):
    return history.co_change(_commits(spark, d), 0.1)


@query(_FILES + "SELECT path, coalesce(c_name, author) AS author, count(*) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM c LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON author = 'CUSTOMER:' || c_custkey WHERE path = 'catalog/Brand#13' GROUP BY 1, 2")
def ownership(spark, d):
    authors = read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("CUSTOMER:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    return history.ownership(_commits(spark, d), authors, "catalog/Brand#13")


@query(_FILES + "SELECT path, min(date) AS first_date, arg_min(author, (date, lpad(CAST(h AS VARCHAR), 12, '0'))) AS first_author, max(date) AS last_date, arg_max(author, (date, lpad(CAST(h AS VARCHAR), 12, '0'))) AS last_author, count(*) AS commits FROM c GROUP BY path")
def archaeology(spark, d):
    return history.archaeology(_commits(spark, d))


# --- rules and code-graph joins ---------------------------------------------------------------------------------------


RULES = [
    guarantees.Guarantee("parts", "orders have parts", 'violation(X) :- node(X, "ORDER"), \\+ edge(X, _, "CONTAINS_PART").', "error"),
    guarantees.Guarantee("buyers", "no builders in region 1", 'violation(X) :- node(X, "CUSTOMER"), attr(X, "segment", "BUILDING"), edge(X, N, "IN_NATION"), edge(N, "REGION:1", "IN_REGION").', "warning"),
    guarantees.Guarantee("regions", "nations lie in regions", 'violation(X) :- node(X, "NATION"), \\+ edge(X, _, "IN_REGION").', "error"),
]


@query("""SELECT 'parts' AS guarantee, 'error' AS severity, n AS violations, n = 0 AS passed FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
UNION ALL SELECT 'buyers', 'warning', n, n = 0 FROM (SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'BUILDING') UNION ALL SELECT 'regions', 'error', 0, true""")
def guarantee_summary(spark, d):
    return guarantees.summary(graph(spark, d, ("ORDER", "CUSTOMER", "NATION"), ("CONTAINS_PART", "IN_NATION", "IN_REGION")), RULES)


@query("SELECT 'buyers' AS guarantee, 'CUSTOMER:' || c_custkey AS id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'BUILDING'")
def guarantee_selective(spark, d):
    return guarantees.check_selective(graph(spark, d, ("ORDER", "CUSTOMER", "NATION"), ("CONTAINS_PART", "IN_NATION", "IN_REGION")), RULES, ["IN_NATION"]).select("guarantee", "id", "name")


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS s, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey), w AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT o, count(*) AS size FROM w GROUP BY o)
SELECT 'SUPPLIER:' || s AS struct, 'ORDER:' || o AS interface FROM s JOIN w USING (b) JOIN n USING (o) GROUP BY s, o, size HAVING count(*) = size""")
def interface_satisfaction(spark, d):
    lines = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("method")), "l_partkey")
    label = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    return resolve.interface_satisfaction(lines.select(label("SUPPLIER", "l_suppkey").alias("struct"), "method"), lines.select(label("ORDER", "l_orderkey").alias("interface"), "method"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), w AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), n AS (SELECT o, count(*) AS size FROM w GROUP BY o)
SELECT 'SUPPLIER:' || s AS struct, 'ORDER:' || o AS interface FROM s JOIN w USING (p) JOIN n USING (o) GROUP BY s, o, size HAVING count(*) = size""")
def interface_satisfaction_parts(spark, d):
    """Suppliers that have supplied every part of an order: many methods, few of them shared."""
    lines = read(spark, d, "lineitem")
    label = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    return resolve.interface_satisfaction(lines.select(label("SUPPLIER", "l_suppkey").alias("struct"), F.col("l_partkey").alias("method")), lines.select(label("ORDER", "l_orderkey").alias("interface"), F.col("l_partkey").alias("method")))


@query("""WITH f AS (SELECT source AS file, doc_id AS line, doc_id + n_chars % 200 AS last FROM documents WHERE doc_id % 7 = 0), c AS (SELECT source AS file, doc_id AS line FROM documents WHERE doc_id % 7 <> 0)
SELECT 'C' || c.line AS call, arg_min('F' || f.line, (f.last - f.line, 'F' || f.line)) AS function FROM c JOIN f ON c.file = f.file AND c.line BETWEEN f.line AND f.last GROUP BY c.line""")
def range_containment_calls(spark, d):
    docs = read(spark, d, "documents").select("source", "doc_id", "n_chars")
    node = lambda df, prefix, kind, last: df.select(F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("id"), F.lit(kind).alias("node_type"), F.lit(None).cast("string").alias("name"), F.col("source").alias("file"), F.lit(None).cast("boolean").alias("exported"), F.lit(None).cast("long").alias("content_hash"), F.to_json(F.struct(F.col("doc_id").alias("line"), last.alias("endLine"))).alias("metadata"))
    nodes = node(docs.where("doc_id % 7 = 0"), "F", "FUNCTION", F.col("doc_id") + F.col("n_chars") % 200).union(node(docs.where("doc_id % 7 <> 0"), "C", "CALL", F.col("doc_id")))
    return code_queries.calls_by_position(Graph(nodes, graph(spark, d).edges)).select("call", "function")


@query("""WITH t AS (SELECT source AS ext, CASE WHEN lang = 'en' THEN 'analyzed' WHEN source IN ('src1', 'src2') THEN 'unreachable' ELSE 'unsupported' END AS status FROM documents)
SELECT '.' || ext AS ext, status, count(*) AS n, CAST(round(100.0 * count(*) / (SELECT count(*) FROM t)) AS INTEGER) AS percent FROM t GROUP BY 1, 2""")
def coverage(spark, d):
    docs = read(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit("."), "source").alias("path"), "lang")
    return code_queries.coverage(docs.select("path"), docs.where("lang = 'en'").select(F.col("path").alias("file")), [".src1", ".src2"])


@query(f"SELECT 'node' AS kind, node_type AS type, n FROM ({_ALL_NODES}) UNION ALL SELECT 'edge', edge_type, n FROM ({_ALL_EDGES})")
def schema_export(spark, d):
    return code_queries.schema_export(relational_graph(spark, d))


@query("SELECT event_id AS request, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'any' END AS route FROM events WHERE event_type = 'view'")
def http_route_match(spark, d):
    views = read(spark, d, "events").where("event_type = 'view'")
    requests = views.select(F.col("event_id").alias("id"), F.lit("get").alias("method"), F.concat(F.lit("https://x.org/api/"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"), F.lit("/"), F.col("user_id").cast("string"), F.lit("?q=1")).alias("url"))
    routes = spark.createDataFrame([("any", "GET", "/api/:kind/:id"), ("even", "GET", "/api/even/{id}"), ("post", "POST", "/api/even/:id"), ("short", "GET", "/api/even")], "id string, method string, path string")
    return resolve.match_routes(requests, routes)


@query("SELECT event_type || user_id % 3 AS request, CASE WHEN event_type = 'view' AND user_id % 3 = 0 THEN 'deep' WHEN event_type IN ('view', 'click') THEN 'late-' || event_type ELSE 'root' END AS rule FROM events GROUP BY 1, 2")
def routing_rules(spark, d):
    events = read(spark, d, "events").select("event_type", F.col("user_id") % 3).distinct().toDF("event_type", "k")
    requests = events.select(F.concat("event_type", F.col("k").cast("string")).alias("id"), F.concat(F.lit("/"), "event_type", F.when(F.col("k") == 0, "/zero/x").otherwise("/y")).alias("path"))
    rules = spark.createDataFrame([("root", "/", 5, 0), ("early-view", "/view", 9, 1), ("late-view", "/view", 1, 2), ("late-click", "/click/", 1, 3), ("later-click", "/click", 1, 4), ("deep", "/view/zero", 7, 5)], "id string, strip_prefix string, priority int, seq int")
    return resolve.route_rules(requests, rules)


# --- streams --------------------------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_upsert(spark, d):
    from .scratch import scratch_path
    from .streaming.incremental import UpsertSink, stream_upserts

    events = read(spark, d, "events").select("user_id", "event_id", "event_type")
    inbox = scratch_path(spark, "inbox")
    events.withColumn("part", F.col("event_id") % 3).write.partitionBy("part").parquet(inbox)
    schema = "user_id bigint, event_id bigint, event_type string"
    sink = UpsertSink(spark, scratch_path(spark, "sink"), ["user_id"], "event_id", schema)
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 4).parquet(inbox).drop("part")
    stream_upserts(stream, sink, scratch_path(spark, "stream")).awaitTermination()
    return sink.read().select("user_id", "event_id", "event_type")

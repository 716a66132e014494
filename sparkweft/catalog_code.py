"""Registered queries of the code-graph operators, over code graphs that are made of the tables.

A nation is a module (its file is src/<region>/<nation>.js), a customer a function of it, an order a call from it to
the next customer's function, a part a class or a value. Every table is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import EDGE_SCHEMA, NODE_SCHEMA, Graph
from .operators import code_queries as C
from .operators import guarantees, history, knowledge, primitives, resolve, store, traverse
from .plans.datalog import Datalog
from .registry import query
from .sources.relational import read

_FILE = "concat('src/', n_regionkey, '/', n_nationkey, '.js')"


def nodes(df: DataFrame, key: str, kind: str, name: str = "NULL", file: str = "NULL", meta: str = "NULL", exported: str = "NULL") -> DataFrame:
    """Nodes from SQL expressions over df; meta is a struct or NULL."""
    metadata = f"to_json({meta})" if meta != "NULL" else "CAST(NULL AS STRING)"
    return df.selectExpr(f"{key} AS id", f"{kind} AS node_type", f"CAST({name} AS STRING) AS name", f"CAST({file} AS STRING) AS file", f"CAST({exported} AS BOOLEAN) AS exported", "CAST(NULL AS BIGINT) AS content_hash", f"{metadata} AS metadata")


def edges(df: DataFrame, src: str, dst: str, kind: str, meta: str = "NULL") -> DataFrame:
    metadata = f"to_json({meta})" if meta != "NULL" else "CAST(NULL AS STRING)"
    return df.selectExpr(f"{src} AS src", f"{dst} AS dst", f"{kind} AS edge_type", f"{metadata} AS metadata")


def graph(spark, ns: list[DataFrame], es: list[DataFrame] = ()) -> Graph:
    n, e = spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA)
    for x in ns:
        n = n.unionByName(x)
    for x in es:
        e = e.unionByName(x)
    return Graph(n, e)


def people(spark, d) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


def calls(spark, d) -> DataFrame:
    """Orders with their customer's nation: a call stands in the customer's file."""
    return read(spark, d, "orders").join(people(spark, d), F.col("o_custkey") == F.col("c_custkey"))


def code(spark, d) -> Graph:
    """Modules contain functions, functions contain calls, a call goes to the function that follows its own."""
    p, c = people(spark, d), calls(spark, d)
    n = read(spark, d, "nation")
    last = read(spark, d, "customer").agg(F.max("c_custkey")).first()[0]
    ns = [
        nodes(n, "concat('M:', n_nationkey)", "'MODULE'", "n_name", _FILE, "struct(n_regionkey AS region)"),
        nodes(p, "concat('F:', c_custkey)", "'FUNCTION'", "concat('fn', c_custkey)", _FILE, "struct(c_custkey * 10 AS line, c_custkey * 10 + 9 AS endLine)", "c_custkey % 2 = 0"),
        nodes(c, "concat('C:', o_orderkey)", "'CALL'", "concat('fn', c_custkey + 1)", _FILE, "struct(c_custkey * 10 + o_orderkey % 10 AS line)"),
    ]
    es = [
        edges(p, "concat('M:', n_nationkey)", "concat('F:', c_custkey)", "'CONTAINS'"),
        edges(c, "concat('F:', c_custkey)", "concat('C:', o_orderkey)", "'CONTAINS'"),
        edges(c.where(F.col("c_custkey") < last), "concat('C:', o_orderkey)", "concat('F:', c_custkey + 1)", "'CALLS'"),
    ]
    return graph(spark, ns, es)


#: The same graph in SQL.
_CODE = """WITH p AS (SELECT *, 'src/' || n_regionkey || '/' || n_nationkey || '.js' AS file FROM customer JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT * FROM orders JOIN p ON o_custkey = c_custkey), top AS (SELECT max(c_custkey) AS m FROM customer), r AS (SELECT c.* FROM c, top WHERE c_custkey < m) """


# --- calls and containment ------------------------------------------------------------------------------------------


@query(_CODE + "SELECT 'C:' || o_orderkey AS call, CASE WHEN c_custkey < m THEN 'F:' || (c_custkey + 1) END AS target, c_custkey < m AS resolved FROM c, top")
def call_targets(spark, d):
    return C.call_targets(code(spark, d))


@query(_CODE + "SELECT 'C:' || o_orderkey AS id, file, 'F:7' AS target FROM c WHERE c_custkey = 6")
def find_calls(spark, d):
    return C.find_calls(code(spark, d), "fn7").select("id", "file", "target")


@query(_CODE + "SELECT file, c_custkey * 10 + o_orderkey % 10 AS line, min('C:' || o_orderkey) AS id, 'call' AS via FROM c WHERE c_custkey = 6 GROUP BY 1, 2")
def callers(spark, d):
    return C.callers(code(spark, d), "FN7")


@query(_CODE + "SELECT 'C:' || o_orderkey AS origin, 'F:' || c_custkey AS node, 1 AS depth FROM c")
def containing_function(spark, d):
    g = code(spark, d)
    return C.containing(g, primitives.find_by_type(g, "CALL"))


@query(_CODE + "SELECT 'F:7' AS origin, 'C:' || o_orderkey AS call, 'F:' || (c_custkey + 1) AS target, c_custkey - 7 AS level FROM r WHERE c_custkey BETWEEN 7 AND 12")
def calls_in_function_transitive(spark, d):
    return C.calls_in(code(spark, d), ["F:7"], transitive=True).select("origin", "call", "target", "level")


@query(_CODE + "SELECT 'F:7' AS origin, 'C:' || o_orderkey AS call, 'F:8' AS target FROM c WHERE c_custkey = 7")
def calls_in_function(spark, d):
    return C.function_details(code(spark, d), "F:7")[0].select("origin", "call", "target")


@query(_CODE + "SELECT 'C:' || o_orderkey AS call, 'F:6' AS node FROM c WHERE c_custkey = 6")
def function_callers(spark, d):
    return C.function_details(code(spark, d), "F:7")[1]


@query(_CODE + "SELECT 'C:' || o_orderkey AS id, 0 AS n FROM c WHERE c_custkey = 6")
def call_tree_level(spark, d):
    return C.call_tree(code(spark, d), "F:7").select("id", F.col("n").cast("int").alias("n"))


@query(_CODE + "SELECT 'F:' || c_custkey AS function, 'C:' || o_orderkey AS call FROM c")
def calls_by_line(spark, d):
    return C.calls_by_position(code(spark, d))


@query(_CODE + "SELECT 'function' AS kind, 'F:' || c_custkey AS id, 'fn' || c_custkey AS name, c_custkey * 10 AS line, (SELECT list(DISTINCT 'fn' || (x.c_custkey + 1)) FROM c x WHERE x.c_custkey = p.c_custkey) AS members FROM p WHERE c_nationkey = 3")
def file_overview(spark, d):
    g = code(spark, d)
    at = read(spark, d, "nation").where("n_nationkey = 3").selectExpr(_FILE).first()[0]
    return C.file_overview(g, at)


@query(_CODE + "SELECT min('C:' || o_orderkey) AS id FROM c WHERE c_custkey = (SELECT min(o_custkey) FROM orders) AND c_custkey * 10 + o_orderkey % 10 = (SELECT min(c_custkey * 10 + o_orderkey % 10) FROM c)")
def node_at_cursor(spark, d):
    g = code(spark, d)
    first = g.nodes.where("node_type = 'CALL'").selectExpr("file", "CAST(get_json_object(metadata, '$.line') AS INT) AS line").orderBy("line").first()
    return C.node_at(g, first["file"], first["line"], 0).select("id")


@query(_CODE + "SELECT 'in' AS direction, 'CONTAINS' AS edge_type, true AS structural, 1 AS n FROM p WHERE c_custkey = 7 UNION ALL SELECT 'out', 'CONTAINS', true, count(*) FROM c WHERE c_custkey = 7 HAVING count(*) > 0 UNION ALL SELECT 'in', 'CALLS', false, count(*) FROM c WHERE c_custkey = 6 HAVING count(*) > 0")
def node_context_groups(spark, d):
    return C.node_context(code(spark, d), "F:7").select("direction", "edge_type", "structural", F.size("members").alias("n"))


@query(_CODE + "SELECT 'M:3' AS id UNION ALL SELECT 'F:' || c_custkey FROM p WHERE c_nationkey = 3 UNION ALL SELECT 'C:' || o_orderkey FROM c WHERE c_nationkey = 3 UNION SELECT 'F:' || (c_custkey + 1) FROM r WHERE c_nationkey = 3")
def subgraph_two_levels(spark, d):
    return C.subgraph(code(spark, d), "M:3", 2).nodes.select("id").distinct()


# --- values ---------------------------------------------------------------------------------------------------------


def values(spark, d) -> Graph:
    """Variables (orders) are assigned from expressions (line numbers) that derive from literals, parameters (parts)
    or what cannot be told."""
    lines = read(spark, d, "lineitem")
    expression = "concat('E:', l_orderkey, ':', l_linenumber)"
    source = "CASE l_linenumber % 4 WHEN 0 THEN concat('P:', l_partkey) WHEN 1 THEN concat('L:', CAST(l_quantity AS INT)) WHEN 2 THEN 'env' END"
    ns = [
        nodes(read(spark, d, "orders"), "concat('V:', o_orderkey)", "'VARIABLE'", "concat('v', o_orderkey)", "concat('src/', o_custkey, '.js')"),
        nodes(lines, expression, "'EXPRESSION'", "'sum'"),
        nodes(lines.selectExpr("CAST(l_quantity AS INT) AS q").distinct(), "concat('L:', q)", "'LITERAL'", "'q'", meta="struct(q AS value)"),
        nodes(read(spark, d, "part"), "concat('P:', p_partkey)", "'PARAMETER'", "p_name"),
        nodes(spark.range(1), "'env'", "'EXPRESSION'", "'process.env.HOME'"),
    ]
    es = [edges(lines, "concat('V:', l_orderkey)", expression, "'ASSIGNED_FROM'"), edges(lines.where("l_linenumber % 4 <> 3"), expression, source, "'DERIVES_FROM'")]
    return graph(spark, ns, es)


_VALUES = """WITH l AS (SELECT l_orderkey AS o, l_linenumber % 4 AS k, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
t AS (SELECT DISTINCT 'V:' || o AS origin, CASE k WHEN 0 THEN 'P:' || p WHEN 1 THEN 'L:' || q WHEN 2 THEN 'env' ELSE 'E:' || o || ':' || n END AS id, CASE WHEN k = 1 THEN CAST(q AS VARCHAR) END AS value,
k <> 1 AS unknown, CASE k WHEN 0 THEN 'parameter' WHEN 2 THEN 'nondeterministic' WHEN 3 THEN 'no_sources' END AS reason FROM l) """


@query(_VALUES + "SELECT * FROM t WHERE origin IN ('V:1', 'V:2', 'V:3', 'V:7')")
def trace_values(spark, d):
    return C.trace_values(values(spark, d), ["V:1", "V:2", "V:3", "V:7"])


@query(_VALUES + "SELECT origin, CASE WHEN count(value) = 0 THEN [] ELSE list_sort(list(DISTINCT value) FILTER (value IS NOT NULL)) END AS values, bool_or(unknown) AS has_unknown FROM t WHERE origin IN ('V:1', 'V:2', 'V:3', 'V:7') GROUP BY origin")
def value_sets(spark, d):
    return C.value_set(C.trace_values(values(spark, d), ["V:1", "V:2", "V:3", "V:7"]))


@query(_VALUES + "SELECT 'V:1' AS id, 0 AS depth, 'backward' AS direction UNION ALL SELECT 'E:' || o || ':' || n, 1, 'backward' FROM l WHERE o = 1 UNION SELECT id, 2, 'backward' FROM t WHERE origin = 'V:1' AND id NOT LIKE 'E:%'")
def trace_dataflow(spark, d):
    return C.trace_dataflow(values(spark, d), "V:1")


@query(_VALUES + ", f AS (SELECT o, n, k, p, q FROM (SELECT *, row_number() OVER (ORDER BY 'E:' || o || ':' || n) AS rn FROM l WHERE o = 7) WHERE rn <= 2), s AS (SELECT DISTINCT CASE k WHEN 0 THEN 'P:' || p WHEN 1 THEN 'L:' || q ELSE 'env' END AS id, CASE k WHEN 0 THEN 'user-input' WHEN 1 THEN 'literal' ELSE 'config' END AS source FROM f WHERE k <> 3) "
       "SELECT 'V:7' AS id, 0 AS depth, CAST(NULL AS VARCHAR) AS source UNION ALL SELECT 'E:' || o || ':' || n, 1, CASE WHEN k = 3 THEN 'unknown' END FROM f UNION ALL SELECT id, 2, source FROM s")  # fmt: skip
def simple_trace(spark, d):
    return C.simple_trace(values(spark, d), "V:7", fan=2)


@query("WITH o AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), s AS (SELECT * FROM o WHERE event_id = 33) SELECT 'EVENT:33' AS origin, 'EVENT:' || o.event_id AS node, CAST(o.k - s.k AS INTEGER) AS depth FROM s JOIN o USING (user_id) WHERE o.k >= s.k AND o.k - s.k <= 20")
def trace_alias(spark, d):
    from .sources.relational import relational_graph

    g = relational_graph(spark, d, ("REGION",), ("NEXT_EVENT",))
    return C.trace_alias(Graph(g.nodes, g.edges.withColumn("edge_type", F.lit("ASSIGNED_FROM"))), ["EVENT:33"]).where("not cycle").select("origin", "node", "depth")


@query("SELECT 'C:' || o_orderkey AS origin, 'S:' || c_custkey AS id, 1 AS depth, c_mktsegment AS condition FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (1, 2, 3, 7) AND c_mktsegment <> 'BUILDING' UNION ALL SELECT 'C:' || o_orderkey, 'N:' || c_nationkey, 2, 'nation' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (1, 2, 3, 7)")
def find_guards(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    ns = [nodes(c, "concat('S:', c_custkey)", "'SCOPE'", meta="struct(c_mktsegment <> 'BUILDING' AS conditional, c_mktsegment AS condition)"), nodes(read(spark, d, "nation"), "concat('N:', n_nationkey)", "'SCOPE'", meta="struct(true AS conditional, 'nation' AS condition)")]
    es = [edges(o, "concat('S:', o_custkey)", "concat('C:', o_orderkey)", "'CONTAINS'"), edges(c, "concat('N:', c_nationkey)", "concat('S:', c_custkey)", "'HAS_SCOPE'")]
    return C.find_guards(graph(spark, ns, es), ["C:1", "C:2", "C:3", "C:7"])


# --- impact ---------------------------------------------------------------------------------------------------------

_IMPACT = _CODE + ", hops AS (SELECT DISTINCT c_custkey AS k FROM r), up AS (SELECT k, 20 - k AS depth FROM hops h WHERE k BETWEEN 10 AND 19 AND (SELECT count(*) FROM hops x WHERE x.k BETWEEN h.k AND 19) = 20 - h.k) "


@query(_IMPACT + "SELECT 'F:' || k AS id, depth, depth = 1 AS direct FROM up")
def impact_callers(spark, d):
    return C.impact(code(spark, d), "F:20")[0].select("id", "depth", "direct")


@query(_IMPACT + "SELECT file, count(*) AS n FROM up JOIN p ON c_custkey = k GROUP BY file")
def impact_modules(spark, d):
    return C.impact(code(spark, d), "F:20")[1]


_BLAST = """WITH u AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), one AS (SELECT s FROM u WHERE p = 11), two AS (SELECT DISTINCT u.p FROM u JOIN one USING (s) WHERE u.p <> 11) """


@query(_BLAST + "SELECT 'S:' || s AS id, 1 AS depth, 'P:11' AS via FROM one UNION ALL SELECT 'P:' || p, 2, min('S:' || s) FROM u JOIN one USING (s) WHERE p <> 11 GROUP BY p")
def blast_radius(spark, d):
    used = read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    es = [edges(used, "concat('S:', l_suppkey)", "concat('P:', l_partkey)", "'DEPENDS_ON'"), edges(used, "concat('P:', l_partkey)", "concat('S:', l_suppkey)", "'USES'")]
    return C.blast_radius(graph(spark, [], es), "P:11", 2, 100_000)[0]


@query(_BLAST + "SELECT (SELECT count(*) FROM one) AS direct, (SELECT count(*) FROM two) AS indirect, 3 * (SELECT count(*) FROM one) + (SELECT count(*) FROM two) AS score")
def blast_radius_score(spark, d):
    used = read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    es = [edges(used, "concat('S:', l_suppkey)", "concat('P:', l_partkey)", "'DEPENDS_ON'"), edges(used, "concat('P:', l_partkey)", "concat('S:', l_suppkey)", "'USES'")]
    found = C.blast_radius(graph(spark, [], es), "P:11", 2, 10)[1]
    return spark.createDataFrame([(found["direct"], found["indirect"], found["score"])], "direct long, indirect long, score long")


# --- resolvers ------------------------------------------------------------------------------------------------------


@query(_CODE + "SELECT 'C:' || o_orderkey AS src, 'F:' || (c.c_custkey + 1) AS dst FROM c JOIN customer t ON t.c_custkey = c.c_custkey + 1 WHERE t.c_nationkey = c.c_nationkey")
def same_file_calls(spark, d):
    return resolve.same_file_calls(code(spark, d)).select("src", "dst")


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
SELECT 'I:' || s || ':' || p AS src, 'M:' || p AS dst, 'IMPORTS_FROM' AS edge_type FROM s""")
def import_paths(spark, d):
    """Suppliers import parts by relative paths with and without suffix."""
    return resolve.import_edges(_imports(spark, d)).select("src", "dst", "edge_type")


def _imports(spark, d) -> Graph:
    used = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    bound = "concat('I:', l_suppkey, ':', l_partkey)"
    here = "concat('src/sup/', l_suppkey, '.js')"
    source = "concat('../parts/', l_partkey, CASE WHEN l_partkey % 3 = 0 THEN '.ts' ELSE '' END)"
    part = read(spark, d, "part")
    ns = [
        nodes(used, bound, "'IMPORT_BINDING'", "concat('p', l_partkey)", here, f"struct({source} AS source, CASE WHEN l_partkey % 2 = 0 THEN '*' ELSE 'make' END AS importedName)"),
        nodes(used, "concat('C:', l_suppkey, ':', l_partkey)", "'CALL'", "concat('p', l_partkey, CASE WHEN l_partkey % 2 = 0 THEN '.make' ELSE '' END)", here),
        nodes(part, "concat('M:', p_partkey)", "'MODULE'", "p_name", "concat('src/parts/', p_partkey, '.ts')"),
        nodes(part, "concat('X:', p_partkey)", "'FUNCTION'", "'make'", "concat('src/parts/', p_partkey, '.ts')", exported="true"),
    ]
    return graph(spark, ns)


@query("SELECT DISTINCT 'C:' || l_suppkey || ':' || l_partkey AS src, 'X:' || l_partkey AS dst FROM lineitem")
def cross_file_calls(spark, d):
    return resolve.cross_file_calls(_imports(spark, d)).select("src", "dst")


@query("SELECT 'I:' || c_custkey AS src, 'K:' || n_nationkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey")
def import_dotted(spark, d):
    n = read(spark, d, "nation")
    return resolve.import_edges(graph(spark, [nodes(people(spark, d), "concat('I:', c_custkey)", "'IMPORT'", "concat('geo.r', n_regionkey, '.', n_name)", "'a.py'"), nodes(n, "concat('K:', n_nationkey)", "'CLASS'", "n_name", "'g.py'", "struct(concat('geo.r', n_regionkey) AS package)")]), "dotted").select("src", "dst")


@query("SELECT 'I:' || c_custkey AS src, 'M:' || c_nationkey AS dst FROM customer")
def import_crate(spark, d):
    n = read(spark, d, "nation")
    return resolve.import_edges(graph(spark, [nodes(read(spark, d, "customer"), "concat('I:', c_custkey)", "'IMPORT'", "concat('crate::geo::n', c_nationkey)", "'src/a.rs'"), nodes(n, "concat('M:', n_nationkey)", "'MODULE'", "n_name", "concat('src/geo/n', n_nationkey, '.rs')")]), "crate").select("src", "dst")


@query("SELECT 'I:' || c_custkey AS src, (SELECT min('M:' || n_nationkey) FROM nation x WHERE x.n_regionkey = nation.n_regionkey) AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey")
def import_go(spark, d):
    n = read(spark, d, "nation")
    return resolve.import_edges(graph(spark, [nodes(people(spark, d), "concat('I:', c_custkey)", "'IMPORT'", "concat('x.org/m/geo/', n_regionkey)", "'a.go'"), nodes(n, "concat('M:', n_nationkey)", "'MODULE'", "n_name", "concat('geo/', n_regionkey, '/n', n_nationkey, '.go')")]), "go", "x.org/m").select("src", "dst")


@query("SELECT 'I:' || c_custkey AS src, 'K:' || n_nationkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey")
def import_namespace(spark, d):
    n = read(spark, d, "nation")
    return resolve.import_edges(graph(spark, [nodes(people(spark, d), "concat('I:', c_custkey)", "'IMPORT'", r"concat('\\Geo\\R', n_regionkey, '\\', n_name)", "'a.php'"), nodes(n, "concat('K:', n_nationkey)", "'CLASS'", "n_name", "'g.php'", "struct(concat('Geo/R', n_regionkey) AS namespace)")]), "namespace").select("src", "dst")


@query("SELECT 'I:' || c_custkey AS src, 'M:' || n_nationkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey")
def import_by_name(spark, d):
    n = read(spark, d, "nation")
    return resolve.import_edges(graph(spark, [nodes(people(spark, d), "concat('I:', c_custkey)", "'IMPORT'", "n_name", "'A.hs'"), nodes(n, "concat('M:', n_nationkey)", "'MODULE'", "n_name", "'g.hs'")]), "name").select("src", "dst")


@query("SELECT 'I:' || c_custkey AS src, CASE WHEN c_custkey % 2 = 0 THEN 'own:' ELSE 'lib:' END || c_nationkey AS dst FROM customer")
def include_edges(spark, d):
    n, c = read(spark, d, "nation"), read(spark, d, "customer")
    ns = [nodes(c, "concat('I:', c_custkey)", "'INCLUDE'", "concat('h', c_nationkey, '.h')", "CASE WHEN c_custkey % 2 = 0 THEN 'src/a.cpp' ELSE 'far/a.cpp' END"), nodes(n, "concat('own:', n_nationkey)", "'MODULE'", file="concat('src/h', n_nationkey, '.h')"), nodes(n, "concat('lib:', n_nationkey)", "'MODULE'", file="concat('include/h', n_nationkey, '.h')")]
    return resolve.include_edges(graph(spark, ns), ["none", "include"]).select("src", "dst")


@query("SELECT 'R:' || o_orderkey AS src, 'V:' || o_custkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'")
def local_references(spark, d):
    """Names of builders' files are imported and left alone."""
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    here = "concat('src/', {}, '.js')"
    ns = [nodes(o, "concat('R:', o_orderkey)", "'REFERENCE'", "concat('v', o_custkey)", here.format("o_custkey")), nodes(c, "concat('V:', c_custkey)", "'VARIABLE'", "concat('v', c_custkey)", here.format("c_custkey")), nodes(c.where("c_mktsegment = 'BUILDING'"), "concat('B:', c_custkey)", "'IMPORT_BINDING'", "concat('v', c_custkey)", here.format("c_custkey"))]
    return resolve.local_references(graph(spark, ns), ["console"]).select("src", "dst")


@query("SELECT 'E:' || event_id AS src, 'BUILTIN:' || event_type AS dst FROM events WHERE event_type IN ('click', 'view')")
def builtin_references(spark, d):
    g = graph(spark, [nodes(read(spark, d, "events"), "concat('E:', event_id)", "'REFERENCE'", "concat(event_type, '.on')")])
    return resolve.table_references(g, ["click", "view", "other"], "BUILTIN").edges.select("src", "dst")


@query("SELECT DISTINCT 'A:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey AS src, CASE WHEN l_linenumber % 2 = 0 THEN 'own:' ELSE 'static:' END || l_partkey AS dst FROM lineitem")
def property_access(spark, d):
    """Class.p from the class's file, of two properties a class."""
    lines, part = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct(), read(spark, d, "part")
    ns = [
        nodes(lines.where("l_linenumber % 2 = 0"), "concat('A:', l_orderkey, ':', l_linenumber, ':', l_partkey)", "'PROPERTY_ACCESS'", "concat('K', l_partkey, '.size')", "concat(l_partkey, '.js')"),
        nodes(lines.where("l_linenumber % 2 = 1"), "concat('A:', l_orderkey, ':', l_linenumber, ':', l_partkey)", "'PROPERTY_ACCESS'", "concat('K', l_partkey, '.kind')", "concat(l_partkey, '.js')"),
        nodes(part, "concat('own:', p_partkey)", "'PROPERTY'", "'size'", "concat(p_partkey, '.js')", "struct(concat('K', p_partkey) AS className)"),
        nodes(part, "concat('static:', p_partkey)", "'PROPERTY'", "'kind'", "concat(p_partkey, '.js')", "struct(concat('K', p_partkey) AS className)"),
    ]
    return resolve.property_access(graph(spark, ns)).select("src", "dst")


@query("SELECT 'N:' || o_orderkey AS src, 'K:' || o_custkey AS dst, 'INSTANTIATES' AS edge_type FROM orders UNION ALL SELECT 'C:' || o_orderkey, 'm:' || CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 1000000 + c_nationkey END, 'CALLS' FROM orders JOIN customer ON o_custkey = c_custkey")
def typed_calls(spark, d):
    """Classes extend their nation's; even ones have the method themselves, the others inherit it."""
    c, o, n = read(spark, d, "customer"), read(spark, d, "orders"), read(spark, d, "nation")
    ns = [
        nodes(o, "concat('N:', o_orderkey)", "'CONSTRUCTOR_CALL'", "concat('new K', o_custkey)", "'a.java'"),
        nodes(o, "concat('C:', o_orderkey)", "'CALL'", "'x.run'", "'a.java'", "struct(concat('K', o_custkey) AS receiverType)"),
        nodes(c, "concat('K:', c_custkey)", "'CLASS'", "concat('K', c_custkey)", "'b.java'"),
        nodes(n, "concat('B:', n_nationkey)", "'CLASS'", "concat('Base', n_nationkey)", "'c.java'"),
        nodes(c.where("c_custkey % 2 = 0"), "concat('m:', c_custkey)", "'METHOD'", "'run'", "'b.java'", "struct(concat('K', c_custkey) AS className)"),
        nodes(n, "concat('m:', 1000000 + n_nationkey)", "'METHOD'", "'run'", "'c.java'", "struct(concat('Base', n_nationkey) AS className)"),
    ]
    return resolve.typed_calls(graph(spark, ns, [edges(c, "concat('K:', c_custkey)", "concat('B:', c_nationkey)", "'EXTENDS'")])).select("src", "dst", "edge_type")


@query("SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, 'EXTENDS' AS edge_type FROM customer UNION ALL SELECT 'c:' || c_custkey, 'r:' || n_regionkey, 'IMPLEMENTS' FROM customer JOIN nation ON c_nationkey = n_nationkey")
def type_edges(spark, d):
    p, n, r = people(spark, d), read(spark, d, "nation"), read(spark, d, "region")
    ns = [nodes(p, "concat('c:', c_custkey)", "'CLASS'", "concat('Own', c_custkey)", "'a/x.ts'", "struct(concat('N', n_nationkey, '<int>, string') AS extends, concat('pkg.R', n_regionkey) AS implements)"), nodes(n, "concat('n:', n_nationkey)", "'CLASS'", "concat('N', n_nationkey)", "'a/y.ts'"), nodes(n, "concat('far:', n_nationkey)", "'CLASS'", "concat('N', n_nationkey)", "'b/z.ts'"), nodes(r, "concat('r:', r_regionkey)", "'INTERFACE'", "concat('R', r_regionkey)", "'b/z.ts'")]
    return resolve.type_edges(graph(spark, ns), ["EXTENDS", "IMPLEMENTS"]).select("src", "dst", "edge_type")


@query("""SELECT 'v:' || o_orderkey AS src, CASE o_orderkey % 4 WHEN 0 THEN 'k:' || n_nationkey WHEN 1 THEN 'k:' || n_nationkey WHEN 2 THEN 'g:' || n_regionkey ELSE 'k:' || n_nationkey END AS dst, 'TYPE_OF' AS edge_type
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'run[in:N' || n_nationkey || ']', 'k:' || n_nationkey, 'RETURNS' FROM nation""")
def type_hints(spark, d):
    """Hints that are whole names, of the namespace, imported, and self in a function of the class."""
    o, n, r = calls(spark, d), read(spark, d, "nation"), read(spark, d, "region")
    hint = r"CASE o_orderkey % 4 WHEN 0 THEN concat('?Geo\\N', n_nationkey) WHEN 1 THEN concat('null|N', n_nationkey) WHEN 2 THEN 'Far' ELSE 'static' END"
    here = "concat('src/', n_nationkey, '.php')"
    ns = [
        nodes(o, "concat('v:', o_orderkey)", "'VARIABLE'", "'v'", here, f"struct({hint} AS type)").withColumn("id", F.when(F.substring_index("id", ":", -1).cast("long") % 4 == 3, F.concat("id", F.lit("[in:run]"))).otherwise(F.col("id"))),
        nodes(n, "concat('M:', n_nationkey)", "'MODULE'", "n_name", here, "struct('Geo' AS namespace)"),
        nodes(n, "concat('k:', n_nationkey)", "'CLASS'", "concat('N', n_nationkey)", here),
        nodes(n, "concat('run[in:N', n_nationkey, ']')", "'FUNCTION'", "'run'", here, "struct('self' AS return_type)"),
        nodes(n, "concat('I:', n_nationkey)", "'IMPORT_BINDING'", "'Far'", here, r"struct(concat('Region\\R', n_regionkey) AS source)"),
        nodes(r, "concat('M:r', r_regionkey)", "'MODULE'", "r_name", "concat('r', r_regionkey, '.php')", "struct('Region' AS namespace)"),
        nodes(r, "concat('g:', r_regionkey)", "'CLASS'", "concat('R', r_regionkey)", "concat('r', r_regionkey, '.php')"),
    ]
    found = resolve.hinted_types(graph(spark, ns))
    return found.select(F.regexp_replace("src", r"^(v:\d+)\[.*", "$1").alias("src"), "dst", "edge_type")


@query("SELECT 'c:' || c_custkey AS src, 's:' || s_suppkey AS dst FROM customer JOIN supplier ON c_custkey = s_suppkey")
def bridges(spark, d):
    ns = [nodes(read(spark, d, "customer"), "concat('c:', c_custkey)", "'CLASS'", "concat('K', c_custkey)", "'a.kt'", "struct('kotlin' AS language)"), nodes(read(spark, d, "supplier"), "concat('s:', s_suppkey)", "'CLASS'", "concat('K', s_suppkey)", "'b.java'", "struct('java' AS language)")]
    return resolve.bridges(graph(spark, ns), "kotlin", "java").select("src", "dst")


@query("SELECT 'A:' || o_orderkey AS src, 'T:' || o_orderpriority AS dst FROM orders")
def annotation_edges(spark, d):
    o = read(spark, d, "orders")
    ns = [nodes(o, "concat('A:', o_orderkey)", "'ANNOTATION'", "concat('@org.', regexp_replace(o_orderpriority, '[^A-Z0-9]', ''))"), nodes(o.select("o_orderpriority").distinct(), "concat('T:', o_orderpriority)", "'ANNOTATION_TYPE'", "regexp_replace(o_orderpriority, '[^A-Z0-9]', '')")]
    return resolve.annotation_edges(graph(spark, ns)).select("src", "dst")


@query("SELECT 'U:' || o_orderkey AS src, 'P:' || o_custkey AS dst, 'INSTANTIATES_TEMPLATE' AS edge_type FROM orders UNION ALL SELECT 'S:' || c_custkey, 'P:' || c_custkey, 'SPECIALIZES' FROM customer WHERE c_mktsegment = 'BUILDING'")
def template_edges(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    ns = [nodes(o, "concat('U:', o_orderkey)", "'TEMPLATE_USE'", "concat('T', o_custkey, ' <int>')"), nodes(c, "concat('P:', c_custkey)", "'TEMPLATE'", "concat('T', c_custkey)"), nodes(c.where("c_mktsegment = 'BUILDING'"), "concat('S:', c_custkey)", "'TEMPLATE'", "'special'", meta="struct(concat('T', c_custkey) AS primary_template)")]
    return resolve.template_edges(graph(spark, ns)).select("src", "dst", "edge_type")


@query("SELECT 'E:' || o_orderkey AS src, CASE WHEN c_mktsegment = 'BUILDING' THEN 'm:' || c_custkey ELSE 'free' END AS dst FROM orders JOIN customer ON o_custkey = c_custkey")
def operator_calls(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    ns = [nodes(o, "concat('E:', o_orderkey)", "'OPERATOR_CALL'", meta="struct('+' AS operator, concat('K', o_custkey) AS left_type)"), nodes(c.where("c_mktsegment = 'BUILDING'"), "concat('m:', c_custkey)", "'METHOD'", "'operator+'", meta="struct(concat('K', c_custkey) AS className)"), nodes(spark.range(1), "'free'", "'FUNCTION'", "'operator+'")]
    return resolve.operator_calls(graph(spark, ns)).select("src", "dst")


@query("SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst FROM customer UNION ALL SELECT 's:' || s_suppkey, 'p:' || s_nationkey FROM supplier")
def behaviours(spark, d):
    n = read(spark, d, "nation")
    ns = [nodes(read(spark, d, "customer"), "concat('c:', c_custkey)", "'MODULE'", "concat('Cust', c_custkey)", meta="struct(concat('Behave', c_nationkey) AS behaviour)"), nodes(n, "concat('n:', n_nationkey)", "'MODULE'", "concat('Behave', n_nationkey)"), nodes(read(spark, d, "supplier"), "concat('s:', s_suppkey)", "'MODULE'", "concat('Proto', s_nationkey, '.Sup', s_suppkey)"), nodes(n, "concat('p:', n_nationkey)", "'PROTOCOL'", "concat('Proto', n_nationkey)")]
    return resolve.behaviours(graph(spark, ns)).select("src", "dst")


@query("SELECT 'm:' || c_custkey AS src, 'b:' || c_nationkey AS dst, 'OVERRIDES' AS edge_type FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT DISTINCT 'C:' || s_suppkey, 'm:' || c_custkey, 'DISPATCHES_TO' FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE c_mktsegment = 'BUILDING'")
def virtual_dispatch(spark, d):
    c, n, s = read(spark, d, "customer"), read(spark, d, "nation"), read(spark, d, "supplier")
    own = c.where("c_mktsegment = 'BUILDING'")
    ns = [nodes(c, "concat('K:', c_custkey)", "'CLASS'"), nodes(n, "concat('N:', n_nationkey)", "'CLASS'"), nodes(own, "concat('m:', c_custkey)", "'METHOD'", "'run'"), nodes(n, "concat('b:', n_nationkey)", "'METHOD'", "'run'")]
    es = [edges(c, "concat('K:', c_custkey)", "concat('N:', c_nationkey)", "'EXTENDS'"), edges(own, "concat('K:', c_custkey)", "concat('m:', c_custkey)", "'HAS_METHOD'"), edges(n, "concat('N:', n_nationkey)", "concat('b:', n_nationkey)", "'HAS_METHOD'"), edges(s, "concat('C:', s_suppkey)", "concat('b:', s_nationkey)", "'CALLS'")]
    return resolve.virtual_dispatch(graph(spark, ns, es)).select("src", "dst", "edge_type")


@query("SELECT 'f:' || o_custkey AS src, 'g:' || o_orderkey AS dst, CASE o_orderstatus WHEN 'F' THEN 'SPAWNS_WITH_CONTEXT' WHEN 'P' THEN 'DEFERS_WITH_CONTEXT' ELSE 'PROPAGATES_CONTEXT' END AS edge_type FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'")
def context_propagation(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    ns = [nodes(c, "concat('f:', c_custkey)", "'FUNCTION'", meta="struct(CASE WHEN c_mktsegment <> 'BUILDING' THEN 'ctx context.Context' ELSE 'x int' END AS params)"), nodes(o, "concat('g:', o_orderkey)", "'FUNCTION'", meta="struct(true AS acceptsContext)")]
    es = [edges(o, "concat('f:', o_custkey)", "concat('g:', o_orderkey)", "'CALLS'", "struct(CASE o_orderstatus WHEN 'F' THEN 'go' WHEN 'P' THEN 'defer' END AS mode)")]
    return resolve.context_propagation(graph(spark, ns, es)).select("src", "dst", "edge_type")


@query("SELECT 'Q:' || event_id AS src, 'R:' || user_id AS dst, 'INTERACTS_WITH' AS edge_type FROM events UNION ALL SELECT 'Q:' || event_id, 'O:' || user_id, 'HTTP_RECEIVES' FROM events")
def http_edges(spark, d):
    e = read(spark, d, "events")
    u = e.select("user_id").distinct()
    ns = [nodes(e, "concat('Q:', event_id)", "'http:request'", "concat('https://h/u/', user_id, '/', event_id)", meta="struct('get' AS method)"), nodes(u, "concat('R:', user_id)", "'http:route'", "concat('/u/', user_id, '/:id')", meta="struct('GET' AS method)")]
    return resolve.http_edges(graph(spark, ns, [edges(u, "concat('R:', user_id)", "concat('O:', user_id)", "'RESPONDS_WITH'")])).select("src", "dst", "edge_type")


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), w AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), n AS (SELECT o, count(*) AS size FROM w GROUP BY o)
SELECT 's:' || s AS src, 'i:' || o AS dst FROM s JOIN w USING (p) JOIN n USING (o) GROUP BY s, o, size HAVING count(*) = size""")
def implements_by_structure(spark, d):
    line = read(spark, d, "lineitem")
    s, o = line.select("l_suppkey", "l_partkey").distinct(), line.select("l_orderkey", "l_partkey").distinct()
    ns = [nodes(s.select("l_suppkey").distinct(), "concat('s:', l_suppkey)", "'STRUCT'"), nodes(o.select("l_orderkey").distinct(), "concat('i:', l_orderkey)", "'INTERFACE'"), nodes(read(spark, d, "part"), "concat('m:', p_partkey)", "'METHOD'", "concat('do', p_partkey)")]
    return resolve.implements_by_structure(graph(spark, ns, [edges(s, "concat('s:', l_suppkey)", "concat('m:', l_partkey)", "'HAS_METHOD'"), edges(o, "concat('i:', l_orderkey)", "concat('m:', l_partkey)", "'DECLARES'")])).select("src", "dst")


# --- rules ----------------------------------------------------------------------------------------------------------


@query("SELECT 'C:' || o_orderkey AS X, 'F:' || o_custkey AS F FROM orders JOIN customer ON o_custkey = c_custkey")
def parent_function(spark, d):
    """The function around every call: both terms free."""
    return Datalog(code(spark, d)).query('node(X, "CALL"), parent_function(X, F)').select("X", "F")


@query(_CODE + "SELECT 'F:' || c_custkey AS X, 'M:' || n_nationkey AS M FROM p WHERE starts_with(file, 'src/1/') AND NOT contains(file, '3.js')")
def datalog_text_tests(spark, d):
    return Datalog(code(spark, d)).query('node(X, "FUNCTION"), attr(X, "file", P), starts_with(P, "src/1/"), \\+ string_contains(P, "3.js"), incoming(X, M, "CONTAINS")').select("X", "M")


@query(_CODE + "SELECT 'g' AS src, 'M:' || n_nationkey AS dst FROM nation WHERE n_regionkey = 2")
def governs_edges(spark, d):
    return guarantees.governs_edges(code(spark, d), [guarantees.Guarantee("g", "g", 'violation(X) :- node(X, "NONE").', governs=("src/2/*.js",))]).select("src", "dst")


@query("SELECT 'g' AS guarantee WHERE (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7) < 9")
def affected_guarantees(spark, d):
    g = code(spark, d)
    rule = guarantees.Guarantee("g", "g", 'violation(X) :- node(X, "NONE").', governs=("src/**",))
    return guarantees.affected_guarantees(Graph(g.nodes, g.edges.unionByName(guarantees.governs_edges(g, [rule]))), "F:7")


@query("SELECT 'r' || n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'only_in_graph' WHEN n_nationkey % 5 = 1 THEN 'only_in_file' WHEN n_nationkey % 5 = 2 THEN 'modified' ELSE 'unchanged' END AS state FROM nation")
def rule_drift(spark, d):
    n = read(spark, d, "nation")
    a = n.where("n_nationkey % 5 <> 1").selectExpr("concat('r', n_nationkey) AS id", "n_name AS rule", "'error' AS severity")
    b = n.where("n_nationkey % 5 <> 0").selectExpr("concat('r', n_nationkey) AS id", "n_name AS rule", "CASE WHEN n_nationkey % 5 = 2 THEN 'warning' ELSE 'error' END AS severity")
    return guarantees.drift(a, b)


@query("SELECT 'g' || n_regionkey AS guarantee, 'c:' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 AND c_mktsegment = 'BUILDING'")
def contract_violations(spark, d):
    rules = read(spark, d, "region").selectExpr("concat('g', r_regionkey) AS id", "CASE WHEN r_regionkey = 2 THEN 'draft' ELSE 'active' END AS status")
    governed = people(spark, d).selectExpr("concat('g', n_regionkey) AS guarantee", "concat('c:', c_custkey) AS id", "CASE WHEN c_mktsegment = 'BUILDING' THEN '{\"a\":1}' ELSE '{\"a\":1,\"owner\":2}' END AS metadata")
    return knowledge.contract_violations(rules, governed, ["a", "owner"]).select("guarantee", "id")


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'imports' ELSE 'calls' END AS category, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1")
def issues_by_category(spark, d):
    issues = read(spark, d, "events").selectExpr("CASE event_type WHEN 'click' THEN 'ERR_BROKEN_IMPORT' WHEN 'view' THEN 'ERR_UNDEFINED_SYMBOL' WHEN 'signup' THEN 'OTHER' ELSE 'ERR_UNRESOLVED_CALL' END AS code")
    count = lambda c: guarantees.issues_of(issues, c).groupBy(F.lit(c).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return count("imports").union(count("calls"))


# --- files, versions, commits ----------------------------------------------------------------------------------------


@query("SELECT 'd' || doc_id AS path, CASE WHEN lang = 'en' THEN 'same' WHEN lang = 'de' THEN 'changed' WHEN lang = 'fr' THEN 'deleted' ELSE 'new' END AS state FROM documents")
def changed_files(spark, d):
    docs = read(spark, d, "documents").selectExpr("concat('d', doc_id) AS path", "lang")
    return store.changed_files(docs.where("lang <> 'fr'").selectExpr("path", "CASE WHEN lang = 'de' THEN 9L ELSE 5L END AS mtime"), docs.where("lang IN ('en', 'de', 'fr')").selectExpr("path", "5L AS mtime"))


@query("SELECT 'd' || doc_id AS file, CASE WHEN lang = 'fr' THEN 'deleted' WHEN text IS NULL OR lang = 'es' THEN 'unreadable' WHEN lang = 'de' THEN 'stale' ELSE 'fresh' END AS state FROM documents")
def freshness(spark, d):
    docs = read(spark, d, "documents").selectExpr("concat('d', doc_id) AS file", "lang", "text")
    modules = docs.selectExpr("file", "CASE WHEN lang = 'de' THEN 'x' ELSE sha2(coalesce(text, ''), 256) END AS content_hash")
    return store.freshness(modules, docs.where("lang <> 'fr'").selectExpr("file", "CASE WHEN lang <> 'es' THEN text END AS content"))


@query("SELECT 'REPLACES' AS edge_type, 'local:' || p_partkey AS src, 'main:' || p_partkey AS dst FROM part WHERE p_partkey % 5 = 0")
def replaces_edges(spark, d):
    part = read(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS k", "p_size")
    local = part.withColumn("p_size", F.when(F.col("k").cast("long") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return store.replaces_edges(store.classify_versions(part, local, "k", ["p_size"]), "k").select("src", "dst", "edge_type")


@query("SELECT 'CUSTOMER:' || o_custkey AS src, 'ORDER:' || o_orderkey AS dst, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS metadata FROM orders")
def upsert_edges(spark, d):
    o = read(spark, d, "orders").selectExpr("concat('CUSTOMER:', o_custkey) AS src", "concat('ORDER:', o_orderkey) AS dst", "'PLACED' AS edge_type", "'old' AS metadata", "o_orderstatus")
    new = o.where("o_orderstatus = 'F'").withColumn("metadata", F.lit("new"))
    return store.upsert(o.drop("o_orderstatus"), new.drop("o_orderstatus"), store.EDGE_KEY).select("src", "dst", "metadata")


@query("SELECT 'CUSTOMER:' || o_custkey AS src, 'ORDER:' || o_orderkey AS dst FROM orders WHERE o_orderstatus <> 'F'")
def delete_edges(spark, d):
    o = read(spark, d, "orders").selectExpr("concat('CUSTOMER:', o_custkey) AS src", "concat('ORDER:', o_orderkey) AS dst", "'PLACED' AS edge_type", "o_orderstatus")
    return store.without(o, o.where("o_orderstatus = 'F'"), store.EDGE_KEY).select("src", "dst")


@query("SELECT 'f:' || c_custkey AS id, 'third' AS name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'f:' || c_custkey, 'first' FROM customer WHERE c_mktsegment <> 'BUILDING'")
def commit_batch_ordered(spark, d):
    """Three commits of one file a segment in a batch: of a file's commits the last counts."""
    c = read(spark, d, "customer")
    make = lambda df, name: nodes(df, "concat('f:', c_custkey)", "'FUNCTION'", f"'{name}'", "concat('src/', c_mktsegment)")
    empty = spark.createDataFrame([], EDGE_SCHEMA)
    segments = [r[0] for r in c.select("c_mktsegment").distinct().collect()]
    built = c.where("c_mktsegment = 'BUILDING'")
    files = [f"src/{s}" for s in segments]
    f, n, e, kept = store.in_order([(files, make(c, "first"), empty, []), (["src/BUILDING"], make(built, "zz second"), empty, []), (["src/BUILDING"], make(built, "third"), empty, [])])
    return store.commit_batch(graph(spark, [make(c, "old")]), f, n, e, kept, "seq").graph.nodes.select("id", "name")


@query("SELECT 'f:' || c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_custkey % 2 = 0")
def commit_protected(spark, d):
    """A commit of the builders' file leaves its protected nodes."""
    g = graph(spark, [nodes(read(spark, d, "customer"), "concat('f:', c_custkey)", "CASE WHEN c_custkey % 2 = 0 THEN 'ENRICHED' ELSE 'FUNCTION' END", file="concat('src/', c_mktsegment)")])
    return store.commit_batch(g, ["src/BUILDING"], g.nodes.limit(0), g.edges, ["ENRICHED"]).graph.nodes.select("id")


@query("SELECT 1 + n AS version, n % 3 AS deltas, (SELECT count(*) FROM customer) AS nodes FROM range(5) t(n)")
def compaction_policy(spark, d):
    """Commits of one file a time as deltas; every third folds them into a new base."""
    from .scratch import scratch_path

    g = graph(spark, [nodes(read(spark, d, "customer"), "concat('f:', c_custkey)", "'FUNCTION'", file="concat('src/', c_mktsegment)")])
    db = store.Store(spark, scratch_path(spark, "store"), compact_at=3)
    db.write("g", g)
    for s in ("BUILDING", "AUTOMOBILE", "MACHINERY", "FURNITURE"):
        db.commit("g", [f"src/{s}"], g.nodes.where(F.col("file") == f"src/{s}"), g.edges)
    found = [(m["version"], len(m["deltas"]), db.read("g", m["version"]).nodes.count()) for m in db.snapshots("g")]
    return spark.createDataFrame(found, "version int, deltas int, nodes long")


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '__enrichment__/e/src/' || c_mktsegment END AS owner, count(*) AS n FROM customer GROUP BY 1")
def enrichment_owners(spark, d):
    e = edges(read(spark, d, "customer"), "concat('a', c_custkey)", "'b'", "'X'", "CASE WHEN c_custkey % 3 <> 0 THEN named_struct('__file_context', concat('__enrichment__/e/src/', c_mktsegment)) END")
    return e.groupBy(store.edge_owner(F.col("metadata")).alias("owner")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'c' || c_custkey AS id, '3' AS generation, 'enricher' AS source, c_mktsegment AS kept FROM customer")
def generation_stamp(spark, d):
    meta = store.stamped(F.to_json(F.struct(F.col("c_mktsegment").alias("kept"), F.lit("1").alias("_generation"))), 3, "enricher")
    shown = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), meta.alias("m"))
    return shown.selectExpr("id", "get_json_object(m, '$._generation') AS generation", "get_json_object(m, '$._source') AS source", "get_json_object(m, '$.kept') AS kept")


@query("SELECT 'h' || event_id AS hash FROM events WHERE event_type <> 'click'")
def new_commits(spark, d):
    e = read(spark, d, "events").selectExpr("concat('h', event_id) AS hash", "event_type")
    return history.new_commits(e, e.where("event_type = 'click'")).select("hash")


@query("SELECT event_type AS id, max_by('U' || user_id, (event_id)) AS name, count(DISTINCT user_id) AS aliases FROM events GROUP BY event_type")
def normalized_authors(spark, d):
    e = read(spark, d, "events").selectExpr("concat('U', user_id) AS author_name", "CASE WHEN user_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS author_email", "lpad(CAST(event_id AS STRING), 12, '0') AS date")
    return history.normalized_authors(e).select("id", "name", F.size("aliases").alias("aliases"))


# --- notes and primitives --------------------------------------------------------------------------------------------


def notes(spark, d) -> DataFrame:
    """A conversation's turns are notes that refer to the turn before."""
    t = read(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return t.selectExpr("concat(conv_id, ':', turn) AS id", "upper(role) AS kind", "CASE WHEN turn % 3 = 0 THEN 'superseded' ELSE 'active' END AS status", "'text' AS text", "array(concat(conv_id, ':', turn - 1)) AS relates_to")


_NOTES = "WITH t AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2) "


@query(_NOTES + "SELECT upper(role) AS kind, CASE WHEN turn % 3 = 0 THEN 'superseded' ELSE 'active' END AS status, count(*) AS n FROM t GROUP BY 1, 2")
def note_stats(spark, d):
    return knowledge.stats(notes(spark, d))


@query(_NOTES + "SELECT conv_id || ':' || turn AS src, conv_id || ':' || (turn - 1) AS dst FROM t WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.conv_id = t.conv_id AND x.turn = t.turn - 1)")
def dangling_notes(spark, d):
    return knowledge.dangling_references(notes(spark, d), spark.createDataFrame([], "id string"))


@query(_CODE + "SELECT file || ':FUNCTION:fn' || c_custkey AS address, 'F:' || c_custkey AS id FROM p UNION ALL SELECT file || ':CLASS:fn' || c_custkey, NULL FROM p")
def semantic_addresses(spark, d):
    p = people(spark, d)
    asked = p.selectExpr(f"concat({_FILE}, ':FUNCTION:fn', c_custkey) AS address").union(p.selectExpr(f"concat({_FILE}, ':CLASS:fn', c_custkey)"))
    return knowledge.resolve_addresses(asked, code(spark, d))


@query("SELECT node_type AS node_type, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'http:request' WHEN 'view' THEN 'db:query' ELSE 'FUNCTION' END AS node_type FROM events) WHERE node_type <> 'FUNCTION' GROUP BY 1")
def endpoint_nodes(spark, d):
    g = graph(spark, [nodes(read(spark, d, "events"), "concat('E:', event_id)", "CASE event_type WHEN 'click' THEN 'http:request' WHEN 'view' THEN 'db:query' ELSE 'FUNCTION' END")])
    return primitives.endpoints(g).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query(_CODE + "SELECT 'F:' || c_custkey AS id FROM p WHERE c_custkey % 2 = 0")
def exported_functions(spark, d):
    return primitives.find_by_attributes(code(spark, d), "FUNCTION", exported=True).select("id")


@query("SELECT parts AS dir, 'FUNCTION' AS node_type, count(*) AS n FROM (SELECT 'src/' || n_regionkey AS parts FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1")
def nodes_by_directory(spark, d):
    return C.nodes_by_directory(code(spark, d)).where("node_type = 'FUNCTION'")


@query("SELECT CAST(unnest([0, 1, 2, 1000]) AS INTEGER) AS i, unnest([true, true, false, false]) AS found")
def existence_test(spark, d):
    g = code(spark, d)
    known = read(spark, d, "nation").agg(F.min("n_nationkey"), F.max("n_nationkey")).first()
    ids = [f"M:{known[0]}", f"M:{known[1]}", "M:none", "F:-1"]
    return spark.createDataFrame([(i, primitives.node_exists(g, x)) for i, x in zip((0, 1, 2, 1000), ids, strict=True)], "i int, found boolean")


@query("SELECT count(*) AS rows, CAST(ceil(count(*) / 500.0) AS BIGINT) AS chunks FROM customer")
def chunked_scan(spark, d):
    sizes = [len(c) for c in primitives.in_chunks(primitives.find_by_type(code(spark, d), "FUNCTION").select("id"), 500)]
    return spark.createDataFrame([(sum(sizes), len(sizes))], "rows long, chunks long")


@query("WITH RECURSIVE t(k) AS (SELECT 7 UNION SELECT k + 1 FROM t JOIN orders ON o_custkey = k WHERE k < 12) SELECT CAST(count(*) > 5 AS BOOLEAN) AS reached FROM t")
def pair_reachability(spark, d):
    g = code(spark, d)
    moves = Graph(g.nodes, g.edges.where("edge_type IN ('CONTAINS', 'CALLS')"))
    return spark.createDataFrame([(traverse.is_reachable(moves, "F:7", "F:12", ["CONTAINS", "CALLS"], 10),)], "reached boolean")


@query(_CODE + "SELECT 'M:3' AS id, 0 AS depth, 'MODULE' AS node_type UNION ALL SELECT 'F:' || c_custkey, 1, 'FUNCTION' FROM p WHERE c_nationkey = 3 UNION ALL SELECT 'C:' || o_orderkey, 2, 'CALL' FROM c WHERE c_nationkey = 3")
def traverse_checked(spark, d):
    return traverse.traverse(code(spark, d), ["M:3"], 2, types=["CONTAINS"], cap=1_000_000)[0].select("id", "depth", "node_type")


@query(_CODE + "SELECT file, n, row_number() OVER (ORDER BY n DESC, file) AS place FROM (SELECT file, count(*) AS n FROM c GROUP BY file) QUALIFY place <= 5")
def top_files(spark, d):
    from pyspark.sql import Window as W

    counted = primitives.find_by_type(code(spark, d), "CALL").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.desc("n"), "file").limit(5)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "file")))  # five rows


# --- functions, sources, sessions -------------------------------------------------------------------------------------


@query("SELECT event_id, 'q' || event_id AS query, value AS ms FROM events WHERE value >= 10 ORDER BY value DESC, query LIMIT 10")
def slow_queries(spark, d):
    """A log of queries, one an event; the ten slowest are what is asked for."""
    log = read(spark, d, "events").selectExpr("event_id", "concat('q', event_id) AS query", "value AS ms")
    return primitives.slow_queries(log, 10.0)


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'FUNCTION' WHEN 1 THEN 'MODULE' ELSE 'CALL_SITE' END AS kind,
CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'modified' ELSE 'unchanged' END WHEN 1 THEN 'modified' ELSE 'unchanged' END AS change, count(*) AS n FROM part GROUP BY 1, 2""")
def versions_by_type(spark, d):
    """Functions change with their params, modules with their content hash, call sites not with a note."""
    kind = "CASE p_partkey % 3 WHEN 0 THEN 'FUNCTION' WHEN 1 THEN 'MODULE' ELSE 'CALL_SITE' END"
    part = read(spark, d, "part")
    main = nodes(part, "concat('m', p_partkey)", kind, "concat('p', p_partkey)", "'a.js'", "struct(p_partkey AS line, 'x' AS params, 'h' AS contentHash, 'n' AS note)")
    local = nodes(part, "concat('l', p_partkey)", kind, "concat('p', p_partkey)", "'a.js'", "struct(p_partkey AS line, CASE WHEN p_partkey % 2 = 0 THEN 'y' ELSE 'x' END AS params, 'k' AS contentHash, 'other' AS note)")
    found = store.classify_nodes(main, local)
    shown = F.when(F.col("key").startswith("FUNCTION"), "FUNCTION").when(F.col("key").startswith("CALL_SITE"), "CALL_SITE").otherwise("MODULE")
    return found.groupBy(shown.alias("kind"), "change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'd7' AS file, CAST(i AS INTEGER) AS line, l AS text FROM (SELECT unnest(string_split(text, chr(10))) AS l, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id = 7) WHERE i <= 17")
def source_preview(spark, d):
    docs = read(spark, d, "documents").selectExpr("concat('d', doc_id) AS file", "text AS content")
    g = graph(spark, [nodes(read(spark, d, "documents"), "concat('N', doc_id)", "'FUNCTION'", file="concat('d', doc_id)", meta="struct(2 AS line)")])
    return C.source_preview(g, docs, "N7")


@query("SELECT c_name AS name, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(rtrim(regexp_replace(hex(encode(c_name)), '(..)', '\\1 ', 'g')), ' '), lambda h: CAST('0x' || h AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS hash FROM customer")
def name_hashes(spark, d):
    from .functions.identity import fnv1a

    return read(spark, d, "customer").select(F.col("c_name").alias("name"), fnv1a(F.col("c_name")).alias("hash"))


@query("SELECT 'src/' || n_regionkey AS dir, 'geo' AS namespace, n_name AS base, 'K' || n_nationkey AS receiver, 'run' AS method, 'src/' || n_regionkey || '/' || n_nationkey || '.js->FUNCTION->' || n_name AS semantic FROM nation")
def path_and_type_functions(spark, d):
    from .functions import attributes as A

    n = read(spark, d, "nation").selectExpr(f"{_FILE} AS file", "concat('geo:', n_name) AS kind", "concat('K', n_nationkey, '.run') AS call", "n_name")
    return n.select(A.parent_dir(F.col("file")).alias("dir"), A.namespace(F.col("kind")).alias("namespace"), A.base_name(F.col("kind")).alias("base"), A.receiver(F.col("call")).alias("receiver"), A.method(F.col("call")).alias("method"), A.semantic_id(F.col("file"), F.lit("FUNCTION"), F.col("n_name")).alias("semantic"))


@query("SELECT 'h' || o_orderkey AS hash, strftime(o_orderdate, '%Y-%m-%d') AS date, 'C' || o_custkey AS author_name, CAST(count(DISTINCT l_partkey) AS INTEGER) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def git_log(spark, d):
    """Logs of one commit an order, with a file for each of its parts, read back."""
    from .sources.history import parse_git_log

    lines = read(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("1\t2\tsrc/"), F.col("l_partkey").cast("string"), F.lit(".js")))), "\n").alias("stat"))
    both = read(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    head = F.concat_ws("\x1f", F.concat(F.lit("h"), F.col("o_orderkey").cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.lit("c@x.org"), F.lit("message"))
    found = parse_git_log(both.select(F.concat(head, F.lit("\n\n"), "stat").alias("value")))
    return found.select("hash", "date", "author_name", F.size("files").alias("files"))


@query("SELECT 'kb:' || c_custkey AS id, 'DECISION' AS kind, CASE WHEN c_mktsegment = 'BUILDING' THEN 'superseded' ELSE 'active' END AS status, 'kb:' || (c_custkey + 1) AS first, 'About ' || c_name AS text FROM customer")
def note_files(spark, d):
    from .sources.history import parse_notes

    made = read(spark, d, "customer").selectExpr("concat('k/', c_custkey, '.md') AS path", "concat('---\\nid: kb:', c_custkey, '\\ntype: decision\\nstatus: ', CASE WHEN c_mktsegment = 'BUILDING' THEN 'superseded' ELSE 'active' END, '\\nrelates_to: [kb:', c_custkey + 1, ', kb:x]\\n---\\nAbout ', c_name, '\\n') AS value")
    return parse_notes(made).select("id", "kind", "status", F.col("relates_to")[0].alias("first"), "text")


@query(_CODE + "SELECT 'contains' AS archetype, (SELECT count(*) FROM p) + (SELECT count(*) FROM c) AS n UNION ALL SELECT 'flow_out', count(*) FROM r")
def edges_by_archetype(spark, d):
    from .render import by_archetype

    return by_archetype(code(spark, d).edges)


@query(_CODE + "SELECT 5 AS rows, true AS cut")
def traverse_capped(spark, d):
    """The cap is the feature: a traversal that says that it was cut."""
    found, cut = traverse.traverse(code(spark, d), ["M:3"], 2, types=["CONTAINS"], cap=5)
    return spark.createDataFrame([(found.count(), cut)], "rows int, cut boolean")


@query("SELECT 'kept' AS name, 2 AS version, 0 AS nodes")
def databases_and_clear(spark, d):
    """Two databases, of which one is dropped and the other cleared."""
    from .scratch import scratch_path

    g = graph(spark, [nodes(read(spark, d, "nation"), "concat('n', n_nationkey)", "'NATION'")])
    db = store.Store(spark, scratch_path(spark, "dbs"))
    for name in ("kept", "gone"):
        db.write(name, g)
    db.drop("gone")
    db.clear("kept")
    last = [(name, (m := db.snapshots(name)[-1])["version"], m["nodes"]) for name in db.databases()]
    return spark.createDataFrame(last, "name string, version int, nodes int")


@query("SELECT 'f:' || c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'new:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def buffered_scan(spark, d):
    """A scan that sees what an open batch has not written yet."""
    from .scratch import scratch_path
    from .session import GraphSession

    c = read(spark, d, "customer")
    s = GraphSession(store.Store(spark, scratch_path(spark, "buffer")), "g")
    old = nodes(c, "concat('f:', c_custkey)", "'FUNCTION'", file="concat('src/', c_mktsegment)")
    new = nodes(c.where("c_mktsegment = 'BUILDING'"), "concat('new:', c_custkey)", "'FUNCTION'", file="concat('src/', c_mktsegment)")
    empty = spark.createDataFrame([], EDGE_SCHEMA)
    s.commit([f"src/{r[0]}" for r in c.select("c_mktsegment").distinct().collect()], old, empty)
    with s.batch():
        s.commit(["src/BUILDING"], new, empty)
        found = s.pending.nodes.select("id")
        s.abort()
    return found


@query(_CODE + "SELECT 'NodeScan' AS operator, (SELECT count(*) FROM nation) AS rows UNION ALL SELECT 'Expand', count(*) FROM p UNION ALL SELECT 'Filter', count(*) FROM p WHERE c_nationkey = 3")
def cypher_explain(spark, d):
    from .plans.cypher import explain

    steps = explain(code(spark, d), "MATCH (m:MODULE)-[:CONTAINS]->(f:FUNCTION) WHERE m.id = 'M:3' RETURN f.id", True)
    return spark.createDataFrame([(s.operator, s.rows) for s in steps if s.rows is not None], "operator string, rows long")

"""A property-graph view of the relational tables: every table's rows as nodes, its keys as edges.

Each type is one branch of a union with literal types, so a filter on the type leaves one scan in the plan, and a
projection reads only the columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import Graph

EVENT_TYPES = ("click", "view", "purchase", "signup", "error")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _ref(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _node(df: DataFrame, kind: str | Column, key: Column, name: Column, file: Column, meta: dict[str, Column] | None, number: Column) -> DataFrame:
    metadata = F.to_json(F.struct(*(c.alias(k) for k, c in meta.items()))) if meta else F.lit(None).cast("string")
    return df.select(key.alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("node_type"), name.alias("name"), file.alias("file"), (F.pmod(number, F.lit(10)) == 0).alias("exported"), F.xxhash64(key, name, file, metadata).alias("content_hash"), metadata.alias("metadata"))


def _event(t: Callable[[str], DataFrame], kind: str | None) -> DataFrame:
    """The events of one kind under a literal type, or all of them in one scan."""
    df = t("events") if kind is None else t("events").where(F.col("event_type") == kind)
    node_type = F.concat(F.lit("event:"), F.col("event_type")) if kind is None else f"event:{kind}"
    return _node(df, node_type, _ref("EVENT", "event_id"), F.col("event_type"), F.concat(F.lit("events/"), F.col("user_id").cast("string")), {"value": F.col("value"), "props": F.from_json("props", "k bigint")}, F.col("event_id"))


def _turn(conv: str = "conv_id", turn: str | Column = "turn") -> Column:
    return F.concat(F.lit("TURN:"), F.col(conv).cast("string"), F.lit(":"), (F.col(turn) if isinstance(turn, str) else turn).cast("string"))


NODES: dict[str, Callable] = {
    "REGION": lambda t: _node(t("region"), "REGION", _ref("REGION", "r_regionkey"), F.col("r_name"), F.lit("geo/region"), None, F.col("r_regionkey")),
    "NATION": lambda t: _node(t("nation"), "NATION", _ref("NATION", "n_nationkey"), F.col("n_name"), F.concat(F.lit("geo/"), F.col("n_regionkey").cast("string")), {"regionkey": F.col("n_regionkey")}, F.col("n_nationkey")),
    "CUSTOMER": lambda t: _node(t("customer"), "CUSTOMER", _ref("CUSTOMER", "c_custkey"), F.col("c_name"), F.concat(F.lit("crm/"), F.col("c_mktsegment")), {"acctbal": F.col("c_acctbal"), "segment": F.col("c_mktsegment")}, F.col("c_custkey")),
    "SUPPLIER": lambda t: _node(t("supplier"), "SUPPLIER", _ref("SUPPLIER", "s_suppkey"), F.col("s_name"), F.lit("crm/suppliers"), {"acctbal": F.col("s_acctbal")}, F.col("s_suppkey")),
    "PART": lambda t: _node(t("part"), "PART", _ref("PART", "p_partkey"), F.col("p_name"), F.concat(F.lit("catalog/"), F.col("p_brand")), {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size"), "price": F.col("p_retailprice")}, F.col("p_partkey")),
    "ORDER": lambda t: _node(t("orders"), "ORDER", _ref("ORDER", "o_orderkey"), F.col("o_orderpriority"), F.concat(F.lit("orders/"), F.col("o_orderstatus")), {"status": F.col("o_orderstatus"), "total": F.col("o_totalprice"), "date": F.date_format("o_orderdate", "yyyy-MM-dd")}, F.col("o_orderkey")),
    **{f"event:{x}": lambda t, x=x: _event(t, x) for x in EVENT_TYPES},
    "DOCUMENT": lambda t: _node(t("documents"), "DOCUMENT", _ref("DOCUMENT", "doc_id"), F.col("doc_id").cast("string"), F.col("source"), {"lang": F.col("lang"), "n_chars": F.col("n_chars")}, F.col("doc_id")),
    "TURN": lambda t: _node(t("conversations"), "TURN", _turn(), F.col("role"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")), {"turn": F.col("turn")}, F.col("turn")),
}


def _edge(df: DataFrame, kind: str, src: Column, dst: Column, metadata: Column | None = None) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), (F.lit(None).cast("string") if metadata is None else metadata).alias("metadata"))


def _in_nation(t: Callable[[str], DataFrame]) -> DataFrame:
    return _edge(t("customer"), "IN_NATION", _ref("CUSTOMER", "c_custkey"), _ref("NATION", "c_nationkey")).union(_edge(t("supplier"), "IN_NATION", _ref("SUPPLIER", "s_suppkey"), _ref("NATION", "s_nationkey")))


def _parent(t: Callable[[str], DataFrame]) -> DataFrame:
    nation = _edge(t("nation"), "PARENT", _ref("NATION", "n_nationkey"), _ref("REGION", "n_regionkey"))
    customer = _edge(t("customer"), "PARENT", _ref("CUSTOMER", "c_custkey"), _ref("NATION", "c_nationkey"))
    return nation.union(customer).union(_edge(t("orders"), "PARENT", _ref("ORDER", "o_orderkey"), _ref("CUSTOMER", "o_custkey")))


def _contains_part(t: Callable[[str], DataFrame]) -> DataFrame:
    lines = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("qty"))
    return _edge(lines, "CONTAINS_PART", _ref("ORDER", "l_orderkey"), _ref("PART", "l_partkey"), F.to_json(F.struct("lines", "qty")))


def _chain(df: DataFrame, kind: str, by: str, order: list[str], ref: Column) -> DataFrame:
    following = df.select(ref.alias("a"), F.lead(ref).over(W.partitionBy(by).orderBy(*order)).alias("b")).where("b is not null")
    return _edge(following, kind, F.col("a"), F.col("b"))


EDGES: dict[str, Callable] = {
    "IN_REGION": lambda t: _edge(t("nation"), "IN_REGION", _ref("NATION", "n_nationkey"), _ref("REGION", "n_regionkey")),
    "IN_NATION": _in_nation,
    "PLACED": lambda t: _edge(t("orders"), "PLACED", _ref("CUSTOMER", "o_custkey"), _ref("ORDER", "o_orderkey")),
    "CONTAINS_PART": _contains_part,
    "SUPPLIED_BY": lambda t: _edge(t("lineitem").select("l_partkey", "l_suppkey").distinct(), "SUPPLIED_BY", _ref("PART", "l_partkey"), _ref("SUPPLIER", "l_suppkey")),
    "PARENT": _parent,
    "NEXT_EVENT": lambda t: _chain(t("events"), "NEXT_EVENT", "user_id", ["ts", "event_id"], _ref("EVENT", "event_id")),
    "NEXT_TURN": lambda t: _chain(t("conversations").select("conv_id", "turn").distinct(), "NEXT_TURN", "conv_id", ["turn"], _turn()),
    "SAME_SOURCE": lambda t: _chain(t("documents"), "SAME_SOURCE", "source", ["doc_id"], _ref("DOCUMENT", "doc_id")),
}


def _union(makers: dict[str, Callable], names: Iterable[str] | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = dict.fromkeys(names or makers)
    table = lambda t: read(spark, sf_dir, t)
    parts = []
    if all(f"event:{x}" in wanted for x in EVENT_TYPES):  # one scan of the events serves all their types
        wanted = [n for n in wanted if not n.startswith("event:")]
        parts.append(_event(table, None))
    return reduce(DataFrame.union, [*(makers[n](table) for n in wanted), *parts])


def relational_graph(spark: SparkSession, sf_dir: str, node_types: Iterable[str] | None = None, edge_types: Iterable[str] | None = None) -> Graph:
    """The graph over a directory of tables, or some types of it only."""
    return Graph(_union(NODES, node_types, spark, sf_dir), _union(EDGES, edge_types, spark, sf_dir))

"""Lookups, scans, counts, pages: graph primitives as plain DataFrame expressions (filters reach the scans)."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.attributes import identifier, is_endpoint, json_attribute, type_matches
from ..graph import Graph

# --- nodes ----------------------------------------------------------------------------------------------------------


def get_nodes(g: Graph, ids: Iterable[str]) -> DataFrame:
    return g.nodes.where(F.col("id").isin(*ids))


def node_exists(g: Graph, node_id: str) -> bool:
    return not g.nodes.where(F.col("id") == node_id).limit(1).isEmpty()


def identifiers(g: Graph) -> DataFrame:
    """(id, identifier): TYPE:name@file."""
    return g.nodes.select("id", identifier(F.col("node_type"), F.col("name"), F.col("file")).alias("identifier"))


def find_by_type(g: Graph, node_type: str) -> DataFrame:
    """Nodes of a type, or of every type with a prefix ('ns:*')."""
    return g.nodes.where(type_matches(F.col("node_type"), node_type))


def find_by_attributes(g: Graph, node_type: str | None = None, file: str | None = None, name: str | None = None, exported: bool | None = None, metadata: dict[str, str] | None = None, substring: bool = False) -> DataFrame:
    """Nodes that meet every given test; substring loosens the tests on name and file."""
    df = g.nodes if node_type is None else find_by_type(g, node_type)
    for column, value in (("name", name), ("file", file)):
        if value is not None:
            df = df.where(F.col(column).contains(value) if substring else F.col(column) == value)
    if exported is not None:
        df = df.where(F.col("exported") == exported)
    for key, value in (metadata or {}).items():
        df = df.where(json_attribute(F.col("metadata"), key) == value)
    return df


def in_chunks(df: DataFrame, size: int) -> Iterator[list[Row]]:
    """The rows of df in lists of `size`, partition by partition; the reader may stop at any time."""
    chunk: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        chunk.append(row)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def endpoints(g: Graph) -> DataFrame:
    return g.nodes.where(is_endpoint(F.col("node_type")))


# --- edges ----------------------------------------------------------------------------------------------------------


def edges_of_types(g: Graph, types: Iterable[str] = ()) -> DataFrame:
    types = list(types)
    return g.edges.where(F.col("edge_type").isin(*types)) if types else g.edges


def outgoing(g: Graph, node_id: str, types: Iterable[str] = ()) -> DataFrame:
    return edges_of_types(g, types).where(F.col("src") == node_id)


def incoming(g: Graph, node_id: str, types: Iterable[str] = ()) -> DataFrame:
    return edges_of_types(g, types).where(F.col("dst") == node_id)


def neighbors(g: Graph, node_id: str, types: Iterable[str] = (), direction: str = "out") -> DataFrame:
    """Distinct ids next to a node: out, in or both."""
    out, back = outgoing(g, node_id, types).select(F.col("dst").alias("id")), incoming(g, node_id, types).select(F.col("src").alias("id"))
    return {"out": lambda: out, "in": lambda: back, "both": lambda: out.union(back)}[direction]().distinct()


def with_nodes(df: DataFrame, g: Graph, column: str = "id") -> DataFrame:
    """df with node_type, name and file of the node in a column; unknown ids have the type UNKNOWN."""
    known = g.nodes.select(F.col("id").alias(column), "node_type", "name", "file")
    return df.join(known, column, "left").withColumn("node_type", F.coalesce("node_type", F.lit("UNKNOWN")))


def neighbors_by_type(g: Graph, node_id: str) -> DataFrame:
    """(direction, edge_type, n, ids) of the edges of a node."""
    sides = outgoing(g, node_id).select(F.lit("out").alias("direction"), "edge_type", F.col("dst").alias("id")).union(incoming(g, node_id).select(F.lit("in"), "edge_type", "src"))
    return sides.groupBy("direction", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("id")).alias("ids"))


def dangling_edges(g: Graph) -> DataFrame:
    """Edges of which an end is no node."""
    ids = g.nodes.select("id")
    lost = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select(*g.edges.columns)
    return lost.union(g.edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*g.edges.columns)).distinct()


# --- counts ---------------------------------------------------------------------------------------------------------


def _typed(df: DataFrame, column: str, patterns: Iterable[str]) -> DataFrame:
    hit = F.lit(False)
    patterns = list(patterns)
    for p in patterns:
        hit |= type_matches(F.col(column), p)
    return (df.where(hit) if patterns else df).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def count_nodes_by_type(g: Graph, types: Iterable[str] = ()) -> DataFrame:
    return _typed(g.nodes, "node_type", types)


def count_edges_by_type(g: Graph, types: Iterable[str] = ()) -> DataFrame:
    return _typed(g.edges, "edge_type", types)


def totals(g: Graph) -> DataFrame:
    """One row: node_count, edge_count."""
    return g.nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edge_count")))  # one row by one row


def latency_stats(log: DataFrame, ms: str = "ms") -> DataFrame:
    """queries, p50, p95, p99 over a query log."""
    p = F.percentile_approx(ms, [0.5, 0.95, 0.99], 10_000)
    return log.agg(F.count(F.lit(1)).alias("queries"), p[0].alias("p50"), p[1].alias("p95"), p[2].alias("p99"))


def slow_queries(log: DataFrame, least: float = 100.0, most: int = 10, ms: str = "ms") -> DataFrame:
    """The slowest queries of a log that took at least so many milliseconds, the slowest first; ties by their text."""
    return log.where(F.col(ms) >= least).orderBy(F.desc(ms), "query").limit(most)


# --- pages ----------------------------------------------------------------------------------------------------------


def page(df: DataFrame, limit: int = 10, offset: int = 0, most: int = 500, by: str = "id") -> tuple[DataFrame, bool]:
    """A page in the order of a key, and whether more rows follow."""
    limit = max(1, min(limit, most))
    ordered = df.orderBy(by).offset(max(0, offset))
    return ordered.limit(limit), not ordered.offset(limit).limit(1).isEmpty()


def cursor(value: str) -> str:
    return base64.b64encode(f"cursor:{value}".encode()).decode()


def page_after(df: DataFrame, after: str | None = None, first: int = 50, most: int = 250, by: str = "id") -> DataFrame:
    """The first rows whose key follows a cursor; only a top-n reaches the driver."""
    if after is not None:
        text = base64.b64decode(after).decode()
        if not text.startswith("cursor:"):
            raise ValueError("not a cursor")
        df = df.where(F.col(by) > text.removeprefix("cursor:"))
    return df.orderBy(by).limit(max(1, min(first, most)))


#: Characters of an answer, at most.
RESPONSE_SIZE = 100_000


def capped(text: str, most: int = RESPONSE_SIZE) -> str:
    """A text that says how much of it was left out, if it is longer than an answer may be."""
    return text if len(text) <= most else f"{text[:most]}\n\n[cut: {len(text) - most:,} more characters; ask for a page with limit and offset]"

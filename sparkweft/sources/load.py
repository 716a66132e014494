"""A generated code graph of any size: the same rows for the same parameters, made on the executors."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph

#: Node and edge types with their weights in the mix.
NODE_MIX = {
    "FUNCTION": 15, "VARIABLE": 15, "CALL": 12, "PARAMETER": 8, "ASSIGNMENT": 6, "PROPERTY_ACCESS": 6, "CLASS": 4, "METHOD": 4,
    "MODULE": 3, "IMPORT": 3, "EXPORT": 2, "LITERAL": 2, "CONDITION": 2, "LOOP": 2, "RETURN": 2, "ARROW_FUNCTION": 2, "BINARY_EXPR": 1, "TEMPLATE_LITERAL": 1,
    "OBJECT_LITERAL": 1, "ARRAY_LITERAL": 1, "GENERATOR": 1, "ASYNC_FUNCTION": 1, "DECORATOR": 1, "TYPE_ANNOTATION": 1, "JSX_ELEMENT": 1, "EVENT_LISTENER": 1, "ROUTE_HANDLER": 1, "MIDDLEWARE": 1, "DATABASE_QUERY": 1, "CONFIG": 1, "TRY_CATCH": 1, "THROW": 1,
}
EDGE_MIX = {
    "CONTAINS": 15, "CALLS": 12, "ASSIGNED_FROM": 10, "HAS_PARAMETER": 8, "SCOPED_IN": 8, "DEFINED_IN": 7,
    "IMPORTS_FROM": 4, "READS_PROPERTY": 4, "WRITES_PROPERTY": 3, "PASSES_ARGUMENT": 3, "RETURNS_VALUE": 3, "RESOLVES_TO": 3, "USED_IN": 3, "HAS_PROPERTY": 2,
    "EXPORTS": 1, "ITERATES_OVER": 1, "EXTENDS": 1, "IMPLEMENTS": 1, "INSTANTIATES": 1, "CATCHES_ERROR": 1, "THROWS_ERROR": 1, "LISTENS_TO": 1, "EMITS_EVENT": 1, "DEPENDS_ON": 1, "OVERRIDES": 1, "DECORATED_BY": 1, "ROUTES_TO": 1, "MIDDLEWARE_OF": 1, "QUERIES_DB": 1, "READS_CONFIG": 1, "TYPE_OF": 1, "ALIAS_OF": 1,
}


def _draw(mix: dict[str, int], roll: Column) -> Column:
    """A type by weight from a whole number."""
    at, total, out = 0, sum(mix.values()), None
    for name, weight in mix.items():
        at += weight
        hit = F.pmod(roll, F.lit(total)) < at
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def load_graph(spark: SparkSession, nodes: int = 400_000, edges: int = 800_000, files: int = 500, seed: int = 42) -> Graph:
    rolled = lambda name: F.xxhash64("id", F.lit(seed), F.lit(name))
    kind = _draw(NODE_MIX, rolled("type"))
    file = F.concat(F.lit("src/file_"), F.pmod(rolled("file"), F.lit(files)).cast("string"), F.lit(".js"))
    own = spark.range(nodes).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), kind.alias("node_type"), F.concat(F.lit("item_"), F.col("id").cast("string")).alias("name"), file.alias("file"), (F.pmod(F.col("id"), F.lit(20)) == 0).alias("exported"), F.xxhash64("id").alias("content_hash"), F.lit(None).cast("string").alias("metadata"))
    end = lambda name: F.concat(F.lit("n"), F.pmod(rolled(name), F.lit(nodes)).cast("string"))
    links = spark.range(edges).select(end("src").alias("src"), end("dst").alias("dst"), _draw(EDGE_MIX, rolled("edge")).alias("edge_type"), F.lit(None).cast("string").alias("metadata"))
    return Graph(own, links.dropDuplicates(["src", "dst", "edge_type"]))

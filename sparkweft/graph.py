"""The property graph: typed nodes and typed edges, each one DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

NODE_SCHEMA = "id string, node_type string, name string, file string, exported boolean, content_hash bigint, metadata string"
EDGE_SCHEMA = "src string, dst string, edge_type string, metadata string"


@dataclass(frozen=True)
class Graph:
    """A directed multigraph with at most one edge per (src, dst, edge_type). metadata holds a JSON object or null."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @staticmethod
    def of(spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> Graph:
        """A small graph from rows: (id, type[, name[, file[, metadata[, exported]]]]) and (src, dst, type[, metadata])."""
        full = [(n[0], n[1], *(n[2:4] + (None,) * (2 - len(n[2:4]))), n[5] if len(n) > 5 else None, None, n[4] if len(n) > 4 else None) for n in nodes]
        return Graph(spark.createDataFrame(full, NODE_SCHEMA), spark.createDataFrame([(*e, *(None,) * (4 - len(e))) for e in edges], EDGE_SCHEMA))

"""Command line: python -m sparkweft.cli ROOT DATABASE COMMAND ... over a store of graph databases."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .operators import code_queries as Q
from .operators import primitives as P
from .operators.store import Store
from .plans.datalog import violations
from .session import GraphSession


def commands() -> dict:
    """Name: (arguments, function of (session, arguments) that gives text or a DataFrame)."""
    return {
        "stats": ((), lambda s, a: P.count_nodes_by_type(s.graph).orderBy(F.desc("n"))),
        "types": ((), lambda s, a: Q.schema_export(s.graph).orderBy("kind", F.desc("n"))),
        "schema": ((), lambda s, a: Q.schema_checksum(Q.schema_export(s.graph))),
        "overview": ((), lambda s, a: Q.nodes_by_directory(s.graph).orderBy("dir", "node_type")),
        "ls": (("type",), lambda s, a: P.find_by_type(s.graph, a.type).select("id", "name", "file").orderBy("id")),
        "get": (("id",), lambda s, a: P.get_nodes(s.graph, [a.id])),
        "file": (("path",), lambda s, a: Q.file_overview(s.graph, a.path)),
        "explain": (("path",), lambda s, a: P.find_by_attributes(s.graph, file=a.path).groupBy("node_type").count()),
        "context": (("id",), lambda s, a: Q.node_context(s.graph, a.id)),
        "describe": (("id",), lambda s, a: render.describe(s.graph, a.id, 2)),
        "tldr": (("id",), lambda s, a: render.describe(s.graph, a.id, 0)),
        "wtf": (("id",), lambda s, a: render.narrate(s.graph, a.id)),
        "who": (("name",), lambda s, a: Q.callers(s.graph, a.name).orderBy("file", "line")),
        "why": (("id",), lambda s, a: Q.find_guards(s.graph, [a.id]).orderBy("depth")),
        "impact": (("id",), lambda s, a: Q.impact(s.graph, a.id)[0].orderBy("depth", "id")),
        "query": (("text",), lambda s, a: s.query(a.text, "cypher" if a.text.lstrip().upper().startswith("MATCH") else "datalog", 500).rows),
        "check": (("rules",), lambda s, a: violations(s.graph, a.rules)),
        "doctor": ((), lambda s, a: P.dangling_edges(s.graph)),
    }


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    known = commands()
    parser = argparse.ArgumentParser(prog="sparkweft")
    parser.add_argument("root")
    parser.add_argument("database")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (arguments, _) in known.items():
        p = sub.add_parser(name)
        for x in arguments:
            p.add_argument(x)
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparkweft").getOrCreate()
    out = known[a.command][1](GraphSession(Store(spark, a.root), a.database, read_only=True), a)
    if isinstance(out, DataFrame):
        out.show(100, truncate=False)
    else:
        print(out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

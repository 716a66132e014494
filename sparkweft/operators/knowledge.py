"""A knowledge base: notes (id, kind, status, text, relates_to array) and the edges between them and code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .store import upsert


def note_edges(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("id").alias("src"), F.explode("relates_to").alias("dst")).distinct().select("src", "dst", F.lit("RELATES_TO").alias("edge_type"), F.lit(None).cast("string").alias("metadata"))


def query(notes: DataFrame, kind: str | None = None, status: str | None = None, text: str | None = None, relates_to: str | None = None, dangling: DataFrame | None = None) -> DataFrame:
    """Notes that meet every given test; dangling: only those that refer to nothing in these known ids."""
    df = notes
    for column, value in (("kind", kind), ("status", status)):
        df = df if value is None else df.where(F.col(column) == value)
    if text is not None:
        df = df.where(F.lower("text").contains(text.lower()) | F.lower("id").contains(text.lower()))
    if relates_to is not None:
        df = df.where(F.array_contains("relates_to", relates_to))
    if dangling is not None:
        df = df.join(dangling_references(notes, dangling).select(F.col("src").alias("id")).distinct(), "id", "left_semi").select(*notes.columns)
    return df


def dangling_references(notes: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst): references to an id that is neither a note nor among the known ids."""
    ids = notes.select("id").union(known.select("id")).distinct()
    return note_edges(notes).join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")


def add(notes: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(notes, new, ["id"])


def supersede(notes: DataFrame, old: str, new: str) -> DataFrame:
    """The old note has the status superseded, and the new one refers to it."""
    refs = F.when(F.col("id") == new, F.array_union(F.coalesce("relates_to", F.array().cast("array<string>")), F.array(F.lit(old)))).otherwise(F.col("relates_to"))
    return notes.withColumns({"status": F.when(F.col("id") == old, "superseded").otherwise(F.col("status")), "relates_to": refs})


def decisions_for(notes: DataFrame, module: str) -> DataFrame:
    """Active decisions that refer to a module or to what lies below it."""
    hit = F.exists("relates_to", lambda x: (x == module) | x.startswith(module + "->") | x.startswith(module + "/"))
    return notes.where((F.col("kind") == "DECISION") & (F.col("status") != "superseded") & hit)


def stats(notes: DataFrame) -> DataFrame:
    """(kind, status, n)."""
    return notes.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


def resolve_addresses(addresses: DataFrame, g: Graph) -> DataFrame:
    """(address, id) of code references `file:TYPE:name` or `file:name`: the node of these parts, the least id of
    several; null where there is none."""
    p = F.split("address", ":")
    parts = addresses.select("address", p[0].alias("file"), F.when(F.size(p) > 2, p[1]).alias("wanted"), F.element_at(p, -1).alias("name"))
    known = g.nodes.select("id", "file", "name", "node_type")
    met = parts.join(known, ["file", "name"], "left").where("wanted IS NULL OR node_type IS NULL OR node_type = wanted")
    found = met.groupBy("address").agg(F.min("id").alias("id"))
    return addresses.select("address").distinct().join(found, "address", "left")


def contract_violations(guarantees: DataFrame, governed: DataFrame, required: Iterable[str]) -> DataFrame:
    """(guarantee, id, missing) of contract guarantees (id, status) over governed nodes (guarantee, id, metadata): the
    required metadata keys that a node under an active guarantee lacks."""
    active = guarantees.where("status = 'active'").select(F.col("id").alias("guarantee"))
    keys = F.coalesce(F.json_object_keys("metadata"), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*(F.lit(k) for k in required)), keys)
    return governed.join(active, "guarantee", "left_semi").select("guarantee", "id", missing.alias("missing")).where(F.size("missing") > 0)

"""Semantic ids: file->TYPE->name, with [in:parent,h:hash] and #number where names collide, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Start and factor of the 32-bit FNV-1a hash.
FNV_START, FNV_FACTOR = 2166136261, 16777619


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash over the UTF-8 bytes of a text, as a long."""
    digits = F.hex(F.encode(text, "UTF-8"))
    bytes_ = F.transform(F.filter(F.sequence(F.lit(1), F.length(digits)), lambda i: (i % 2 == 1) & (F.length(digits) > 0)), lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(bytes_, F.lit(FNV_START).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * FNV_FACTOR, F.lit(1 << 32)))


def content_hash(text: Column) -> Column:
    """Four hex digits: the low 16 bits of FNV-1a."""
    return F.lpad(F.lower(F.hex(F.pmod(fnv1a(text), F.lit(1 << 16)))), 4, "0")


def semantic_ids(nodes: DataFrame) -> DataFrame:
    """nodes (file, node_type, name, parent, hints, line, column) with semantic_id.

    A name alone in its file, type and parent needs no hash; names that collide get the hash of their hints; those whose
    hash collides too are numbered by position, the first without a number. Colliding names are few, so windows are small.
    """
    shared = ["file", "node_type", "name", "parent"]
    hashed = nodes.withColumn("_h", content_hash(F.coalesce("hints", F.lit(""))))
    counted = hashed.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*shared)))
    number = F.row_number().over(W.partitionBy(*shared, "_h").orderBy("line", "column")) - 1
    collides = F.col("_n") > 1
    inside = F.concat_ws(",", F.when(F.col("parent").isNotNull(), F.concat(F.lit("in:"), "parent")), F.when(collides, F.concat(F.lit("h:"), "_h")))
    base = F.concat(F.col("file"), F.lit("->"), F.col("node_type"), F.lit("->"), F.col("name"), F.when(inside != "", F.concat(F.lit("["), inside, F.lit("]"))).otherwise(""))
    numbered = counted.withColumn("_k", number)
    return numbered.withColumn("semantic_id", F.when(collides & (F.col("_k") > 0), F.concat(base, F.lit("#"), F.col("_k").cast("string"))).otherwise(base)).drop("_h", "_n", "_k")


def parse_semantic_id(node_id: Column) -> Column:
    """A struct (file, node_type, name, parent, hash, number); null parts where the text has none, null for other texts."""
    pattern = r"^(.*?)->([^>]+?)->(.*?)(?:\[(?:in:([^\],]*))?,?(?:h:([0-9a-f]{4}))?\])?(?:#(\d+))?$"
    part = lambda i: F.nullif(F.regexp_extract(node_id, pattern, i), F.lit(""))
    out = F.struct(part(1).alias("file"), part(2).alias("node_type"), part(3).alias("name"), part(4).alias("parent"), part(5).alias("hash"), part(6).cast("int").alias("number"))
    return F.when(node_id.rlike(pattern), out)


def discriminators(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """nodes with discriminator: the place of a node among those of its name in its scope, by line and column."""
    return nodes.withColumn("discriminator", F.row_number().over(W.partitionBy(*scope, "name").orderBy("line", "column")) - 1)

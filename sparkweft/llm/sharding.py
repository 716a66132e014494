"""Weighted rendezvous (highest random weight) hashing of record keys over shards, in built-in expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import md5_bits, uniform

#: Hash buckets that one shard's slots are counted in. A constant, so slots do not depend on the session's settings:
#: 8 shards have 8,192 cells, so 10^11 rows are 12 million narrow ones to a cell.
BUCKETS = 1024


def _score(key: Column, shard: int, weight: float) -> Column:
    """weight / -ln(u), u uniform in (0, 1) from key and shard: the largest score wins in proportion to its weight."""
    return F.lit(float(weight)) / -F.log(uniform("shard", key, shard))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: depends on the key and the weights alone; ties go to the larger shard number.

    Adding a shard moves into it only the keys it wins; a shard of weight 0 gets none.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("some shard needs a positive weight")
    scored = [F.struct(_score(key, i, w).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["i"].cast("int")


def assign_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row: key, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard, copies_before.

    law is always "key". slot counts gapless from 0 within a shard. grown_shard is the shard when one more of mean
    weight is added. A null text has size 1 and crc32 0; a null key is a key like any other; repeated rows are all
    kept, each with its own slot; an empty table gives an empty one; other columns, whatever their names, take no
    part. Repeated rows are counted before the shuffle and spread out after it, and a shard's slots are numbered
    within hash buckets whose offsets are added, so no key, text or shard meets in one task. All randomness is MD5 of
    the row, so equal tables give equal rows whatever their partitions and the session's settings.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    counted = rows.groupBy("key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    grown = [*weights, sum(weights) / len(weights)]
    placed = counted.select(
        "*", rendezvous_shard(F.col("key"), weights).alias("shard"), rendezvous_shard(F.col("key"), grown).alias("grown_shard"),
        F.pmod(md5_bits("slot", F.col("key"), F.col("size"), F.col("text_crc32")), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    sums = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("filled"))
    starts = sums.select("shard", "bucket", (F.sum("filled").over(W.partitionBy("shard").orderBy("bucket")) - F.col("filled")).alias("start"))
    inside = W.partitionBy("shard", "bucket").orderBy(F.col("key").asc_nulls_last(), "size", "text_crc32")
    numbered = placed.withColumn("before", F.sum("n").over(inside) - F.col("n"))
    return (
        numbered.join(F.broadcast(starts), ["shard", "bucket"])  # shards x buckets rows: both are parameters
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("before") + F.col("copy")).alias("slot"), "grown_shard", F.col("copy").alias("copies_before"))
    )

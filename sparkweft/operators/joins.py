"""Joins in which a key with many rows neither fills a task nor is left to one.

A sort-merge join sorts all rows of a key in one task, and adaptive execution does not send an index that lies in few
partitions. So an index is written first: then its size is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import settled

#: Rows of an index, at most, that every task gets whole.
SMALL = 50_000
#: Rows of a key on the left and on the right, about, that one task makes pairs of.
LEFT, RIGHT = 1024, 16_384
#: Pairs that a task makes, about, and tasks, at most.
PAIRS, TASKS = 1 << 20, 1000


def meet(rows: DataFrame, index: DataFrame, *keys: str) -> DataFrame:
    """rows joined with an index of few rows a key. A small index is sent whole; of another each task hashes its share,
    and the rows of a key stream past it unsorted."""
    index = settled(index, "index")
    return rows.join(F.broadcast(index) if index.count() <= SMALL else index.hint("shuffle_hash"), list(keys))


def product(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, a, b): all pairs of a (of left) and b (of right) with one key. A key's rows are dealt into blocks by hash,
    each block of the left, as an array, meets each block of the right in a task of its own choosing: what is moved is
    the rows and about a thousandth of the pairs."""
    left, right = settled(left.select(key, a), "left"), settled(right.select(key, b), "right")
    counted = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    sizes = settled(counted(left, "_a").join(counted(right, "_b"), key).select(key, "_a", "_b", F.ceil(F.col("_a") / LEFT).cast("int").alias("_l"), F.ceil(F.col("_b") / RIGHT).cast("int").alias("_r")), "sizes")
    tasks = -(-int(sizes.agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0) // PAIRS)
    sizes = sizes.select(key, "_l", "_r")
    # Few rows make many pairs, and adaptive execution, which sees the rows only, would put them into one task.
    spread = lambda df: df.repartition(min(tasks, TASKS), key, "_i", "_j") if tasks > 1 else df
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lists = meet(left, sizes, key).groupBy(key, deal(a, "_l").alias("_i"), "_r").agg(F.collect_list(a).alias("_as")).select(key, "_i", "_as", every("_r").alias("_j"))
    rows = meet(right, sizes, key).withColumn("_j", deal(b, "_r")).select(key, b, "_j", every("_l").alias("_i"))
    return spread(lists).join(spread(rows), [key, "_i", "_j"]).select(key, F.explode("_as").alias(a), b)

"""Mixing sources to target weights by systematic sampling, in built-in expressions only.

Each document of a source is expected target / size-of-source times. Expected copies are summed up in order of size,
one random offset a source is added, and a document is emitted once per integer the running sum passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BITS, bitmap, md5_bits, settled, sieved, uniform

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a size that name its class below the first, so a class is 6 % wide and sizes below 32 have their own; and
#: hash parts of a class. Constants, so that the mix does not depend on the session's settings.
STEP_BITS, PARTS = 4, 16
#: Sources, the largest, whose usual numbers of copies are sent to every task; rows of the others are joined.
SOURCES = 10_000


def n_words(text: Column) -> Column:
    """The number of words: 0 for a null or blank text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: Sequence[float], limit: float) -> DataFrame:
    """Add weight and target to (source, source_size): the sum of all sizes, shared by weight, none above limit x its size.

    Weights repeat along the sources by code point, null last. With caps c and weights w, the level L solves
    sum(min(c, L w)) = total: sources in ascending c / w are full as long as (total - caps so far) / (weights from
    here on) reaches their own c / w. One row per source passes through the windows.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    cap = F.lit(float(limit)) * F.col("source_size")
    by_fill = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= cap)
    at = F.max(F.when(~F.col("full"), F.col("level"))).over(W.partitionBy())  # levels fall from the first source that is not full on
    return levels.select("source", "source_size", "weight", F.when(F.col("full"), cap).otherwise(F.least(cap, at * F.col("weight"))).alias("target"))


def with_copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: float = 3, seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of docs: its key, size, source, source_size, target and copies (0 to ceil(limit)).

    Null texts have size 0; a null source is a source of its own, the last. Repeated rows are each sampled. A source
    without words has target 0 and rate 0; an empty table gives an empty one; other columns, whatever their names,
    take no part. All randomness is MD5 of seed and row, so equal tables give equal copies whatever their partitions
    and the session's settings. No source meets in one task: rows are numbered within (source, size class, hash part)
    and the counts before it are added.
    """
    return _copies(docs.select(F.col(key).alias("key"), n_words(F.col(text)).alias("size"), F.col(source).alias("source")), weights, limit, seed)


def size_class(size: Column) -> Column:
    """Rises with size, in integers only: sizes below 2^(STEP_BITS + 1) have a class each, larger ones share their first bits."""
    low = F.greatest(F.length(F.bin(size)) - (STEP_BITS + 1), F.lit(0)).cast("int")
    return (F.lit(1 << STEP_BITS) * low + F.call_function("shiftright", size, low)).cast("int")


def _copies(rows: DataFrame, weights: Sequence[float], limit: float, seed: int) -> DataFrame:
    cell = ["source", "class", "part"]
    counted = rows.groupBy("key", "size", "source").agg(F.count(F.lit(1)).alias("n")).select(
        "*", size_class(F.col("size")).alias("class"), F.pmod(md5_bits("part", seed, F.col("key"), F.col("size")), F.lit(PARTS)).cast("int").alias("part"))
    cells = counted.groupBy(*cell).agg(F.sum("n").alias("filled"), F.sum(F.col("n") * F.col("size")).alias("words"))
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    rates = water_fill(sizes, weights, limit).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    # Largest first: what the copies so far are off by weighs no more than the step from one size to the next, so a
    # source comes as near to its target as its largest document allows.
    starts = cells.select(*cell, (F.sum("filled").over(W.partitionBy("source").orderBy(F.desc("class"), "part")) - F.col("filled")).alias("start"))
    plan = _same(starts, rates.select("source", "source_size", "target", "rate"), ["source"])
    inside = W.partitionBy(*cell).orderBy(F.desc("size"), md5_bits("order", seed, F.col("key")), F.col("key").asc_nulls_last())
    numbered = counted.withColumn("before", F.sum("n").over(inside) - F.col("n"))
    k = F.col("start") + F.col("before") + F.col("copy")
    offset = uniform("offset", seed, F.col("source"))
    copies = F.floor((k + 1) * F.col("rate") + offset) - F.floor(k * F.col("rate") + offset)
    return (
        _same(numbered, plan, cell).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select("key", "size", "source", "source_size", "target", F.least(copies, F.ceil(F.col("rate"))).cast("long").alias("copies"), "copy")
    )


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which null keys meet too; the columns of right's keys are left out."""
    other = right.select(*(F.col(c).alias(f"_r_{c}" if c in on else c) for c in right.columns))
    hit = F.lit(True)
    for c in on:
        hit &= left[c].eqNullSafe(other[f"_r_{c}"])
    return left.join(other, hit).drop(*(f"_r_{c}" for c in on))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: float = 3, seed: int = 42) -> DataFrame:
    """docs with every row repeated as often as the mix takes it (0 times: left out); same columns.

    Rows are sampled as in with_copies. Those that share doc_id, size and source are alike to the sampler: their
    copies are summed and dealt out evenly over the different rows, in the order of a hash of all their columns. Only
    rows without a doc_id and repeated rows can be such; equal ones are counted before they are shuffled. Texts are
    moved only where two bitmaps do not tell the number of copies.
    """
    keep = docs.columns
    keys = docs.select(F.struct(F.col("doc_id").alias("a"), n_words(F.col("text")).alias("b"), F.col("source").alias("c")).alias("key"))
    got = _copies(keys.select(F.col("key.a").alias("key"), F.col("key.b").alias("size"), F.col("key.c").alias("source")), weights, limit, seed)
    taken = got.groupBy(F.struct(F.col("key").alias("a"), F.col("size").alias("b"), F.col("source").alias("c")).alias("__mix_key"))
    taken = settled(taken.agg(F.sum("copies").alias("__mix_copies"), F.count(F.lit(1)).alias("__mix_n")), "taken")
    told, open_ = _told(docs, taken)
    sized = open_.withColumn("__mix_key", F.struct(F.col("doc_id").alias("a"), n_words(F.col("text")).alias("b"), F.col("source").alias("c")))
    some = taken.where("__mix_copies > 0")
    mixed = told.unionByName(sized.join(some.where("__mix_n = 1"), "__mix_key").select(*keep, "__mix_copies"))
    if some.where("__mix_n > 1").limit(1).count():
        mixed = mixed.unionByName(_dealt_out(sized.join(some.where("__mix_n > 1"), "__mix_key"), keep))
    return mixed.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*keep)


def _told(docs: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs in two: rows whose __mix_copies (over 0) follow from two bitmaps, and rows that must be joined with taken.

    A source's rows are taken floor(rate) or ceil(rate) times. Its most frequent number is the usual one, its second
    the other one. The first bitmap holds all keys but those taken the usual number of times; the second those that the
    first holds, or seems to hold, and that are not taken the other number of times. So what the first lacks is usual,
    what only the first has is the other, and what both have is joined, as are the rows of all but the SOURCES largest
    sources. Texts that are told stay where they are.
    """
    keep = docs.columns
    slot = lambda doc_id, source: F.pmod(F.xxhash64(doc_id, source), F.lit(BITS))
    single = taken.where("__mix_n = 1").groupBy(F.col("__mix_key.c").alias("source"), "__mix_copies").agg(F.count(F.lit(1)).alias("n"))
    ranked = single.groupBy("source").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("n", "__mix_copies")), asc=False).alias("found"))
    usual = ranked.orderBy(F.desc("n"), F.col("source").asc_nulls_last()).limit(SOURCES)
    second = F.get("found", F.lit(1))["__mix_copies"]
    usual = settled(usual.select("source", F.element_at("found", 1)["__mix_copies"].alias("__mix_usual"), second.alias("__mix_other")), "usual")
    known = F.broadcast(usual.withColumnRenamed("source", "__mix_source"))
    placed = taken.join(known, F.col("__mix_key.c").eqNullSafe(F.col("__mix_source")))
    single_row, copies = F.col("__mix_n") == 1, F.col("__mix_copies")
    placed = placed.select(
        slot(F.col("__mix_key.a"), F.col("__mix_key.c")).alias("slot"),
        (single_row & (copies == F.col("__mix_usual"))).alias("usual"), (single_row & F.coalesce(copies == F.col("__mix_other"), F.lit(False))).alias("other"),
    )
    first = bitmap(placed.where("not usual").select("slot"))
    second = bitmap(sieved(placed.where("not other"), F.col("slot"), first)[0].select("slot"))
    rows = docs.join(known, docs["source"].eqNullSafe(F.col("__mix_source")), "left").withColumn("__mix_at", slot(F.col("doc_id"), F.col("source")))
    unknown, rows = rows.where("__mix_usual is null"), rows.where("__mix_usual is not null")
    some, plain = sieved(rows, F.col("__mix_at"), first)
    open_, others = sieved(some, F.col("__mix_at"), second)
    told = plain.select(*keep, F.col("__mix_usual").alias("__mix_copies")).unionByName(others.select(*keep, F.col("__mix_other").alias("__mix_copies")))
    return told.where("__mix_copies > 0"), open_.select(*keep).unionByName(unknown.select(*keep))


def _dealt_out(shared: DataFrame, keep: list[str]) -> DataFrame:
    """Each different row of a shared key once, with the copies that it takes of the key's sum: those that fall on its
    places in the order of the key's rows. Only hashes and counts pass through the window."""
    on = ["__mix_key", "__mix_hash"]
    rows = shared.withColumn("__mix_hash", F.xxhash64(*(F.col(c) for c in keep)))
    whole = rows.groupBy(*on).agg(F.first(F.struct(*keep)).alias("__mix_row"), F.count(F.lit(1)).alias("__mix_rows"), F.first("__mix_copies").alias("__mix_sum"), F.first("__mix_n").alias("__mix_all"))
    before = F.sum("__mix_rows").over(W.partitionBy("__mix_key").orderBy("__mix_hash")) - F.col("__mix_rows")
    places = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__mix_rows")).select(*on, before.alias("__mix_before"))
    upto = lambda n: F.expr(f"({n}) * __mix_sum div __mix_all")
    copies = upto("__mix_before + __mix_rows") - upto("__mix_before")
    return _same(whole, places, on).select("__mix_row.*", copies.alias("__mix_copies")).where("__mix_copies > 0")

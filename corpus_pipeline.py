"""A training corpus from raw documents: quality, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as Parquet and reads again as the
next one's docs. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.llm import bpe, mixing, near_copies, quality
from sparkweft.llm.common import BITS, bitmap, release, settled, sieved, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject. Fitted on the labelled rows of the table itself."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    shown = docs.select("*", F.struct("*").alias("__row")).select("__row", "text")
    return quality.score_documents(shown, model).where("predicted = 1").select(*(F.col("__row")[c].alias(c) for c in columns))


def keep_one_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more): the one with the smallest doc_id.

    Candidates are those of the SimHash operator's Golay tables and of MinHash bands; whole sets of shingles decide. Of
    repeated rows of a doc_id the group keeps one. Rows with a null doc_id have no name to be chosen by: such a row
    stays only where its group has no other, once a group.
    """
    found = near_copies.near_copies(docs)
    first = found.where("doc_id = component_id or component_id is null").groupBy("group").agg(F.min("doc_id").alias("__keep_id"), F.min("print").alias("__keep_print"), F.count(F.lit(1)).alias("rows"))
    chosen = settled(first, "chosen")
    columns = docs.columns
    if chosen.where("rows > 1 or __keep_id is null").limit(1).isEmpty() and chosen.groupBy("__keep_id").count().where("count > 1").limit(1).isEmpty():
        # Only rows that a sieve of bounded size takes for copies are joined.
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
        copies = found.where("doc_id != component_id").select(slot.alias("slot"))
        open_, kept = sieved(docs.where("doc_id is not null"), slot, bitmap(copies))
        return kept.unionByName(open_.join(chosen.select("__keep_id"), F.col("doc_id") == F.col("__keep_id"), "left_semi").select(*columns))
    # Some ids are repeated or null: then the text says which rows are meant, and one row of each group is taken.
    prints = docs.withColumn("__print", F.udf(near_copies.identity, "binary", useArrow=True)(F.col("text")))
    meant = prints.join(chosen, prints["doc_id"].eqNullSafe(F.col("__keep_id")) & (F.col("__print") == F.col("__keep_print")))
    one = meant.groupBy("group").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row"))
    return one.select("__row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources by code point weigh 5, 2, 1, repeating."""
    return mixing.mix_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text: doc_id, n_tokens and the digests of ids and decoded bytes, n_bytes."""
    return bpe.roundtrip_digests(docs)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_each), ("mix", mix_sources), ("encode", encode_bpe)]

#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

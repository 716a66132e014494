"""The ten queries of this subpackage and the pipeline: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_blocks, language_model, matroska, mixing, quality, sharding, simhash, token_files, topk
from .common import table

#: Shards of op7: eight of equal weight, and a ninth for grown_shard.
SHARDS = [1.0] * 8


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_table(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(token_files.write_token_files(table(spark, sf_dir, "documents")))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(matroska.text_media(table(spark, sf_dir, "documents")))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


#: op6 in DuckDB's SQL.
OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op7_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS).drop("copies_before")


#: op7 in DuckDB's SQL; the CRC-32 is computed byte by byte from a table made by its rule.
OP7_SQL = """
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8
), bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    list_transform(string_split(rtrim(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g')), ' '), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM (SELECT doc_id, nullif(text, '') AS text FROM documents WHERE text <> '')
  UNION ALL SELECT doc_id, 1, NULL FROM documents WHERE text IS NULL OR text = ''
), digests AS (
  SELECT doc_id, size, CASE WHEN b IS NULL THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) END AS text_crc32, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM bytes, crc
), scored AS (
  SELECT *, list_transform(range(9), lambda i: CAST('0x' || substr(md5('shard|' || k || '|' || i), 1, 13) AS BIGINT)) AS s, CAST('0x' || substr(md5('slot|' || k || '|' || size || '|' || text_crc32), 1, 13) AS BIGINT) % 1024 AS bucket FROM digests
), placed AS (SELECT *, list_position(s, list_max(s[1:8])) - 1 AS shard, list_position(s, list_max(s)) - 1 AS grown_shard FROM scored)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS LAST, size, text_crc32) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM placed
"""

#: op8 in DuckDB's SQL.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (SELECT *, level * weight >= cap AS filled, max(CASE WHEN level * weight < cap THEN level END) OVER () AS share FROM l
), t AS (
  SELECT source, source_size, CASE WHEN filled THEN cap ELSE least(cap, share * weight) END AS target,
    (CAST('0x' || substr(md5('offset|42|' || coalesce(source, 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496 AS u FROM f
), c AS (
  SELECT *, greatest(length(bin(size)) - 5, 0) AS low, CAST('0x' || substr(md5('part|42|' || k || '|' || size), 1, 13) AS BIGINT) % 16 AS part, CAST('0x' || substr(md5('order|42|' || k), 1, 13) AS BIGINT) AS ord FROM d
), n AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY c.source ORDER BY 16 * low + (c.size >> low) DESC, part, c.size DESC, ord, c.doc_id NULLS LAST) - 1 AS place
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CAST(least(floor((place + 1) * rate + u) - floor(place * rate + u), ceil(rate)) AS BIGINT) AS copies FROM n)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM e
"""


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_simhash": op2_simhash,
        "op3_quality": op3_quality,
        "op4_token_files": op4_token_files,
        "op5_matroska": op5_matroska,
        "op6_exact_topk": op6_exact_topk,
        "op7_rendezvous": op7_rendezvous,
        "op8_systematic_mix": op8_systematic_mix,
        "op9_main_text": op9_main_text,
        "op10_maxent_lm": op10_maxent_lm,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """SQL follows op6, op7 and op8. The others rest on hashes of other libraries, tokenizers or models, which SQL
    cannot follow to the last digit: the tests hold each of them against a plain Python version instead."""
    return {"op6_exact_topk": OP6_SQL, "op7_rendezvous": OP7_SQL, "op8_systematic_mix": OP8_SQL}

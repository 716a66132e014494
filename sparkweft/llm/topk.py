"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are dealt into ranges of ids. Inside a range rows are ordered by likeness and cut into blocks that keep each
component's largest and smallest value (the term maxima) and the block's rows (its forward index). For a query, a
block's bound is the sum over components of the largest product its range allows. Blocks are taken in falling order of
bound and scored through their rows until the next bound is below the k-th score found; equal bounds are still scored,
for a tie may have a smaller id. Every range starts from the k-th score that a first pass over a few rows has found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_limits

SCALE, BLOCK = 1024, 64
#: Bytes of the vectors that one range (its rows are searched in one task) or one chunk of queries holds, about.
RANGE_BYTES, CHUNK_BYTES = 16 << 20, 1 << 18
#: Rows and bytes of the first pass, at most: what every task that reads queries is sent.
SEEDS, SEED_BYTES = 2048, 8 << 20
PACKED = "ids binary, width int, rows binary, least binary"


def valid_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, v): rows with a key and a vector without null, NaN or infinite components."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull() & finite).select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("v"))


def _pack(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors) in packs of about limit bytes; shorter vectors are filled up with zeros."""
    ids: list[np.ndarray] = []
    vectors: list[np.ndarray] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        width = int(sizes.max())
        values = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
        block = np.zeros((len(sizes), width), np.int64)
        block[np.arange(width) < sizes[:, None]] = values
        step = max(1, limit // (8 * max(1, width)))
        keys = batch.column(0).to_numpy()
        for i in range(0, len(keys), step):
            ids.append(keys[i : i + step])
            vectors.append(block[i : i + step])
            held += vectors[-1].nbytes + ids[-1].nbytes
            if held >= limit:
                yield _joined(ids, vectors)
                ids, vectors, held = [], [], 0
    if ids:
        yield _joined(ids, vectors)


def _joined(ids: list[np.ndarray], vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((sum(map(len, ids)), max(v.shape[1] for v in vectors)), np.int64)
    at = 0
    for v in vectors:
        out[at : at + len(v), : v.shape[1]] = v
        at += len(v)
    return np.concatenate(ids), out


def _exact(vectors: np.ndarray, *others: np.ndarray) -> bool:
    """Whether sums of products are exact in doubles, which are fast."""
    most = [int(np.abs(x).max(initial=0)) for x in (vectors, *others)]
    return most[0] * max(most[1:], default=most[0]) * max(1, vectors.shape[1]) < 1 << 53


def by_likeness(rows: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """An order of the rows that keeps like ones together: parts are halved along the line between two far rows, in
    multiples of a block."""
    out, todo, x = [], [np.arange(len(rows))], rows.astype(np.float64)
    while todo:
        at = todo.pop()
        if len(at) <= block:
            out.append(at)
            continue
        part = x[at]
        first = part[((part - part.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        second = part[((part - first) ** 2).sum(axis=1).argmax()]
        half = (len(at) // block + 1) // 2 * block if len(at) >= 2 * block else block
        order = np.argsort(part @ (second - first), kind="stable")
        todo += [at[order[half:]], at[order[:half]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Range:
    """Rows ordered by likeness, and the term maxima and minima of their blocks."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK) -> None:
        order = by_likeness(rows, block)
        self.ids, self.rows, self.block = ids[order], rows[order], block
        self.cuts = np.arange(0, len(rows), block)
        self.high, self.low = (f.reduceat(self.rows, self.cuts) if len(rows) else self.rows for f in (np.maximum, np.minimum))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """For each query the ids and scores of its k best rows, best first, of those that reach its least score; and
        how many blocks were scored in all. A row with the query's own id is no candidate."""
        width = min(queries.shape[1], self.rows.shape[1])
        queries, rows, high, low = queries[:, :width], self.rows[:, :width], self.high[:, :width], self.low[:, :width]
        if _exact(queries, rows):
            queries, rows, high, low = (x.astype(np.float64) for x in (queries, rows, high, low))
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        order = np.argsort(-bounds, axis=1, kind="stable")
        best_ids, best_scores, scored = [], [], 0
        for q in range(len(queries)):
            top_id, top = np.empty(0, np.int64), np.empty(0, rows.dtype)
            floor = -np.inf if least is None else least[q]
            for start in range(0, len(self.cuts), 8):
                some = order[q, start : start + 8]
                if len(top) >= k:
                    floor = max(floor, top[k - 1])
                some = some[bounds[q, some] >= floor]
                if not len(some):
                    break
                scored += len(some)
                at = (self.cuts[some][:, None] + np.arange(self.block)).ravel()
                at = at[at < len(rows)]
                score = rows[at] @ queries[q]
                keep = (score >= floor) & (self.ids[at] != query_ids[q])
                all_ids, all_scores = np.concatenate([top_id, self.ids[at[keep]]]), np.concatenate([top, score[keep]])
                first = np.lexsort((all_ids, -all_scores))[:k]
                top_id, top = all_ids[first], all_scores[first]
            best_ids.append(top_id)
            best_scores.append(top.astype(np.int64))
        return best_ids, best_scores, scored


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK, least: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Range(ids, rows, block).search."""
    return Range(ids, rows, block).search(query_ids, queries, k, least)


def least_scores(query_ids: np.ndarray, queries: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among the seeds, as a number that no better row falls below; -inf where
    fewer than k seeds are candidates."""
    width = min(queries.shape[1], seeds.shape[1])
    out = np.full(len(queries), -np.inf)
    a, b = queries[:, :width], seeds[:, :width]
    if len(b) and _exact(a, b):
        scores = a.astype(np.float64) @ b.astype(np.float64).T
        scores[query_ids[:, None] == seed_ids[None, :]] = -np.inf
        if scores.shape[1] >= k:
            out = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return out


def _seeds(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, integer vectors) of at most SEEDS rows, those of the smallest hashes, and of SEED_BYTES in all."""
    some = rows.orderBy(F.xxhash64("key"), "key", F.xxhash64("v")).limit(SEEDS).collect()
    ids, vectors, held = [], [], 0
    for r in some:
        held += 8 * len(r["v"])
        if held > SEED_BYTES:
            break
        ids.append(r["key"])
        vectors.append(r["v"])
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(ids), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(SCALE * np.array(v, float)).astype(np.int64)
    return np.array(ids, np.int64), out


def top_k(vectors: DataFrame, is_query: str = "key % 100 = 0", k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that is_query names, its k best other rows.

    Scores are inner products of floor(1024 x) in whole numbers; ties go to smaller ids. Rows without id, without a
    vector or with a null or non-finite component take no part; shorter vectors count as filled up with zeros; rows
    with a query's own id are not its candidates; of rows that share a query's id the one with the least vector asks;
    a repeated row counts as often as it stands there. Fewer than k rows: all. An empty table gives an empty one;
    other columns, whatever their names, take no part.
    """
    spark = vectors.sparkSession
    arrow_limits(spark)
    rows = valid_vectors(vectors, key, column)
    size = rows.agg(F.sum(8 * F.size("v") + 8).alias("bytes")).first()["bytes"] or 0
    ranges = max(1, -(-size // RANGE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (RANGE_BYTES // 64))))
    seeds = spark.sparkContext.broadcast(_seeds(rows))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cell = TaskContext.get().partitionId()
        for ids, found in _pack(batches, CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([0], pa.int32()), *(pa.array([x], t) for x, t in ((ids.tobytes(), pa.binary()), (found.shape[1], pa.int32()), (found.tobytes(), pa.binary()), (None, pa.binary())))], ["cell", "kind", "ids", "width", "rows", "least"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _pack(batches, CHUNK_BYTES):
            least = least_scores(ids, found, *seeds.value, k)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((ids.tobytes(), pa.binary()), (found.shape[1], pa.int32()), (found.tobytes(), pa.binary()), (least.tobytes(), pa.binary()))], ["ids", "width", "rows", "least"])

    # A range is one task's rows: equal ids are parted by their vectors, so no id makes a range large.
    held = rows.repartitionByRange(int(ranges), "key", F.xxhash64("v")).mapInArrow(pack, f"cell int, kind int, {PACKED}")
    asked = rows.where(is_query).groupBy("key").agg(F.min("v").alias("v")).mapInArrow(ask, PACKED)
    # Every chunk of queries goes to every range: the stated query set against all rows, in blocks.
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(int(ranges) - 1))).alias("cell"), F.lit(1).alias("kind"), "ids", "width", "rows", "least")
    met = held.unionByName(sent).repartition(int(ranges), "cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, packs, held = None, [], None
        for batch in batches:
            for r in batch.to_pylist():  # a range's packs come first, then its chunks of queries
                if r["cell"] != cell:
                    cell, packs, held = r["cell"], [], None
                ids = np.frombuffer(r["ids"], np.int64)
                found = np.frombuffer(r["rows"], np.int64).reshape(len(ids), r["width"])
                if not r["kind"]:
                    packs.append((ids, found))
                    continue
                if held is None:
                    held = Range(*_joined([p[0] for p in packs], [p[1] for p in packs])) if packs else Range(np.zeros(0, np.int64), np.zeros((0, 0), np.int64))
                    packs = []
                if not len(held.ids):
                    continue
                best, scores, _ = held.search(ids, found, k, np.frombuffer(r["least"], np.float64))
                counts = [len(b) for b in best]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate(best)), pa.array(np.concatenate(scores))], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

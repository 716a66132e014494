"""Quality classifier by compression: zstandard with a dictionary of good and one of bad text.

A text's compressed sizes under the two dictionaries, which are of equal size, differ by how much of it either has
seen. The difference a byte of plain text alone is calibrated to a probability, by a logistic curve with three bends
fitted on labelled rows that the dictionaries of their fold have not seen.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

#: The bound of the training sample: labelled rows of either class, by ascending hash of doc_id, so it does not depend
#: on partitioning; and characters that a row gives to it, from a place chosen by the same hash.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 1 << 14
DICT_BYTES, LEVEL, THRESHOLD = 112_640, 3, 0.3
#: Bytes compressed at a time: small, so that the dictionary tells more than the text's own beginning.
BLOCK = 1 << 11
FOLDS = 4
#: Bytes of average text that every text is filled up with: a short text tells little, a text that repeats itself is
#: small under both dictionaries and tells that it is not like the good.
FILL = 64
#: Shares of the bad rows at which the curve may bend.
BENDS = (0.3, 0.6, 0.9)


@dataclass(frozen=True)
class Model:
    """Dictionaries; the average difference a byte; the weights and the bends of the curve."""

    good: bytes
    bad: bytes
    average: float
    weights: tuple[float, ...]
    bends: tuple[float, ...] = ()
    level: int = LEVEL

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 for each text; null and empty texts get that of average text."""
        d = normalised(differences(texts, self.good, self.bad, self.level), self.average)
        return 1 / (1 + np.exp(-np.clip(_curve(d, self.bends) @ np.array(self.weights), -35, 35)))


def normalised(found: np.ndarray, average: float) -> np.ndarray:
    """The difference a byte of rows (difference, bytes), each filled up with FILL bytes of average text."""
    return (found[:, 0] + FILL * average) / (found[:, 1] + FILL)


def _curve(d: np.ndarray, bends: tuple[float, ...]) -> np.ndarray:
    return np.stack([np.ones(len(d)), d, *(np.maximum(d - k, 0) for k in bends)], axis=1)


@functools.lru_cache(maxsize=8)
def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=level, write_content_size=False, write_dict_id=False)
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO)
    content.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_dict_id=False)


def _size(compressor: zstandard.ZstdCompressor, raw: bytes) -> int:
    """Compressed bytes, block by block: each meets the dictionary afresh, so the end of a long text tells as much as its beginning."""
    return sum(len(compressor.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK))


def differences(texts: list[str | None], good: bytes, bad: bytes, level: int = LEVEL) -> np.ndarray:
    """Rows of the compressed size under the bad less that under the good dictionary, and the plain size; 0 for null and
    empty texts."""
    a, b = _compressor(good, level), _compressor(bad, level)
    out = np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        if raw := (text or "").encode():
            out[i] = _size(b, raw) - _size(a, raw), len(raw)
    return out


def _dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary of at most size bytes. The trainer now and then stops far below it: longer segments are
    tried then; where it has too little to go on, the texts' own bytes serve as a raw one."""
    pieces = [x[i : i + 1024] for x in texts for i in range(0, len(x), 1024)]
    best = b""
    for k in (64, 256, 1024):
        try:
            found = zstandard.train_dictionary(size, pieces, k=k, d=8).as_bytes()
        except zstandard.ZstdError:
            continue
        best = max(best, found, key=len)
        if len(best) > 0.9 * size:
            return best
    return best or b"\n".join(texts)[-size:]


def _dictionaries(bad: list[bytes], good: list[bytes]) -> tuple[bytes, bytes]:
    """(good, bad) of about one size: the smaller class bounds both, for a larger dictionary would win by its size alone."""
    first = _dictionary(min(bad, good, key=lambda x: sum(map(len, x))))
    room = max(256, min(len(first), DICT_BYTES))
    pair = {id(min(bad, good, key=lambda x: sum(map(len, x)))): first}
    return pair.get(id(good)) or _dictionary(good, room), pair.get(id(bad)) or _dictionary(bad, room)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights by Newton's method with halved steps on scaled columns, the first of which is constant. The ridge keeps
    them finite where the classes can be told apart without error; both classes count as they occur."""
    mean, scale = x[:, 1:].mean(axis=0), np.maximum(x[:, 1:].std(axis=0), 1e-6)
    z = np.concatenate([np.ones((len(x), 1)), (x[:, 1:] - mean) / scale], axis=1)
    keep = np.r_[0.0, np.full(x.shape[1] - 1, ridge)]

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + 0.5 * (keep * w * w).sum())

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ (p - y) + keep * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-6), grad)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slopes = w[1:] / scale
    return (float(w[0] - slopes @ mean), *map(float, slopes))


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """Fit on labelled rows whose crc32(doc_id as text) mod folds is not 0: at most SAMPLE_ROWS a class, of each at
    most SAMPLE_CHARS characters. That bounds what reaches the driver.

    Each of FOLDS parts of the sample is measured with dictionaries of the other parts; the calibration is fitted on
    all of these, and the dictionaries that stay are those of the whole sample. Null ids, labels and texts take no
    part; of repeated labels or texts of a document the smallest holds. Without two rows of either class the
    dictionaries are empty and the score is the share of label 1, smoothed by one of each.
    """
    id_text = F.col("doc_id").cast("string")
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.where(F.pmod(F.crc32(id_text.cast("binary")), F.lit(folds)) != 0)
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = known.limit(0)
    for row in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect():  # two rows
        # About four times the limit pass the first test, so that the order below is of a bounded number of rows.
        few = known.where((F.col("quality") == row["quality"]) & (at < min(1.0, 4 * SAMPLE_ROWS / row["n"]) * (1 << 30)))
        chosen = chosen.unionByName(few.orderBy(at, "doc_id").limit(SAMPLE_ROWS))
    # At most 2 x SAMPLE_ROWS ids: a proven bound for the broadcast and, one text an id, for what reaches the driver.
    room = F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))
    part = F.substr("text", (F.pmod(F.xxhash64("doc_id", F.lit(1)), room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    texts = docs.select("doc_id", "text").where("text is not null and text != ''").join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", "quality", part.alias("text")).groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    side: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: hash_id(r["doc_id"])):
        side[r["quality"]].append(r["text"].encode())
    share = (len(side[1]) + 1) / (len(side[0]) + len(side[1]) + 2)
    if min(map(len, side.values())) < 2:
        return Model(b"", b"", 0.0, (float(np.log(share / (1 - share))), 0.0))
    x, y = [], []
    for fold in range(FOLDS):
        rest = {k: [t for i, t in enumerate(v) if i % FOLDS != fold] for k, v in side.items()}
        if min(map(len, rest.values())):
            good, bad = _dictionaries(rest[0], rest[1])
            for k, v in side.items():
                held = [t.decode() for t in v[fold::FOLDS]]
                x.append(differences(held, good, bad))
                y.append(np.full(len(held), float(k)))
    found, label = np.concatenate(x), np.concatenate(y)
    average = float((found[:, 0] / found[:, 1]).mean())
    d = normalised(found, average)
    bends = tuple(float(k) for k in np.unique(np.quantile(d[label == 0], BENDS)))
    good, bad = _dictionaries(side[0], side[1])
    return Model(good, bad, average, _logistic(_curve(d, bends), label), bends)


def hash_id(doc_id: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(doc_id), 42)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= threshold) for the whole text of every row, repeated rows too.

    Columns of these two names that docs has are replaced; all others stay.
    """
    if {"score", "predicted"} & set(docs.columns):
        docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(shared.value.scores(texts.tolist()), index=texts.index, dtype="float64")

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_table(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, repeated rows too; a null doc_id is not held out. Other
    columns of docs, whatever their names, take no part; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(ids: list, held: list, texts: list) -> list:
        scores = shared.value.scores(texts)
        return [ids, held, scores, (scores >= THRESHOLD).astype(int)]

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()}
    return by_batch(docs.select(F.col("doc_id").cast("long"), held.alias("held"), "text"), kinds, "doc_id long, held_out boolean, score double, predicted int", work)

"""Hashed maximum-entropy language model with a class-factored softmax, beside a smoothed unigram base.

Every word that occurs often enough has a place in a tree of three levels, so the vocabulary grows with the corpus, and
with it the width of the softmaxes and the rows of weights. log P(token | before) is the sum of a softmax over classes,
one over a class's parts and one over a part's words: log-linear models on the last word, for classes also on the word
before it (a skip) and on both together, hashed into rows of weights, with the corpus frequencies as default
distribution. Rarer words form a few kinds by their look: a kind is a class, predicted like any other, and a word has
its smoothed share of the kind's count. As context all words of the head stand for themselves. Probabilities sum to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, release, settled

FOLDS, SMOOTH = 10, 0.1
#: The token that ends a document: no word holds a space.
END = " "
#: Words whose counts every worker holds, at most, and their longest: a bound on what is sent. All others are joined.
HEAD, HEAD_BYTES = 1 << 18, 64
#: Occurrences from which a word of the head has a place of its own in the tree; kinds of other words.
MODEL_COUNT, KINDS = 128, 6
#: Rounds of training (each takes its own share of the documents), tokens of an update, learning rate, largest weight.
ROUNDS, UPDATE, RATE, LARGEST = 4, 4096, 0.3, 12.0
#: Tokens of a slice, about: what one task learns from in a round. Slices go by the data alone, never by the cluster.
SLICE_TOKENS = 1 << 20
#: Rows of distinct words that a worker gathers before it adds them up; pieces that weights are summed in.
COUNTED, PIECES = 600_000, 64
#: Lines of a row's gradients that are added layer by layer, at most; the result does not hang on it but for rounding.
LAYERS = 8
_PUNCTUATION, _SYMBOLS = np.zeros(256, bool), np.zeros(256, bool)
_PUNCTUATION[list(b".,:;!?\"')")] = True
_SYMBOLS[list(b"*$&%#|+=<>/\\_-@")] = True


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod FOLDS is 0; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


# --- words ----------------------------------------------------------------------------------------------------------


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in a row, words of each text): lower-cased (A-Z only), cut at ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    sizes = np.add.reduceat(real.to_numpy(zero_copy_only=False).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    return flat.filter(real), sizes


def kinds(found: pa.Array) -> np.ndarray:
    """The kind of each word: ASCII or not, and what its last byte is."""
    if not len(found):
        return np.zeros(0, np.int32)
    found = pa.concat_arrays([found.cast(pa.string())])  # offsets from 0
    ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset + 1 : found.offset + len(found) + 1]
    last = np.frombuffer(found.buffers()[2], np.uint8)[ends - 1]
    ascii_ = pc.string_is_ascii(found).to_numpy(zero_copy_only=False)
    return (np.where(ascii_, 0, 3) + np.where(_PUNCTUATION[last], 1, np.where(_SYMBOLS[last], 2, 0))).astype(np.int32)


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, kind, n) over every whole text of docs (column text), the end counted as a word."""
    arrow_limits(docs.sparkSession)

    def added(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).combine_chunks()
        word = t["word"].combine_chunks() if t.num_rows else pa.array([], pa.string())
        return pa.RecordBatch.from_arrays([word.cast(pa.binary()), pa.array(kinds(word), pa.int32()), pa.concat_arrays(t["n_sum"].chunks) if t.num_rows else pa.array([], pa.int64())], ["word", "kind", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = words(batch.column(0))[0].value_counts()
            held.append(pa.table({"word": pa.concat_arrays([seen.field("values"), pa.array([END])]), "n": pa.concat_arrays([seen.field("counts"), pa.array([batch.num_rows], pa.int64())])}))
            rows += len(seen)
            if rows > COUNTED:
                yield added(held)
                held, rows = [], 0
        if held:
            yield added(held)

    return docs.select("text").mapInArrow(run, "word binary, kind int, n long").groupBy("word", "kind").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """The head of the counts by falling count, how many of its words are in the tree, and totals: tokens, distinct
    words, and by kind of the words outside the tree."""

    head: pa.Array
    counts: np.ndarray
    kinds: np.ndarray
    placed: int
    tokens: int
    distinct: int
    kind_tokens: np.ndarray
    kind_words: np.ndarray

    @property
    def base_log(self) -> float:
        return float(np.log10(self.tokens + SMOOTH * (self.distinct + 1)))

    @property
    def kind_logs(self) -> np.ndarray:
        return np.log10(self.kind_tokens + SMOOTH * (self.kind_words + 1))

    @property
    def side(self) -> int:
        """Classes, parts of a class and words of a part: the least number whose cube holds all placed words."""
        side = max(2, math.floor(round(self.placed ** (1 / 3), 6)))
        return side + (side**3 < self.placed)

    @property
    def start(self) -> int:
        """The id of what comes before a document. Ids: kinds, then the head by falling count, then this."""
        return KINDS + len(self.head)


def lexicon(counts: DataFrame) -> Lexicon:
    """The head is every word of at most HEAD_BYTES whose count reaches a limit that at most HEAD words reach; the
    limit is found on a histogram of about a thousand rows."""
    short = F.octet_length("word") <= HEAD_BYTES
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    histogram = counts.where(short).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    room, least_level = HEAD, 1 << 30
    for row in sorted(histogram, key=lambda r: -r["level"]):
        if row["words"] > room:
            break
        room, least_level = room - row["words"], row["level"]
    in_head = short & (level >= least_level)
    head = counts.where(in_head).select("word", "kind", "n").toArrow().combine_chunks().sort_by([("n", "descending"), ("word", "ascending")])
    n, kind = head["n"].to_numpy(), head["kind"].to_numpy()
    placed = int((n >= MODEL_COUNT).sum())
    kind_tokens, kind_words = np.bincount(kind[placed:], n[placed:], KINDS), np.bincount(kind[placed:], minlength=KINDS).astype(float)
    tokens, distinct = int(n.sum()), len(n)
    for r in counts.where(~in_head).groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        kind_tokens[r["kind"]] += r["n"]
        kind_words[r["kind"]] += r["words"]
        tokens, distinct = tokens + r["n"], distinct + r["words"]
    word = pa.concat_arrays(head["word"].chunks).cast(pa.binary()) if len(n) else pa.array([], pa.binary())
    return Lexicon(word, n, kind.astype(np.int32), placed, tokens, distinct, kind_tokens, kind_words)


# --- documents as ids -----------------------------------------------------------------------------------------------

ENCODED = "row long, doc_id long, held_out boolean, place long, n_tokens long, n_known long, head_log double, other_log double, ids binary, tail array<binary>"


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Every row's ids (int32), what the head's counts give of its scores, and the words outside the head. place is a
    hash of id and text: where the row stands in training, whatever the partitions."""
    arrow_limits(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    names = [c.split()[0] for c in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        size = len(lex.head)
        logs = np.append(np.log10(lex.counts + SMOOTH), 0.0)
        other = np.where(np.arange(size + 1) < lex.placed, 0.0, logs)
        end = pc.index_in(pa.array([END.encode()], pa.binary()), value_set=lex.head)[0].as_py()
        for batch in batches:
            if not batch.num_rows:
                continue
            found, sizes = words(batch.column(4))
            ends = np.cumsum(sizes)
            at = pc.index_in(found.cast(pa.binary()), value_set=lex.head)
            rare = at.is_null()
            at = pc.fill_null(at, size).to_numpy(zero_copy_only=False).astype(np.int64)
            far = found.filter(rare)
            ids = at + KINDS
            is_rare = rare.to_numpy(zero_copy_only=False)
            ids[is_rare] = kinds(far)
            ids = np.insert(ids, ends, KINDS + end if end is not None else 0).astype(np.int32)
            at = np.insert(at, ends, end if end is not None else size)
            sizes = sizes + 1
            starts = np.cumsum(sizes) - sizes
            few = np.add.reduceat(np.insert(is_rare, ends, False).astype(np.int64), starts)
            known = sizes - few - (end is None)
            tails = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(few)]).astype(np.int32)), far.cast(pa.binary()))
            raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * np.concatenate([[0], np.cumsum(sizes)])).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            sums = [pa.array(np.add.reduceat(x[at], starts)) for x in (logs, other)]
            if end is None:  # nothing to learn from: the end is an unknown word
                sums = [pa.array(s.to_numpy() + np.log10(SMOOTH)) for s in sums]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(sizes), pa.array(known), *sums, raw, tails], names)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.xxhash64("doc_id", "text").alias("place"), "text").mapInArrow(run, ENCODED)


# --- the model ------------------------------------------------------------------------------------------------------

_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


class Model:
    def __init__(self, lex: Lexicon, weights: np.ndarray | None = None) -> None:
        s = self.side = lex.side
        self.lex, self.bits = lex, self.row_bits(s)
        n = np.zeros(s**3)
        n[: lex.placed] = lex.counts[: lex.placed]
        self.class_log = self._share(np.concatenate([lex.kind_tokens + SMOOTH, n.reshape(s, -1).sum(axis=1)])[None, :])[0]
        self.part_log = self._share(n.reshape(s * s, s).sum(axis=1).reshape(s, s))
        self.word_log = self._share(n.reshape(s * s, s))
        self.flat = np.zeros(self.n_weights(lex), np.float32) if weights is None else weights.copy()
        self.tables, at = [], 0
        for a, b in self.shapes(lex):
            self.tables.append(self.flat[at : at + a * b].reshape(a, b))
            at += a * b

    @staticmethod
    def row_bits(side: int) -> int:
        """Rows of a table as a power of two: about 64 for each class."""
        return math.ceil(math.log2(64 * side))

    @classmethod
    def shapes(cls, lex: Lexicon) -> list[tuple[int, int]]:
        """Tables of the class factor (last, skip, both), of the part factor and of the word factor (last)."""
        rows, s = 1 << cls.row_bits(lex.side), lex.side
        return [(rows, KINDS + s)] * 3 + [(rows, s)] * 2

    @classmethod
    def n_weights(cls, lex: Lexicon) -> int:
        return sum(a * b for a, b in cls.shapes(lex))

    @staticmethod
    def _share(n: np.ndarray) -> np.ndarray:
        """Logs of shares of the rows' sums. A place without a word keeps no probability that could be missed."""
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(n / np.maximum(n.sum(axis=1, keepdims=True), 1e-9)), -60).astype(np.float32)

    def _hash(self, *parts: np.ndarray) -> np.ndarray:
        mixed = parts[0].astype(np.uint32) * _MIX[0]
        for p, m in zip(parts[1:], _MIX[1:], strict=False):
            mixed = (mixed ^ mixed >> np.uint32(15)) + p.astype(np.uint32) * m
        return ((mixed ^ mixed >> np.uint32(13)) * _MIX[2] >> np.uint32(32 - self.bits)).astype(np.int32)

    def features(self, ids: np.ndarray, starts: np.ndarray) -> tuple:
        """(class, rank in the tree or -1, rows of the class factor, of the part factor and of the word factor) of
        every token of joined documents; the last two only where the rank counts."""
        lex, s = self.lex, self.side
        last, skip = np.empty_like(ids), np.empty_like(ids)
        last[1:], skip[2:] = ids[:-1], ids[:-2]
        skip[: min(2, len(ids))] = lex.start
        last[starts] = skip[starts] = lex.start
        skip[starts[starts + 1 < len(ids)] + 1] = lex.start
        rank = np.where((ids >= KINDS) & (ids < KINDS + lex.placed), ids - KINDS, -1)
        klass = np.where(rank >= 0, KINDS + rank // (s * s), np.where(ids < KINDS, ids, lex.kinds[np.clip(ids - KINDS, 0, max(0, len(lex.kinds) - 1))] if len(lex.kinds) else 0))
        at = np.flatnonzero(rank >= 0)
        r, x = rank[at], last[at]
        part, word = r // (s * s), (r // s) + s  # words of a part have other numbers than parts
        return klass, rank, [self._hash(last), self._hash(skip), self._hash(last, skip)], [self._hash(part, x)], [self._hash(word, x)]

    def _raised(self, tables: list[np.ndarray], rows: list[np.ndarray], default: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raised scores and their sums: weights are bounded (LARGEST), so that no score is too large to be raised."""
        z = tables[0].take(rows[0], axis=0)
        for t, r in zip(tables[1:], rows[1:], strict=True):
            z += t.take(r, axis=0)
        z += default
        np.exp(z, out=z)
        return z, z.sum(axis=1)

    def _p(self, tables: list[np.ndarray], rows: list[np.ndarray], default: np.ndarray) -> np.ndarray:
        z, sums = self._raised(tables, rows, default)
        z *= (1 / sums)[:, None]
        return z

    def _steps(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple]:
        """For each UPDATE tokens: where they are, then for each factor its tables' numbers, rows, probabilities, what
        came and where."""
        s = self.side
        klass, rank, near, mid, far = self.features(ids, starts)
        inside = np.concatenate([[0], np.cumsum(rank >= 0)])
        for k in range(0, len(ids), UPDATE):
            a, b = k, min(k + UPDATE, len(ids))
            i, j = int(inside[a]), int(inside[b])
            at = np.flatnonzero(rank[a:b] >= 0)
            r = rank[a:b][at]
            rows = ([x[a:b] for x in near], [x[i:j] for x in mid], [x[i:j] for x in far])
            yield a, b, at, rows, (klass[a:b], r // s % s, r % s), (self.class_log, self.part_log[r // (s * s)], self.word_log[r // s])

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of P(class) and, for placed words, of P(part | class) and P(word | part), for every token; its class."""
        out, classes = np.zeros(len(ids)), np.empty(len(ids), np.int64)
        for a, b, at, rows, came, default in self._steps(ids, starts):
            classes[a:b] = came[0]
            for where, first, r, c, d in zip((np.arange(b - a), at, at), (0, 3, 4), rows, came, default, strict=True):
                if len(c):
                    z, sums = self._raised(self.tables[first : first + len(r)], r, d)
                    out[a + where] += np.log10(np.maximum(z[np.arange(len(c)), c] / sums, 1e-30))
        return out, classes

    def learn(self, ids: np.ndarray, starts: np.ndarray) -> None:
        """One pass of gradient steps over joined documents, each over UPDATE tokens; steps shrink as a weight's
        gradients add up."""
        squares = [np.zeros_like(t) for t in self.tables]
        for _, _, _, rows, came, default in self._steps(ids, starts):
            for first, r, c, d in zip((0, 3, 4), rows, came, default, strict=True):
                if len(c):
                    g = self._p(self.tables[first : first + len(r)], r, d)
                    g[np.arange(len(c)), c] -= 1
                    for k, x in enumerate(r):
                        self._step(self.tables[first + k], squares[first + k], x, g)
        np.clip(self.flat, -LARGEST, LARGEST, out=self.flat)

    @staticmethod
    def _step(table: np.ndarray, square: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        where, total = _row_sums(rows, grad)
        s = square.take(where, axis=0)
        s += total * total
        square[where] = s
        s += 1
        np.sqrt(s, out=s)
        total *= RATE
        total /= s
        table[where] -= total


def _row_sums(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows (fewer than 65,536, as are their numbers), most frequent first, and the sum of grad over each.

    Whole lines of grad are added: one after the other for a row that occurs over LAYERS times, else the second lines
    of all rows at once, then the third ones, and so on.
    """
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ordered = rows[order]
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(cuts, append=len(rows))
    by = np.argsort((len(rows) - counts).astype(np.uint16), kind="stable")
    cuts, counts = cuts[by], counts[by]
    total = grad.take(order[cuts], axis=0)
    often = int((counts > LAYERS).sum())
    for k in range(often):
        total[k] = grad.take(order[cuts[k] : cuts[k] + counts[k]], axis=0).sum(axis=0)
    for k in range(1, LAYERS):
        upto = int((counts > k).sum())
        total[often:upto] += grad.take(order[cuts[often:upto] + k], axis=0)
    return ordered[cuts], total


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column of documents in a row, and where each begins."""
    raw = column.to_pylist()
    sizes = np.array([len(x) // 4 for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.int32), np.cumsum(sizes) - sizes


def train(encoded: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by iterated averaging: in each round every slice starts from the shared weights, takes gradient steps
    over its documents and hands back how the weights moved; moves are averaged by tokens.

    Every training document is in one slice of one round. Slices, their documents and the order of these follow from
    ids and texts, so the weights do not depend on partitions or cluster. A slice is bounded, so a lost task costs
    little; moves are half-precision and summed by pieces of the weights, in the order of slices, on the executors.
    """
    spark = encoded.sparkSession
    sc = spark.sparkContext
    arrow_limits(spark)
    n = Model.n_weights(lex)
    weights, piece = np.zeros(n, np.float32), -(-n // PIECES)
    slices = max(1, -(-lex.tokens // (rounds * SLICE_TOKENS)))
    number = F.pmod("place", F.lit(rounds * slices))
    for r in range(rounds):
        shared = sc.broadcast((lex, weights))

        def moved(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            held: list[pa.Array] = []
            current = None

            def learned() -> Iterator[pa.RecordBatch]:
                lex, before = shared.value
                model = Model(lex, before)
                ids, starts = _joined(pa.concat_arrays(held))
                model.learn(ids, starts)
                move = (model.flat - before).astype(np.float16)
                for k in range(PIECES):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([current], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([move[k * piece : (k + 1) * piece].tobytes()], pa.binary())], ["piece", "slice", "tokens", "move"])

            for batch in batches:
                own = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b > a:
                        if held and own[a] != current:
                            yield from learned()
                            held = []
                        current = int(own[a])
                        held.append(batch.column(1).slice(a, b - a))
            if held:
                yield from learned()

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for k, _, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    move = np.frombuffer(raw, np.float16).astype(np.float64) * n
                    if k in total:
                        total[k][0] += n
                        total[k][1] += move
                    else:
                        total[k] = [n, move]
            for k, (n, move) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(move / n).astype(np.float32).tobytes()], pa.binary())], ["piece", "move"])

        part = encoded.where(~F.col("held_out")).select(number.alias("slice"), "place", "ids").where(F.col("slice") % rounds == r)
        dealt = part.repartition(4 * slices, "slice").sortWithinPartitions("slice", "place").select("slice", "ids")
        moves = dealt.mapInArrow(moved, "piece int, slice long, tokens long, move binary").repartition(PIECES, "piece").sortWithinPartitions("piece", "slice")
        for row in moves.mapInArrow(summed, "piece int, move binary").collect():  # PIECES rows: the weights once, whatever the data
            k = row["piece"] * piece
            weights[k : k + piece] += np.frombuffer(row["move"], np.float32)
        shared.unpersist()
    return weights


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Null and empty texts hold the end alone; repeated rows are scored each (and learned from each); with no row to
    learn from, counts are zero and all mass is unknown's. Both scores are log10 probabilities of the whole text, and
    neither depends on how the rows are partitioned. An empty table gives an empty one; other columns take no part.
    """
    docs = docs.select("doc_id", "text")
    counts = settled(count_words(docs.where(~held_out(F.col("doc_id")))), "counts")
    lex = lexicon(counts)
    encoded = settled(encode(docs, lex), "encoded")
    weights = train(encoded, lex, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((lex, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, weights = shared.value
        model, kind_logs = Model(lex, weights), lex.kind_logs
        for batch in batches:
            if batch.num_rows:
                ids, starts = _joined(batch.column(6))
                each, klass = model.log10(ids, starts)
                other = klass < KINDS
                each[other] -= kind_logs[klass[other]]
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(np.add.reduceat(each, starts))], ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "part"])

    slim = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", F.struct("head_log", "other_log").alias("logs"), "ids")
    scored = slim.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs struct<head_log:double,other_log:double>, part double")
    rare = encoded.where(F.size("tail") > 0).select("row", F.explode("tail").alias("word"))
    found = rare.join(counts.select("word", "n"), "word", "left")
    tails = settled(found.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("tail_log"), F.count("n").alias("tail_known")), "tails")
    release(counts)
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return scored.join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("logs.head_log") + tail_log - F.col("n_tokens") * F.lit(lex.base_log)).alias("base_score"), (F.col("part") + F.col("logs.other_log") + tail_log).alias("score"),
    )

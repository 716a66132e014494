"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to a 23-bit word. The perfect
binary Golay code has a codeword within 3 bits of every word; a word's keys are all codewords within 4 bits of it:
one or six. Two words that differ in at most 2 bits share a key, for the codeword next to a word halfway between them
is within 4 bits of both. Pigeonhole over 4 differing bits: either some segment is equal and another differs in at
most 2 bits (a table for each ordered pair: equal bits + a Golay key), or every segment differs in 1 or 2 bits (a
table on the Golay keys of the first two). So every link meets in some bucket; buckets are verified bit by bit.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, by_batch, release, settled

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Bits of the three segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: Fingerprints of a bucket that one task compares. Larger buckets are divided by the bits that they leave open, and
#: what is still larger is cut into tiles of two such slices.
SLICE = 2048
#: The generator polynomial of the binary Golay code (23, 12, 7): x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
NEAR = 4
_CHUNK = 1 << 15


# --- fingerprints ---------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of a whole text: a bit is 1 if set in over half of the shingles' hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, SEED)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
    starts, ends = [0, *(i + 1 for i in spaces)], [*spaces, len(line)]
    n = len(words) - size + 1
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[k : min(n, k + _CHUNK)], ends[k + size - 1 : min(n, k + _CHUNK) + size - 1], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, fp long) for every row; fp holds the 64 bits as a signed number. Null and blank texts have 0."""

    def work(keys: list, texts: list) -> list:
        return [keys, np.array([fingerprint(x, size) for x in texts], np.uint64).view(np.int64)]

    return by_batch(docs.select(F.col(key).cast("long"), text), {key: pa.int64(), "fp": pa.int64()}, f"{key} long, fp long", work)


# --- Golay keys -----------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes of a word: the codewords within NEAR bits of it, as the words to add, padded with
    the first; and their number."""
    syndromes = np.array([_syndrome(1 << i) for i in range(23)])
    leaders: list[list[int]] = [[] for _ in range(2048)]

    def grow(start: int, left: int, word: int, syndrome: int) -> None:
        leaders[syndrome].append(word)
        if left:
            for i in range(start, 23):
                grow(i + 1, left - 1, word | 1 << i, syndrome ^ int(syndromes[i]))

    grow(0, NEAR, 0, 0)
    width = max(map(len, leaders))
    table = np.array([x + [x[0]] * (width - len(x)) for x in leaders], np.uint32)
    return table, np.array([len(x) for x in leaders])


def _syndrome(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@functools.lru_cache(maxsize=1)
def _syndrome_table() -> np.ndarray:
    """Syndromes of the upper 12 bits alone: the syndrome of a word is that of its upper bits, xor its lower 11."""
    return np.array([_syndrome(i << 11) for i in range(1 << 12)], np.uint32)


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: an (n, 6) array of 12-bit codeword indices and the number of them that count in each row."""
    table, count = golay_tables()
    syndrome = _syndrome_table()[words >> 11] ^ (words & 0x7FF)
    return (words[:, None] ^ table[syndrome]) >> 11, count[syndrome]


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, bucket key) of every bucket that uint64 fingerprints fall into."""
    segments, shift = [], 0
    for bits in SEGMENTS:
        segments.append((fps >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1))
        shift += bits
    coded = [golay_keys(s.astype(np.uint32)) for s in segments]
    at, keys = [], []
    index = np.arange(len(fps))
    number = 0
    for i, exact in enumerate(segments):
        for j, (codes, count) in enumerate(coded):
            if i != j:
                number += 1
                some = np.arange(codes.shape[1]) < count[:, None]
                at.append(np.broadcast_to(index[:, None], codes.shape)[some])
                keys.append(((number << 40) | exact[:, None] << 12 | codes.astype(np.int64))[some])
    (a, n), (b, m) = coded[0], coded[1]
    pairs = a[:, :, None].astype(np.int64) << 12 | b[:, None, :].astype(np.int64)
    some = (np.arange(a.shape[1]) < n[:, None])[:, :, None] & (np.arange(b.shape[1]) < m[:, None])[:, None, :]
    at.append(np.broadcast_to(index[:, None, None], pairs.shape)[some])
    keys.append(pairs[some])
    return np.concatenate(at), np.concatenate(keys)


# --- links ----------------------------------------------------------------------------------------------------------


def _roots(fps: np.ndarray, rows: np.ndarray, distance: int) -> np.ndarray:
    """Components of one bucket: for each fingerprint the index of the first one it is linked to through others.

    Each fingerprint of `rows` is compared with all of fps; the frontier grows from the first not yet reached.
    """
    n = len(fps)
    root = np.full(n, -1)
    own = np.zeros(n, bool)
    own[rows] = True
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first], stack = first, [first]
        while stack:
            p = stack.pop()
            open_ = np.flatnonzero(root < 0)
            if not len(open_):
                return root
            near = open_[np.bitwise_count(fps[open_] ^ fps[p]) <= distance]
            if not own[p]:
                near = near[own[near]]
            root[near] = first
            stack += near.tolist()
    return root


def _forest(fps: np.ndarray, left: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(smaller, larger) links that join the same fingerprints as all links do: between the first `left` and the rest,
    and within them where there is no rest. At most one a fingerprint."""
    rows = np.arange(left)
    root = _roots(fps, rows, distance)
    loose = np.flatnonzero(root != np.arange(len(fps)))
    return fps[root[loose]], fps[loose]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column fp that have the components of all pairs at `distance`
    bits or fewer (4 at most, as the keys promise).

    Buckets are counted before any is gathered. Those of one are dropped, those up to SLICE gathered; each gives a
    spanning forest, never all of its pairs. No larger one meets in a task, and none is capped.
    """
    if distance > DISTANCE:
        raise ValueError("the keys find links of at most 4 bits")
    arrow_limits(distinct.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fps = batch.column(0).to_numpy().view(np.uint64)
                at, keys = bucket_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at].view(np.int64))], ["bucket", "fp"])

    # A fingerprint makes about 60 keys: few small input files must not mean few tasks.
    shuffles = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select("fp").repartition(shuffles).mapInArrow(keyed, "bucket long, fp long")
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    hot = settled(counts.where(F.col("n") > SLICE), "hot")
    if hot.limit(1).count():
        divided = settled(_divided(rows.join(hot.select("bucket"), "bucket", "left_semi"), distance), "divided")
        still = settled(divided.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE), "still")
        small = rows.join(hot.select("bucket"), "bucket", "left_anti").unionByName(divided.join(still.select("bucket"), "bucket", "left_anti"))
        gathered = _gathered(small).unionByName(_tiled(divided.join(still, "bucket")))
    else:
        gathered = _gathered(rows)

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            lengths, others = pc.list_value_length(batch.column(0)), pc.list_value_length(batch.column(1))
            two = pc.and_(pc.equal(lengths, 2), pc.equal(others, 0))
            pairs = batch.filter(two)
            if pairs.num_rows:  # most buckets hold two fingerprints: all of them at once
                x = pairs.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
                hit = np.bitwise_count((x[:, 0] ^ x[:, 1]).astype(np.uint64)) <= distance
                found.append((x[hit, 0], x[hit, 1]))
            rest = batch.filter(pc.invert(two))
            for xs, ys in zip(rest.column(0), rest.column(1), strict=True):
                own, far = (z.values.to_numpy(zero_copy_only=False).view(np.uint64) for z in (xs, ys))
                a, b = _forest(np.concatenate([np.sort(own), np.sort(far)]), len(own), distance)
                found.append((a.view(np.int64), b.view(np.int64)))
            if found:
                a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return gathered.repartition(shuffles).mapInArrow(forests, "a long, b long").distinct()


def _gathered(rows: DataFrame) -> DataFrame:
    """(xs, ys) of the buckets with two members or more: all of them, and none to compare them with but themselves."""
    return rows.groupBy("bucket").agg(F.collect_list("fp").alias("xs")).where(F.size("xs") > 1).select("xs", F.array().cast("array<long>").alias("ys"))


def _divided(rows: DataFrame, distance: int) -> DataFrame:
    """Hot buckets' rows (bucket, fp) in smaller buckets: the bits that a bucket's exact segment does not fix are cut
    into distance + 1 pieces, of which a link leaves one unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            table = bucket >> 40
            for exact in (-1, *range(len(SEGMENTS))):  # the table on keys alone fixes no segment
                at = np.flatnonzero(np.where(table > 0, (table - 1) // 2, -1) == exact)
                if not len(at):
                    continue
                rest, bits, shift = np.zeros(len(at), np.uint64), 0, 0
                for i, size in enumerate(SEGMENTS):
                    if i != exact:
                        rest |= (fps[at] >> np.uint64(shift) & np.uint64((1 << size) - 1)) << np.uint64(bits)
                        bits += size
                    shift += size
                cuts = [bits * k // (distance + 1) for k in range(distance + 2)]
                for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    piece = (rest >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array((piece << 3 | k)), pa.array(fps[at].view(np.int64))], ["bucket", "piece", "fp"])

    return rows.mapInArrow(run, "bucket long, piece long, fp long").select(F.xxhash64("bucket", "piece").alias("bucket"), "fp")


def _tiled(rows: DataFrame) -> DataFrame:
    """(xs, ys) of the tiles of two slices that buckets (bucket, n, fp) over SLICE are cut into: xs against xs and ys."""
    parts = F.ceil(F.col("n") / float(SLICE)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    placed = rows.select("bucket", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("met"))
    tiles = placed.select("bucket", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), (F.col("own") <= F.col("met")).alias("first"), "fp")
    sides = (F.collect_list(F.when(F.col("first") == side, F.col("fp"))).alias(name) for side, name in ((True, "xs"), (False, "ys")))
    return tiles.groupBy("bucket", "low", "high").agg(*sides).select("xs", "ys")


# --- components -----------------------------------------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable over the links (a, b), for every node with a link.

    Alternating large-star and small-star rounds; each is written to the shared folder, so the lineage stays short and
    a lost executor costs one round. Hot nodes are aggregated before they are shuffled. Ends when the links are stars.
    """
    pairs = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"), "links")
    state = None
    for _ in range(most_rounds):
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
        large = _large_star(pairs)
        release(pairs)
        pairs = _small_star(large)
        release(large)
    raise RuntimeError("components did not settle")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = settled(both.groupBy("u").agg(F.min("v").alias("low")), "least")  # settled: then Spark can split a hot node's rows in the join
    joined = both.join(least, "u").where("v > u")
    out = settled(joined.select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct(), "links")
    release(least)
    return out


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. pairs: u > v."""
    least = settled(pairs.groupBy("u").agg(F.min("v").alias("low")), "least")
    joined = pairs.join(least, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    out = settled(joined.unionByName(least.select("u", F.col("low").alias("v"))).distinct(), "links")
    release(least)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(key, fp, component_id) for every row: component_id is the smallest key reachable over links of near fingerprints.

    Equal fingerprints are linked without being compared. Rows with null keys are kept and never name a component
    that has other keys; repeated rows are kept each. An empty table gives an empty one.
    """
    prints = settled(fingerprints(docs, key, text, size), "fingerprints")
    owners = settled(prints.groupBy("fp").agg(F.min(key).alias("first")), "owners")
    found = components(links(owners, distance))
    # Only fingerprints with a link take part in a component; all others keep their own smallest key.
    rooted = settled(owners.join(found.withColumnRenamed("node", "fp"), "fp", "inner"), "rooted")
    low = rooted.groupBy("root").agg(F.min("first").alias("low"))
    named = rooted.join(low, "root").select("fp", "low")
    ids = owners.join(named, "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id"))
    return prints.join(ids, "fp").select(key, "fp", "component_id")


def as_hex(fp: Column) -> Column:
    """16 lowercase hex digits of a signed 64-bit number."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

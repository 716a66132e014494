"""Near copies by words: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two places. SimHash fingerprints over the same shingles, joined through their Golay keys, give
the pairs within 4 bits (simhash.py); a pair at 0.8 differs in 10 of 64 bits on average, which no number of Golay
tables reaches at a bearable cost. So MinHash gives the rest: BANDS keys of ROWS minima each, by which a pair at 0.8
shares no key with probability (1 - 0.8^ROWS)^BANDS = 3 in a million. A candidate counts only if its whole sets of
shingles say so. Texts of the same words are one text before anything is compared.

Pairs are never rows: a bucket's members meet in one task, tile by tile if they are many, and leave as the links of a
spanning forest. First only sketches meet, to see who needs the exact sets; then the sets of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import BITS, ROW_BITS, arrow_limits, bitmap, by_batch, release, settled

#: Words of a shingle; the least similarity as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
BANDS, ROWS = 24, 4
#: Equal minima of BANDS * ROWS from which a pair's sets are compared. A pair at 0.8 has 77 on average and fewer than
#: this in 5 of a million cases.
LIKELY = 58
#: Members of a bucket that meet in a task, and bytes of sets; beyond either a bucket is cut into tiles of two slices.
SLICE, SLICE_BYTES = 512, 16 << 20
_CHUNK = 1 << 12
_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_FLIPS, _FACTORS = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)
#: The slice number of a candidate pair of fingerprints: its two members are compared whatever their sketches say.
PAIR = -1


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # as fingerprints have them: only A-Z and ASCII white space count


def identity(text: str | None) -> bytes:
    """Equal for texts of the same words."""
    return xxhash.xxh3_128_digest(b" ".join(words(text)))


def shingles(text: str | None) -> frozenset[bytes]:
    """All runs of SHINGLE words; a shorter text is one shingle, and one without words has none."""
    w = words(text)
    return frozenset(b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else frozenset()


def hashes(text: str | None) -> np.ndarray:
    """The set of shingles as sorted 64-bit hashes."""
    return np.sort(np.frombuffer(b"".join([xxhash.xxh64_digest(x) for x in shingles(text)]), np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes have the least similarity. Empty sets have none."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * SIMILAR[1] < SIMILAR[0] * len(b) or not len(a):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both * SIMILAR[1] >= SIMILAR[0] * (len(a) + len(b) - both)


def sketch(text: str | None) -> tuple[list[int], bytes]:
    """The text's BANDS keys; and four bytes of each key, then the last byte of each minimum. None without words."""
    every = hashes(text)
    if not len(every):
        return [], b""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(every), _CHUNK):
        least = np.minimum(least, ((every[k : k + _CHUNK] ^ _FLIPS) * _FACTORS).min(axis=1))
    raw, step = least.tobytes(), 8 * ROWS
    keys = np.array([xxhash.xxh64_intdigest(raw[i * step : (i + 1) * step], i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()
    return keys, np.array(keys, np.int64).astype(np.uint32).tobytes() + least.astype(np.uint8).tobytes()


def candidates(band: int, low: int, keys: np.ndarray, sigs: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, equal minima) of the pairs of a tile that need their sets compared. A pair that shares several buckets
    counts in the band of the first of them; members with equal values in a column of apart do not meet, where it has two."""
    n, found = len(keys), []
    split = [c for c in apart.T if (c != c[0]).any()]
    for i in range(n - 1):
        rest = slice(i + 1, n)
        equal = (sigs[rest] == sigs[i]).sum(axis=1)
        if low == PAIR:
            ok = np.ones(n - i - 1, bool)
        else:
            ok = equal >= LIKELY
            if not ok.any():
                continue
            ok &= (keys[rest] == keys[i]).argmax(axis=1) == band
        for c in split:
            ok &= c[rest] != c[i]
        j = np.flatnonzero(ok)
        found.append((np.full(len(j), i), j + i + 1, equal[j]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _members(column: pa.ListArray) -> Iterator[tuple]:
    """For each tile of a batch: its prints, keys, signatures and slices, and its sets if it has them."""
    marks = column.offsets.to_pylist()
    all_ = column.flatten()
    base = marks[0]
    prints = all_.field("print").to_pylist()
    raw = np.frombuffer(b"".join(all_.field("sig").to_pylist()), np.uint8).reshape(-1, (4 + ROWS) * BANDS)
    keys, sigs = np.ascontiguousarray(raw[:, : 4 * BANDS]).view(np.uint32), raw[:, 4 * BANDS :]
    apart = np.stack([all_.field(c).to_numpy(zero_copy_only=False) for c in ("side", "half")], axis=1)
    sets = all_.field("set").to_pylist() if all_.type.get_field_index("set") >= 0 else None
    for a, b in zip(marks[:-1], marks[1:], strict=True):
        s = slice(a - base, b - base)
        yield prints[s], keys[s], sigs[s], apart[s], sets[s] if sets else None


_TILE = ["bucket", "band", "low", "high"]
_SKETCHED = "bucket long, band int, low int, high int, side int, print binary, sig binary"


def _involved(tiles: DataFrame) -> DataFrame:
    """The members (_SKETCHED) of some candidate pair of their tile."""
    arrow_limits(tiles.sparkSession)
    names = [c.split()[0] for c in _SKETCHED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column, picked, whose = batch.column(4), [], []
            base = column.offsets[0].as_py()
            places = zip(*(batch.column(k).to_pylist() for k in (1, 2)), column.offsets.to_pylist(), _members(column), strict=False)
            for row, (band, low, at, (_, keys, sigs, apart, _)) in enumerate(places):
                i, j, _ = candidates(band, low, keys, sigs, apart)
                some = np.unique(np.concatenate([i, j]))
                picked.append(some + at - base)
                whose.append(np.full(len(some), row))
            at, rows = np.concatenate(picked), pa.array(np.concatenate(whose))
            chosen = column.flatten().take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(4)), *(chosen.field(c) for c in names[4:])], names)

    return tiles.mapInArrow(run, _SKETCHED)


def _linked(tiles: DataFrame) -> DataFrame:
    """(a, b): for each tile a forest of its similar pairs, most alike pairs first; at most one link a member."""
    arrow_limits(tiles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple[bytes, bytes]] = []
            for band, low, (prints, keys, sigs, apart, sets) in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), _members(batch.column(4)), strict=True):
                i, j, equal = candidates(band, low, keys, sigs, apart)
                whole = [np.frombuffer(s, np.uint64) for s in sets]
                root = list(range(len(prints)))
                for k in np.argsort(-equal, kind="stable").tolist():
                    p, q = int(i[k]), int(j[k])
                    while root[p] != p:
                        root[p] = p = root[root[p]]
                    while root[q] != q:
                        root[q] = q = root[root[q]]
                    if p != q and similar(whole[i[k]], whole[j[k]]):
                        root[max(p, q)] = min(p, q)
                        out.append((prints[i[k]], prints[j[k]]))
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.binary()), pa.array([max(x) for x in out], pa.binary())], ["a", "b"])

    return tiles.mapInArrow(run, "a binary, b binary")


def _gathered(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row a tile with at least two members."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("members")).where(F.size("members") > 1).select(*_TILE, "members")


def _sliced(parts: Column, salt: int) -> tuple[Column, Column]:
    """(slice of a print, the slices it meets) for a number of slices."""
    own = F.pmod(F.xxhash64("print", F.lit(salt)), parts).cast("int")
    return own, F.sequence(F.lit(0), (parts - 1).cast("int"))


def links(owners: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): verified links between prints that have the components of all similar candidate pairs.

    owners: (print, keys, sig, fp). A bucket over SLICE members, or with over SLICE_BYTES of sets, is cut into tiles.
    """
    keyed = owners.select("print", F.posexplode("keys").alias("band", "bucket"))
    counts = settled(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    members = settled(keyed.join(counts, "bucket").select("bucket", "band", "n", "print"), "members")
    parts = F.ceil(F.col("n") / float(SLICE))
    own, met = _sliced(parts, 1)
    placed = members.join(owners.select("print", "sig"), "print").withColumn("own", own).withColumn("met", F.explode(met))
    tiled = placed.select("bucket", "band", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), F.when(F.col("own") > F.col("met"), 1).otherwise(0).alias("side"), F.lit(0).alias("half"), "print", "sig")
    banded = _involved(_gathered(tiled, _TILE, ["side", "half", "print", "sig"]))
    needed = settled(banded.unionByName(_by_fingerprint(owners)), "needed")
    release(counts, members)

    sets = settled(_sets(docs, settled(needed.select("print").distinct(), "wanted"), text), "sets")
    sizes = needed.join(sets.select("print", F.length("set").alias("bytes")), "print").groupBy(*_TILE).agg(F.ceil(F.sum("bytes") / float(SLICE_BYTES)).alias("parts"))
    # Few tiles are too large for one task; all others need no look at their size.
    large = settled(sizes.where("parts > 1"), "large")
    own, met = _sliced(F.coalesce("parts", F.lit(1)), 2)
    full = needed.join(sets, "print")
    full = full.join(large, _TILE, "left") if large.limit(1).count() else full.withColumn("parts", F.lit(1))
    full = full.withColumn("own", own).withColumn("met", F.explode(met))
    full = full.withColumn("a", F.least("own", "met")).withColumn("b", F.greatest("own", "met")).withColumn("half", F.when(F.col("own") > F.col("met"), 1).otherwise(0))
    found = settled(_linked(_gathered(full, [*_TILE, "a", "b"], ["side", "half", "print", "sig", "set"])).distinct(), "found")
    release(needed, sets)
    return found


def _by_fingerprint(owners: DataFrame) -> DataFrame:
    """Members (_SKETCHED) of the candidate pairs of fingerprints: each print with the least of its fingerprint, and
    the least ones of two fingerprints that are within simhash.DISTANCE bits."""
    some = owners.where(F.size("keys") > 0)
    reps = settled(some.groupBy("fp").agg(F.min("print").alias("rep")), "reps")
    alike = some.select("print", "fp").join(reps, "fp").where("print != rep").select(F.col("rep").alias("x"), F.col("print").alias("y"))
    near = simhash.links(reps)
    apart = near.join(reps.toDF("a", "x"), "a").join(reps.toDF("b", "y"), "b").select("x", "y")
    pairs = settled(alike.unionByName(apart), "pairs").select(F.xxhash64("x", "y").alias("bucket"), F.explode(F.array("x", "y")).alias("print"))
    return pairs.join(owners.select("print", "sig"), "print").select("bucket", F.lit(PAIR).alias("band"), F.lit(PAIR).alias("low"), F.lit(PAIR).alias("high"), F.lit(0).alias("side"), "print", "sig")


def _slot(print_: bytes) -> int:
    return int.from_bytes(print_[:8], "little") % BITS


def _sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(print, set) of the wanted prints: the sorted hashes of the whole text's shingles. A bitmap of bounded size
    keeps most other texts from being moved."""
    slots = by_batch(wanted.select("print"), {"slot": pa.int64()}, "slot long", lambda prints: [[_slot(x) for x in prints]])
    bits = np.zeros(BITS // 8, np.uint8)
    for r in bitmap(slots).collect():
        bits[r["chunk"] * ROW_BITS // 8 :][: ROW_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x in batch.column(0).to_pylist():
                print_ = identity(x)
                slot = _slot(print_)
                if shared.value[slot >> 3] >> (slot & 7) & 1:
                    made.append((print_, hashes(x).tobytes()))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.binary()) for k in (0, 1)], ["print", "set"])

    held = docs.select(text).mapInArrow(run, "print binary, set binary")
    return held.join(wanted, "print", "left_semi").groupBy("print").agg(F.first("set").alias("set"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print, group, component_id) for every row: group is the least print reachable over links of near copies,
    component_id the smallest key in the group.

    Null and blank texts are one text without words and have no near copies but each other. Rows with null keys are
    kept and never name a group that has other keys; repeated rows are kept each. Other columns take no part; an empty
    table gives an empty one.
    """

    def work(keys: list, texts: list) -> list:
        made = [sketch(x) for x in texts]
        prints = np.array([simhash.fingerprint(x, SHINGLE) for x in texts], np.uint64).view(np.int64)
        return [keys, [identity(x) for x in texts], [m[0] for m in made], [m[1] for m in made], prints]

    columns = {key: pa.int64(), "print": pa.binary(), "keys": pa.list_(pa.int64()), "sig": pa.binary(), "fp": pa.int64()}
    made = settled(by_batch(docs.select(F.col(key).cast("long"), text), columns, f"{key} long, print binary, keys array<long>, sig binary, fp long", work), "made")
    owners = settled(made.groupBy("print").agg(F.min(key).alias("first"), F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.first("fp").alias("fp")), "owners")
    prints = settled(made.select(key, "print"), "prints")
    release(made)
    found = simhash.components(links(owners, docs, text)).withColumnRenamed("node", "print")
    rooted = owners.select("print", "first").join(found, "print", "left").select("print", "first", F.coalesce("root", "print").alias("group"))
    rooted = settled(rooted, "rooted")
    release(owners)
    low = rooted.groupBy("group").agg(F.min("first").alias("component_id"))
    ids = rooted.join(low, "group").select("print", "group", "component_id")
    return prints.join(ids, "print").select(key, "print", "group", "component_id")

"""Matroska media columns: a small muxer and a parser into packet tables.

The parser reads EBML elements with variable-length ids and sizes (unknown sizes too), clusters, SimpleBlocks and
BlockGroups with all four lacings, and cues. A packet row holds its track, timestamp, flags and byte range.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, by_batch

# Element ids of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TAGS, SEEK_HEAD, VOID, CRC32 = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x1254C367, 0x114D9B74, 0xEC, 0xBF
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: A frame holds FRAME 8-bit samples at RATE a second: 4 ms. A block laces up to LACED frames, a cluster holds BLOCKS.
FRAME, RATE, LACED, BLOCKS = 192, 48_000, 8, 64
_MS = FRAME * 1000 // RATE


# --- writing --------------------------------------------------------------------------------------------------------


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def _size(n: int, width: int = 0) -> bytes:
    """A variable-length size; all ones is kept for "unknown"."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, *content: bytes) -> bytes:
    body = b"".join(content)
    return _id(number) + _size(len(body)) + body


def _uint(number: int, n: int) -> bytes:
    return element(number, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def mux(payload: bytes) -> bytes:
    """A Matroska file with one track of unsigned 8-bit PCM: payload in frames of FRAME samples, losslessly.

    payload's length is a positive multiple of FRAME. Blocks lace their equal frames with fixed-size lacing.
    """
    import struct

    n = len(payload) // FRAME
    head = element(EBML, _uint(EBML_VERSION, 1), _uint(EBML_READ_VERSION, 1), _uint(EBML_MAX_ID, 4), _uint(EBML_MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), _uint(DOC_TYPE_VERSION, 4), _uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000), element(DURATION, struct.pack(">d", float(n * _MS))), element(MUXING_APP, b"sparkweft"), element(WRITING_APP, b"sparkweft"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(RATE))), _uint(CHANNELS, 1), _uint(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _uint(FLAG_LACING, 1), element(CODEC_ID, b"A_PCM/INT/LIT"), _uint(DEFAULT_DURATION, _MS * 1_000_000), audio)
    tracks = element(TRACKS, track)
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, n, LACED * BLOCKS):
        blocks = [_uint(CLUSTER_TIMESTAMP, c * _MS)]
        for b in range(c, min(n, c + LACED * BLOCKS), LACED):
            k = min(LACED, n - b, c + LACED * BLOCKS - b)
            lacing = b"\x84" + bytes([k - 1]) if k > 1 else b"\x80"
            blocks.append(element(SIMPLE_BLOCK, b"\x81", ((b - c) * _MS).to_bytes(2, "big", signed=True), lacing, payload[b * FRAME : (b + k) * FRAME]))
        cluster = element(CLUSTER, *blocks)
        cues.append(element(CUE_POINT, _uint(CUE_TIME, c * _MS), element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1), _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, *parts, element(CUES, *cues))


# --- parsing --------------------------------------------------------------------------------------------------------


class MatroskaError(ValueError):
    """The bytes are not a Matroska file that this parser can follow."""


@dataclass
class Media:
    """packets: (track, timestamp in scale units, start, length, keyframe, lacing) in file order; clusters: (timestamp,
    position in the segment), as cues (time, track, position) name them."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    blocks: int = 0


def _vint(data: bytes, at: int, end: int, keep: bool) -> tuple[int, int]:
    """A variable-length number at `at` and where it ends; keep: with its marker, as ids have it. -1: all ones."""
    if at >= end or not data[at]:
        raise MatroskaError(f"no number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise MatroskaError(f"number at byte {at} is cut off")
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in data[at:end]; one of unknown size runs to the next of its parent's level."""
    while at < end:
        number, at = _vint(data, at, end, True)
        size, at = _vint(data, at, end, False)
        stop = at + size if size >= 0 else _unknown_end(data, at, end, number)
        if stop > end:
            raise MatroskaError(f"element {number:x} at byte {at} is cut off")
        yield number, at, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int, number: int) -> int:
    """Segments and clusters may have an unknown size: a cluster ends at the next element of the segment's level."""
    level_1 = {INFO, TRACKS, CLUSTER, CUES, TAGS, SEEK_HEAD}
    if number == SEGMENT:
        return end
    if number != CLUSTER:
        raise MatroskaError(f"element {number:x} has no size")
    while at < end:
        inner, body = _vint(data, at, end, True)
        if inner in level_1:
            return at
        size, body = _vint(data, body, end, False)
        if size < 0:
            raise MatroskaError(f"element {inner:x} has no size")
        at = body + size
    return end


def _number(data: bytes) -> int:
    return int.from_bytes(data, "big")


def _real(data: bytes) -> float:
    import struct

    return struct.unpack(">d" if len(data) == 8 else ">f", data)[0] if data else 0.0


def parse(data: bytes) -> Media:
    """The tracks, packets and cues of a file. Elements it does not know are passed over."""
    media = Media()
    for number, a, b in elements(data, 0, len(data)):
        if number == EBML:
            media.doc_type = next((data[x:y].rstrip(b"\0").decode("ascii", "replace") for n, x, y in elements(data, a, b) if n == DOC_TYPE), "")
        elif number == SEGMENT:
            at = a
            for inner, x, y in elements(data, a, b, SEGMENT):
                start, at = at, y
                if inner == INFO:
                    for n, p, q in elements(data, x, y):
                        if n == TIMESTAMP_SCALE:
                            media.scale = _number(data[p:q])
                        elif n == DURATION:
                            media.duration = _real(data[p:q])
                elif inner == TRACKS:
                    for n, p, q in elements(data, x, y):
                        if n == TRACK_ENTRY:
                            _track(media, data, p, q)
                elif inner == CLUSTER:
                    _cluster(media, data, x, y, start - a)
                elif inner == CUES:
                    _cues(media, data, x, y)
    if media.doc_type not in ("matroska", "webm"):
        raise MatroskaError(f"document type {media.doc_type!r}")
    return media


def _track(media: Media, data: bytes, a: int, b: int) -> None:
    own = {n: data[x:y] for n, x, y in elements(data, a, b)}
    audio = {n: data[x:y] for k, p, q in elements(data, a, b) if k == AUDIO for n, x, y in elements(data, p, q)}
    media.tracks[_number(own.get(TRACK_NUMBER, b""))] = {
        "type": _number(own.get(TRACK_TYPE, b"")), "codec": own.get(CODEC_ID, b"").decode("ascii", "replace"), "rate": _real(audio.get(SAMPLING_FREQUENCY, b"")),
        "channels": _number(audio.get(CHANNELS, b"\1")), "bits": _number(audio.get(BIT_DEPTH, b"")), "frame_ns": _number(own.get(DEFAULT_DURATION, b"")),
    }


def _cluster(media: Media, data: bytes, a: int, b: int, position: int) -> None:
    time = 0
    for number, x, y in elements(data, a, b):
        if number == CLUSTER_TIMESTAMP:
            time = _number(data[x:y])
            media.clusters.append((time, position))
        elif number == SIMPLE_BLOCK:
            _block(media, data, x, y, time, None)
        elif number == BLOCK_GROUP:
            inner = {n: (p, q) for n, p, q in elements(data, x, y)}
            if BLOCK in inner:
                _block(media, data, *inner[BLOCK], time, REFERENCE_BLOCK not in inner)


def _block(media: Media, data: bytes, at: int, end: int, time: int, key: bool | None) -> None:
    track, at = _vint(data, at, end, False)
    if at + 3 > end:
        raise MatroskaError("a block is cut off")
    time += int.from_bytes(data[at : at + 2], "big", signed=True)
    flags, at = data[at + 2], at + 3
    key, lacing = bool(flags & 0x80) if key is None else key, flags >> 1 & 3
    media.blocks += 1
    if lacing == NO_LACING:
        media.packets.append((track, time, at, end - at, key, lacing))
        return
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise MatroskaError("fixed-size lacing does not divide the block")
        sizes = [(end - at) // count] * count
    elif lacing == XIPH:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(count - 1):
            start = at
            n, at = _vint(data, at, end, False)
            sizes.append(n if not k else sizes[-1] + n - ((1 << 7 * (at - start) - 1) - 1))
    if lacing != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("laced frames are longer than their block")
    step = media.tracks.get(track, {}).get("frame_ns", 0) // max(1, media.scale)
    for k, size in enumerate(sizes):
        media.packets.append((track, time + k * step, at, size, key, lacing))
        at += size


def _cues(media: Media, data: bytes, a: int, b: int) -> None:
    for number, x, y in elements(data, a, b):
        if number == CUE_POINT:
            time = 0
            for n, p, q in elements(data, x, y):
                if n == CUE_TIME:
                    time = _number(data[p:q])
                elif n == CUE_TRACK_POSITIONS:
                    where = {m: _number(data[u:v]) for m, u, v in elements(data, p, q)}
                    media.cues.append((time, where.get(CUE_TRACK, 0), where.get(CUE_CLUSTER_POSITION, 0)))


# --- DataFrames -----------------------------------------------------------------------------------------------------

PACKETS = "packet long, track int, timestamp_ns long, start long, n_bytes long, keyframe boolean, lacing int"


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, packet, track, timestamp_ns, start, n_bytes, keyframe, lacing, error) for every packet of every row.

    A null or empty column has no packets; bytes that cannot be parsed give one row with error alone.
    """
    arrow_limits(media.sparkSession)
    names = [key, *(x.split()[0] for x in PACKETS.split(", ")), "error"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if raw:
                    try:
                        m = parse(raw)
                    except (MatroskaError, IndexError) as e:
                        rows.append((k, *[None] * 7, str(e)))
                        continue
                    rows += [(k, i, t, ts * m.scale, at, n, bool(kf), lace, None) for i, (t, ts, at, n, kf, lace) in enumerate(m.packets)]
                while len(rows) >= 1 << 15:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[: 1 << 15], strict=True), kinds, strict=True)], names)
                    rows = rows[1 << 15 :]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select(F.col(key).cast("long"), F.col(column).cast("binary")).mapInArrow(run, f"{key} long, {PACKETS}, error string")


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the UTF-8 bytes of every whole text, padded with spaces to frames, as a Matroska file."""

    def work(keys: list, texts: list) -> list:
        raw = [(t or "").encode() for t in texts]
        return [keys, [len(x) for x in raw], [mux(_padded(x)) for x in raw]]

    return by_batch(docs.select(F.col(key).cast("long"), text), {key: pa.int64(), "n_bytes": pa.int64(), "media": pa.binary()}, f"{key} long, n_bytes long, media binary", work)


def _padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def media_digests(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """From (key, n_bytes, media): n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The payload is gathered from the packets' byte ranges; the feature counts packets, blocks, clusters and cues and
    gives the samples' mean, energy and zero crossings in whole numbers. Equal texts have equal values.
    """
    kinds = {key: pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def work(keys: list, sizes: list, files: list) -> list:
        out: list[list] = [keys, sizes, [], [], [], [], [], []]
        for raw in files:
            m = parse(raw)
            payload = b"".join([raw[at : at + n] for _, _, at, n, _, _ in m.packets])
            for column, value in zip(out[2:], (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(m, payload)), strict=True):
                column.append(value)
        return out

    return by_batch(media.select(key, "n_bytes", "media"), kinds, f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", work)


def feature(m: Media, payload: bytes) -> str:
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    last = max((ts for _, ts, *_ in m.packets), default=0)
    crossings = int(np.count_nonzero((samples[1:] >= -32) != (samples[:-1] >= -32)))  # against byte 96, where letters begin
    return f"packets={len(m.packets)};blocks={m.blocks};clusters={len(m.clusters)};cues={len(m.cues)};last_ms={last * m.scale // 1_000_000};sum={int(samples.sum())};energy={int((samples * samples).sum())};crossings={crossings};peak={int(np.abs(samples).max(initial=0))}"

"""op1, op4 and op5 against the libraries themselves and exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweft.llm import bpe, matroska, queries, token_files

TEXTS = ["", " ", "  a", "a  b", "don't  we'll", "a\n \nb \t c", "<|endoftext|> x", "é è 日本 語  x　y", "x" * 70_000, "ab " * 40_000, "\x00\x1c a", "12 345  !!??", "line\n" * 30_000, "😀 😀😀", "     z"]
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i * 3 % 16, t, "x", "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (50, None, "x", "y"), (51, "twice", "x", "y"), (51, "twice", "x", "y"), (None, "no id", "x", "y")], SCHEMA).repartition(3)


def test_parts_join_and_keep_ids():
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    for t in TEXTS:
        assert "".join(bpe.parts(t, 64)) == t
        assert bpe.encode(t, enc, 64) == enc.encode_ordinary(t)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab '\n\t é1!😀", max_size=80))
def test_safe_cuts(text):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    assert bpe.encode(text, enc, 3) == enc.encode_ordinary(text)
    e = token_files.piece_encoder(public_tokenizers.path(token_files.TOKENIZER))
    assert e.encode([text])[0] == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_rows(odd):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(enc.encode_ordinary(r["text"] or "")), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd.collect())
    got = bpe.roundtrip_digests(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["decoded_sha256"]) for r in got) == want
    assert all(r["ids_sha256"] == hashlib.sha256(b"").hexdigest() for r in got if not r["n_tokens"])
    back = bpe.decode_documents(bpe.encode_documents(odd)).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((r["text"] or "").encode() for r in odd.collect())


def test_decode_is_bytewise(spark):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    ids = enc.encode_ordinary("😀")
    df = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode_documents(df).collect()} == {1: enc.decode_bytes(ids[:1]), 2: b"", 3: b""}


def test_token_files(odd, spark):
    t = token_files.piece_encoder(public_tokenizers.path(token_files.TOKENIZER)).tokenizer
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in odd.collect()), key=lambda r: r[:2])
    manifest = token_files.write_token_files(odd).cache()
    got = sorted(token_files.token_digests(manifest).collect(), key=lambda r: r["start"])
    start = 0
    assert [r["doc_id"] for r in got] == [r[1] if r[0] else None for r in rows]
    for r, (_, _, ids) in zip(got, rows, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = token_files.read_token_files(manifest, first=3, last=5)
    assert sorted(r["doc_id"] for r in some.collect()) == sorted(r[1] for r in rows if r[0] and 3 <= r[1] <= 5)
    assert token_files.read_token_files(manifest, ids=False).columns == ["doc_id", "start", "n_tokens"]
    fs, path = pyarrow.fs.FileSystem.from_uri(manifest.first()["path"])
    column = pq.ParquetFile(fs.open_input_file(path)).metadata.row_group(0).column(3)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_offset_index
    assert token_files.write_token_files(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 8, 192 * 9 + 1, 192 * 8 * 64 * 2 + 5])
def test_mux_round_trip(n):
    payload = matroska._padded(bytes(i * 7 % 256 for i in range(n)))
    raw = matroska.mux(payload)
    m = matroska.parse(raw)
    assert b"".join(raw[a : a + k] for _, _, a, k, _, _ in m.packets) == payload
    assert [p[1] for p in m.packets] == [4 * i for i in range(len(payload) // 192)]
    assert len(m.cues) == len(m.clusters) and m.duration == len(payload) / 192 * 4 and m.tracks[1]["codec"] == "A_PCM/INT/LIT"
    assert [c[2] for c in m.cues] == [c[1] for c in m.clusters]


def lacing_file(flags, body, group=False, unknown=False):
    E = matroska
    block = b"\x81" + (5).to_bytes(2, "big") + bytes([flags]) + body
    inner = E.element(E.BLOCK_GROUP, E.element(E.BLOCK, block)) if group else E.element(E.SIMPLE_BLOCK, block)
    content = E.element(E.CLUSTER_TIMESTAMP, b"\x64") + inner
    cluster = E._id(E.CLUSTER) + b"\x01\xff\xff\xff\xff\xff\xff\xff" + content if unknown else E.element(E.CLUSTER, content)
    tracks = E.element(E.TRACKS, E.element(E.TRACK_ENTRY, E.element(E.TRACK_NUMBER, b"\x01"), E.element(E.TRACK_TYPE, b"\x02")))
    segment = tracks + cluster + E.element(E.VOID, b"\0\0") * (not unknown) + E.element(E.CUES)
    return E.element(E.EBML, E.element(E.DOC_TYPE, b"webm")) + E._id(E.SEGMENT) + (b"\xff" if unknown else E._size(len(segment))) + segment


@pytest.mark.parametrize("unknown", [False, True])
@pytest.mark.parametrize(("flags", "body", "frames"), [
    (0x80, b"abc", [b"abc"]),
    (0x82, b"\x02" + b"\xff\x01\x03" + b"a" * 256 + b"bbb" + b"cc", [b"a" * 256, b"bbb", b"cc"]),  # Xiph
    (0x84, b"\x01" + b"aabb", [b"aa", b"bb"]),  # fixed size
    (0x86, b"\x02" + b"\x83" + b"\xbe" + b"aaabb" + b"cccc", [b"aaa", b"bb", b"cccc"]),  # EBML: 3, then 3 - 1
])
def test_lacing(flags, body, frames, unknown):
    for group in (False, True):
        raw = lacing_file(flags, body, group, unknown)
        m = matroska.parse(raw)
        assert [raw[a : a + k] for _, _, a, k, _, _ in m.packets] == frames and all(p[1] == 105 for p in m.packets)


@pytest.mark.parametrize("raw", [b"\x00", b"\x1a\x45\xdf\xa3", b"\x1a\x45\xdf\xa3\x85\x42\x82\x82xx", matroska.mux(b" " * 192)[:-20], lacing_file(0x84, b"\x01aab"), lacing_file(0x82, b"\x01\xfa" + b"a")])
def test_broken_media(raw):
    with pytest.raises(matroska.MatroskaError):
        matroska.parse(raw)


def test_media_rows(spark, odd):
    media = matroska.text_media(odd)
    for r in matroska.media_digests(media).collect():
        text = next((x["text"] or "").encode() for x in odd.collect() if x["doc_id"] == r["doc_id"] and len((x["text"] or "").encode()) == r["n_bytes"])
        padded = text + b" " * (-len(text) % 192 if text else 192)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    packets = matroska.packet_table(media)
    assert packets.where("error IS NULL").count() == sum(max(1, -(-len((r["text"] or "").encode()) // 192)) for r in odd.collect())
    bad = spark.createDataFrame([(1, bytearray(b"nope")), (2, None)], "doc_id long, media binary")
    assert [(r["doc_id"], bool(r["error"])) for r in matroska.packet_table(bad).collect()] == [(1, True)]
    none = spark.createDataFrame([], SCHEMA)
    assert matroska.media_digests(matroska.text_media(none)).count() == 0 and bpe.roundtrip_digests(none).count() == 0


def test_queries(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for f in (queries.op1_byte_bpe, queries.op4_token_files, queries.op5_matroska):
        assert f(spark, sf).count() == n


def test_pages_are_read_by_their_index(spark, tmp_path):
    """Spark's reader gives the same rows, and its scan of a narrow range reads few of the rows of a file."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('word', id, ' and more words of text') AS text")
    manifest = token_files.write_token_files(docs.repartition(1), path=f"file://{tmp_path}/tokens")
    whole = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids"]) for r in token_files.read_token_files(manifest).collect()}
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids"]) for r in token_files.read_pages(manifest).collect()}
    assert got == whole and len(got) == 6000
    some = token_files.read_pages(manifest, 1234, 1240)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids"]) for r in some.collect()} == {k: v for k, v in whole.items() if 1234 <= k <= 1240}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,1234)" in plan and "LessThanOrEqual(doc_id,1240)" in plan
    assert token_files.read_pages(manifest, 1234, 1240, ids=False).columns == ["doc_id", "start", "n_tokens"]
    none = token_files.write_token_files(docs.limit(0), path=f"file://{tmp_path}/none")
    assert token_files.read_pages(none).count() == 0
    import pyarrow.parquet as pq

    file = pq.ParquetFile(manifest.first()["path"].removeprefix("file://"))
    assert all(file.metadata.row_group(0).column(k).has_offset_index for k in range(4)) and file.metadata.row_group(0).column(0).has_column_index

"""Byte-level BPE with a local rank file: encoding to ids and decoding to raw bytes."""

from __future__ import annotations

import base64
import functools
import re

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

RANKS = "byte_bpe_50k.tiktoken"
#: Texts of more characters are cut at safe boundaries into parts of about so many.
PART_CHARS = 1 << 16
#: Every match of the pattern that holds a non-space ends before the next space, and what follows starts anew there:
#: the ids of the parts are the ids of the whole.
_BOUNDARY = re.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """An encoding without special tokens from a rank file: a base64 token and its rank on each line."""
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


@functools.lru_cache(maxsize=4)
def _numerals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Cut text at safe boundaries; a part is longer than size only where it has no boundary."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if not cut:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def encode(text: str | None, enc: tiktoken.Encoding, size: int = PART_CHARS) -> list[int]:
    """The ids of the whole text; null and empty texts have none."""
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for part in parts(text, size) for i in enc.encode_ordinary(part)]


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row; null and empty texts get an empty array, repeated rows are encoded each."""
    path = ranks or public_tokenizers.path(RANKS)

    def work(keys: list, texts: list) -> list:
        enc = encoding(path, pattern)
        return [keys, [encode(x, enc) for x in texts]]

    return by_batch(docs.select(F.col(key).cast("long"), text), {key: pa.int64(), "ids": pa.list_(pa.int32())}, f"{key} long, ids array<int>", work)


def decode_documents(encoded: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes) from ids, byte for byte; the bytes need not be valid UTF-8. A null array gives empty bytes."""
    path = ranks or public_tokenizers.path(RANKS)

    def work(keys: list, rows: list) -> list:
        enc = encoding(path, pattern)
        return [keys, [enc.decode_bytes(x or []) for x in rows]]

    return by_batch(encoded.select(F.col(key).cast("long"), ids), {key: pa.int64(), "bytes": pa.binary()}, f"{key} long, bytes binary", work)


def roundtrip_digests(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every row in one pass: key, n_tokens, ids_sha256, decoded_sha256, n_bytes.

    Null and empty texts have no tokens and the digests of nothing. Every row gives a row, repeated keys too.
    """
    import hashlib

    path = ranks or public_tokenizers.path(RANKS)
    kinds = {key: pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "n_bytes": pa.int64()}

    def work(keys: list, texts: list) -> list:
        enc = encoding(path, pattern)
        numerals = _numerals(enc.n_vocab)
        out: list[list] = [keys, [], [], [], []]
        for text in texts:
            ids = encode(text, enc)
            raw = enc.decode_bytes(ids)
            out[1].append(len(ids))
            out[2].append(hashlib.sha256(" ".join([numerals[i] for i in ids]).encode()).hexdigest())
            out[3].append(hashlib.sha256(raw).hexdigest())
            out[4].append(len(raw))
        return out

    return by_batch(docs.select(F.col(key).cast("long"), text), kinds, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long", work)

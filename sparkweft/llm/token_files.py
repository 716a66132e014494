"""Token ids as Parquet list columns: delta-coded, in row groups of bounded size with page indexes.

Documents are range-partitioned and sorted by id; each task encodes its range and writes one file straight into the
shared folder under a name of its own attempt. The rows that the task returns (the manifest) say which files count:
files of lost or repeated attempts are never listed. Readers take the columns and row groups that they need.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_limits, scratch, settled

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
#: Ids in a row group, about; characters of distinct pieces that a worker remembers, at most.
GROUP_IDS, MEMO_CHARS = 1 << 20, 14 << 20
#: Words that are pre-tokenized at a time.
_LINES = 64
#: Latin letters, then ASCII marks without an apostrophe: how most words look.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
#: How bytes look in a piece: visible Latin-1 characters as they are, the others as characters from 256 on, in order.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_SAFE = re.compile(r"(?<=\S) ")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.uint32(), False)))])
#: Ids and starts are close to their neighbours or small: delta coding; never a dictionary page per row group.
ENCODINGS = {"doc_id": "DELTA_BINARY_PACKED", "start_in_file": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED", "ids.list.element": "DELTA_BINARY_PACKED"}


class PieceEncoder:
    """Encodes whole texts with the tokenizers library, piece by piece.

    The pre-tokenizer never lets a match run from a non-space into a space, so a text cut between them has the ids of
    its pieces in order. Words come again and again: a batch's distinct words are looked up once each and the ids of a
    bounded number of them are remembered. New words are pre-tokenized many at a time and each new piece is merged by
    the library's model.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # How a space looks in a piece. None: this tokenizer works in another way, and its texts are encoded whole.
        self.space = self._space()
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.chars = 0

    def _space(self) -> str | None:
        state = json.loads(self.tokenizer.to_str())
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if state.get("normalizer") or not byte_level.items() <= (state.get("pre_tokenizer") or {}).items() or state["model"]["type"] != "BPE":
            return None
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][0]

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian uint32; none for null and empty texts."""
        ids, sizes = self.encode_batch(pa.array(texts, pa.string()))
        raw, marks = ids.tobytes(), [0, *(4 * np.cumsum(sizes)).tolist()]
        return [raw[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]

    def encode_batch(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids of each text): each text's ids, then end; null and empty texts hold end alone."""
        texts = pc.fill_null(texts, "")
        if self.space is None:
            raw = [self._raw(t) + end for t in texts.to_pylist()]
            return np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64)
        # A cut is safe at a space that follows a non-space; texts with other spaces have words that hold some.
        odd = pc.or_(pc.match_substring_regex(texts, r"[\s\p{Z}\x0b\x1c-\x1f\x85] "), pc.starts_with(texts, " "))
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        if pc.any(odd).as_py():
            words = lists.to_pylist()
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                words[i] = _SAFE.split(texts[i].as_py())
            lists = pa.array(words, pa.list_(pa.string()))
        flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self._known(words)
        starts = offsets[:-1]
        begins = [self._raw(w) for w in flat.take(pa.array(starts)).to_pylist()]
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at[starts] = len(words) + np.arange(len(begins))
        at = np.insert(at, offsets[1:], len(words) + len(begins))
        ids = pa.array([*known, *begins, end], pa.large_binary()).take(pa.array(at))
        cuts = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        ends = cuts[offsets[1:] + np.arange(1, len(offsets))]
        data = np.frombuffer(ids.buffers()[2], "<u4")[: cuts[-1] // 4] if len(ids) and cuts[-1] else np.zeros(0, "<u4")
        return data, np.diff(ends, prepend=cuts[0]) // 4

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each word as it stands after a space."""
        get = self.memo.get
        found = [get(w) for w in words]
        new = [w for w, x in zip(words, found, strict=True) if x is None]
        if new:
            chars = sum(map(len, new))
            if self.chars + chars > MEMO_CHARS and self.memo:
                self.memo, self.pieces, self.chars = {}, {}, 0
                return self._known(words)
            self.chars += chars
            self._learn(new)
            found = [self.memo[w] for w in words]
        return found

    def _merged(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()
        return ids

    def _learn(self, words: list[str]) -> None:
        memo, merged, plain, space = self.memo, self._merged, _PLAIN.fullmatch, self.space
        rest = []
        for w in words:
            if m := plain(w):  # letters, then marks: two pieces
                letters, marks = m.groups()
                if not letters.isascii():
                    letters = letters.encode().decode("latin-1").translate(_SHOWN)
                memo[w] = merged(space + letters) + merged(marks) if marks else merged(space + letters)
            elif w and " " not in w and not w[0].isspace():
                rest.append(w)
            else:
                memo[w] = self._raw(" " + w)
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for k in range(0, len(rest), _LINES):
            some, found = rest[k : k + _LINES], []
            for piece, _ in cut(" " + " ".join(some)):
                if piece[0] == space:
                    found.append(merged(piece))
                else:
                    found[-1] += merged(piece)
            if len(found) != len(some):  # a word begins otherwise than words do: each by itself
                found = [self._raw(" " + w) for w in some]
            memo.update(zip(some, found, strict=True))


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write every row's ids in ascending key order; the manifest: part, path, docs, tokens, start (ids in files before).

    Each document ends with end_id, null and empty texts hold it alone. Rows of equal keys stand in the order of their
    texts' hashes; a null key comes first, as Spark sorts it. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    model, folder = tokenizer or public_tokenizers.path(TOKENIZER), path or scratch(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, writer, name, n_docs, total = TaskContext.get().partitionId(), None, None, 0, 0
        held: list[tuple] = []
        held_ids = 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, sizes = piece_encoder(model).encode_batch(batch.column(1), end)
                if writer is None:
                    name = f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.parquet"
                    writer = _writer(name)
                # Row groups of about GROUP_IDS ids, never less than a document.
                group = (held_ids + np.cumsum(sizes)) // GROUP_IDS
                cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
                marks = np.concatenate([[0], np.cumsum(sizes)])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a and b > a:
                        total = _flush(writer, held, total)
                        held, held_ids = [], 0
                    held.append((batch.column(0).slice(a, b - a), sizes[a:b], ids[marks[a] : marks[b]]))
                    held_ids += int(marks[b] - marks[a])
                n_docs += len(sizes)
            if held:
                total = _flush(writer, held, total)
        finally:
            if writer is not None:
                writer.close()
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([total], pa.int64())], ["part", "path", "docs", "tokens"])

    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = settled(dealt.mapInArrow(write, "part int, path string, docs long, tokens long"), "manifest")
    # One row a file: the window holds as many rows as the writing job had partitions.
    return manifest.withColumn("start", F.sum("tokens").over(W.orderBy("part")) - F.col("tokens"))


def _writer(name: str) -> pq.ParquetWriter:
    fs, path = pa.fs.FileSystem.from_uri(name)
    fs.create_dir(os.path.dirname(path), recursive=True)
    return pq.ParquetWriter(path, SCHEMA, filesystem=fs, compression="zstd", use_dictionary=False, column_encoding=ENCODINGS, write_page_index=True, data_page_size=1 << 18, write_statistics=["doc_id", "start_in_file", "n_tokens"])


def _flush(writer: pq.ParquetWriter, held: list[tuple], total: int) -> int:
    """Write one row group from (doc_ids, sizes, ids) parts; returns the ids in the file so far."""
    sizes = np.concatenate([h[1] for h in held])
    starts = total + np.cumsum(sizes) - sizes
    ids = np.concatenate([h[2] for h in held])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids), type=SCHEMA.field("ids").type)
    writer.write_table(pa.Table.from_arrays([pa.concat_arrays([h[0] for h in held]), pa.array(starts), pa.array(sizes), lists], schema=SCHEMA), row_group_size=len(sizes))
    return int(total + sizes.sum())


def read_token_files(manifest: DataFrame, ids: bool = True, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files of a manifest.

    Without ids only the metadata columns are read and ids_crc32 is left out; with bounds only the row groups whose
    statistics meet first <= doc_id <= last are.
    """
    columns = ["doc_id", "start", "n_tokens"] + (["ids_crc32", "ids"] if ids else [])
    schema = "doc_id long, start long, n_tokens long" + (", ids_crc32 long, ids array<int>" if ids else "")
    return _read(manifest, first, last, columns, schema)


def read_pages(manifest: DataFrame, first: int | None = None, last: int | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens[, ids array<long>]) of first <= doc_id <= last through Spark's Parquet reader: of each file
    only the row groups whose statistics, and in them the pages whose entries in the page index, meet the bounds.

    An empty manifest gives an empty table. The list of files has one entry a writing task.
    """
    spark = manifest.sparkSession
    files = [r["path"] for r in manifest.select("path").collect()]
    columns = "doc_id long, start_in_file long, n_tokens long" + (", ids array<long>" if ids else "")
    rows = spark.read.schema(columns).parquet(*files) if files else spark.createDataFrame([], columns).withColumn("_metadata", F.struct(F.lit("").alias("file_name")))
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    named = rows.select("*", F.col("_metadata.file_name").alias("file"))
    starts = manifest.select(F.substring_index("path", "/", -1).alias("file"), "start")
    out = named.join(F.broadcast(starts), "file")  # one row a file
    return out.select("doc_id", (F.col("start") + F.col("start_in_file")).alias("start"), "n_tokens", *(["ids"] if ids else []))


def token_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the stored ids."""
    return _read(manifest, None, None, ["doc_id", "start", "n_tokens", "ids_crc32"], "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read(manifest: DataFrame, first: int | None, last: int | None, columns: list[str], schema: str) -> DataFrame:
    arrow_limits(manifest.sparkSession)
    stored = ["doc_id", "start_in_file", "n_tokens"] + (["ids"] if "ids_crc32" in columns else [])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = pa.fs.FileSystem.from_uri(name)
                with fs.open_input_file(path) as f:
                    file = pq.ParquetFile(f)
                    for g in range(file.metadata.num_row_groups):
                        stats = file.metadata.row_group(g).column(0).statistics
                        if stats and stats.has_min_max and (last is not None and stats.min > last or first is not None and stats.max < first):
                            continue
                        yield from _group(file.read_row_group(g, columns=stored), start)

    def _group(t: pa.Table, start: int) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        if first is not None:
            t = t.filter(pc.greater_equal(t["doc_id"], first))
        if last is not None:
            t = t.filter(pc.less_equal(t["doc_id"], last))
        for part in t.to_batches():
            out = [part.column("doc_id"), pc.add(part.column("start_in_file"), start), part.column("n_tokens")]
            if "ids_crc32" in columns:
                lists = part.column("ids")
                flat, cuts = lists.flatten().to_numpy().astype("<u4", copy=False), np.concatenate([[0], np.cumsum(part.column("n_tokens").to_numpy())])
                out.append(pa.array([zlib.crc32(flat[a:b].data) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64()))
                if "ids" in columns:
                    out.append(lists.cast(pa.list_(pa.int32())))
            if part.num_rows:
                yield pa.RecordBatch.from_arrays(out, columns)

    files = manifest.select("path", "start").repartition(max(1, manifest.count()))
    return files.mapInArrow(read, schema)

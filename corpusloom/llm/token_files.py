"""Token ids in files of independently coded blocks, as a data source "token_blocks".

Rows (doc_id, ids) in any order of partitions become one file a task. A file is a row of blocks: a head with sizes and checksums, the
pieces of documents in it, and the ids as context_coder writes them. A document that does not fit goes on in the next
block. Every block is coded with a model of its own, so that any of them can be read without the others.

Files have names of their own, and the driver lists in _files.json those of the attempts that were committed, with the number
of their ids: what a lost executor leaves is in no list. The list also says where a file's first id stands among all.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import context_coder
from .common import scratch, small_batches, texts_of
from .packing import Tokenizer, default_tokenizer, tokenizer

BLOCK_IDS = 1 << 21
READ_BYTES = 32 << 20  # of ids in an Arrow batch
HEAD = struct.Struct("<4sIIIII")  # mark, ids, bytes of pieces, bytes of coded ids, crc32 of both, crc32 of the ids
MARK, LIST = b"CLT1", "_files.json"
END_ID = 0
FORMAT = "token_blocks"
WRITTEN, READ = "doc_id long, ids binary", "doc_id long, start long, n_tokens long, ids binary"


def _block(pieces: list[tuple[int | None, int, bool]], ids: np.ndarray) -> bytes:
    """pieces: doc_id, number of ids in this block, whether the document ends here."""
    doc = np.array([0 if d is None else d for d, _, _ in pieces], "<i8")
    known = np.packbits([d is not None for d, _, _ in pieces])
    ends = np.packbits([e for _, _, e in pieces])
    sizes = np.array([n for _, n, _ in pieces], "<u4")
    table = zlib.compress(struct.pack("<I", len(pieces)) + np.diff(doc, prepend=0).astype("<i8").tobytes() + sizes.tobytes() + known.tobytes() + ends.tobytes(), 6)
    coded = context_coder.encode(ids)
    return HEAD.pack(MARK, len(ids), len(table), len(coded), zlib.crc32(coded, zlib.crc32(table)), context_coder.checksum(ids)) + table + coded


def read_block(stream) -> tuple[list[tuple[int | None, int, bool]], np.ndarray] | None:
    """The next block of a file; None at its end. A block that is not what was written raises."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("a block of ids is cut short")
    mark, n, table_size, coded_size, crc, ids_crc = HEAD.unpack(head)
    body = stream.read(table_size + coded_size)
    if mark != MARK or len(body) != table_size + coded_size or zlib.crc32(body) != crc:
        raise ValueError("a block of ids is damaged")
    table, ids = zlib.decompress(body[:table_size]), context_coder.decode(body[table_size:])
    if len(ids) != n or context_coder.checksum(ids) != ids_crc:
        raise ValueError("a block's ids are not those that were written")
    (m,) = struct.unpack_from("<I", table)
    bits = -(-m // 8)
    doc = np.cumsum(np.frombuffer(table, "<i8", m, 4)).tolist()
    sizes = np.frombuffer(table, "<u4", m, 4 + 8 * m).tolist()
    known, ends = (np.unpackbits(np.frombuffer(table, "u1", bits, 4 + 12 * m + k * bits), count=m).astype(bool).tolist() for k in (0, 1))
    return [(d if k else None, s, e) for d, s, k, e in zip(doc, sizes, known, ends, strict=True)], ids


@dataclass
class _File(WriterCommitMessage):
    part: int
    name: str
    docs: int
    ids: int


# white space as Python's \s has it: that of Arrow's patterns is ASCII's, without the vertical tab
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD_SPACE = rf"{_SPACE}(?:{_SPACE}|\z)"
_BLANK = 0x20


def batch_ids(tok: Tokenizer, texts: list[str]) -> list[np.ndarray]:
    """tok.ids() of each text, with each different word of the texts looked at once.

    The file cuts a text before each blank that follows something else than white space, so that a blank and a word have the
    same ids anywhere, and no other of their ids begins with a blank. Words keep the blank before them, so that the
    different ones of a dictionary stand as one text. Texts with other white space or added tokens go through the tokenizer whole.
    """
    out: list = [None] * len(texts)
    plain = []
    odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), _ODD_SPACE).to_pylist()
    for i, t in enumerate(texts):
        if not t or odd[i] or any(a in t for a in tok.added):
            out[i] = tok.ids(t)
        else:
            plain.append(i)
    if not plain:
        return out
    _, offsets, data = pa.array([texts[i] for i in plain], pa.large_string()).buffers()
    bounds = np.frombuffer(offsets, np.int64, len(plain) + 1)
    raw = np.frombuffer(data, np.uint8, bounds[-1])
    begins = raw == _BLANK
    begins[bounds[:-1]] = True
    at = np.append(np.flatnonzero(begins), bounds[-1])
    words, later = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data), raw[at[:-1]] == _BLANK
    named = words.filter(pa.array(later)).dictionary_encode()
    known = tok.numbers(_in_a_row(named.dictionary)) if len(named) else np.zeros(0, np.uint32)
    starts = np.flatnonzero(tok.blank_first[known])
    alone = [tok.numbers(w) for w in words.filter(pa.array(~later)).to_pylist()]
    pool = np.concatenate([known, *alone])
    sizes = np.concatenate([np.diff(starts, append=len(known)), [len(x) for x in alone]]).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    which = np.empty(len(words), np.int64)
    which[later], which[~later] = named.indices.to_numpy(), len(named.dictionary) + np.arange(len(alone))
    n = sizes[which]
    until = np.cumsum(n)
    ids = pool[np.repeat(starts[which] - (until - n), n) + np.arange(until[-1])]
    for i, x in zip(plain, np.split(ids, until[np.searchsorted(at, bounds[1:-1]) - 1]), strict=True):
        out[i] = x
    return out


def _in_a_row(words: pa.LargeStringArray) -> str:
    _, offsets, data = words.buffers()
    first, last = np.frombuffer(offsets, np.int64)[[words.offset, words.offset + len(words)]].tolist()
    return str(data[first:last], "utf-8")


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, block_ids: int):
        self.path, self.block_ids = path, block_ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _File | None:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        part, name, docs, total = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.ids", 0, 0
        pieces, held, size = [], [], 0
        with files.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                    ids = np.frombuffer(raw.as_buffer() if raw.is_valid else b"", "<u4")
                    docs, total, at = docs + 1, total + len(ids), 0
                    while True:
                        take = min(len(ids) - at, self.block_ids - size)
                        pieces.append((doc, take, at + take == len(ids)))
                        held.append(ids[at : at + take])
                        at, size = at + take, size + take
                        if size == self.block_ids:
                            out.write(_block(pieces, np.concatenate(held)))
                            pieces, held, size = [], [], 0
                        if at == len(ids):
                            break
            if pieces:
                out.write(_block(pieces, np.concatenate(held)))
        return _File(part, name, docs, total)

    def commit(self, messages: list[_File | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        listed = [{"name": m.name, "docs": m.docs, "ids": m.ids} for m in sorted((m for m in messages if m is not None), key=lambda m: m.part)]
        with files.open_output_stream(f"{root}/{LIST}.new") as out:
            out.write(json.dumps(listed).encode())
        files.move(f"{root}/{LIST}.new", f"{root}/{LIST}")

    def abort(self, messages: list[_File | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{root}/{m.name}")


@dataclass
class _Stretch(InputPartition):
    name: str
    start: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Stretch]:
        files, root = fs.FileSystem.from_uri(self.path)
        with files.open_input_stream(f"{root}/{LIST}") as f:
            listed = json.loads(f.read())
        out, start = [], 0
        for x in listed:
            if x["docs"]:
                out.append(_Stretch(x["name"], start))
            start += x["ids"]
        return out or [_Stretch("", 0)]

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, root = fs.FileSystem.from_uri(self.path)
        start, begun, rows, size = partition.start, [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])

        with files.open_input_stream(f"{root}/{partition.name}") as f:
            while (block := read_block(f)) is not None:
                pieces, ids = block
                at = 0
                for doc, n, ends in pieces:
                    begun.append(ids[at : at + n])
                    at += n
                    if ends:
                        whole = np.concatenate(begun)
                        rows.append((doc, start, len(whole), whole.astype("<u4").tobytes()))
                        start, begun, size = start + len(whole), [], size + whole.nbytes
                        if size >= READ_BYTES:
                            yield batch()
                            rows, size = [], 0
        if rows:
            yield batch()


class TokenBlocks(DataSource):
    """spark.read/df.write.format("token_blocks"): option path, a URI that pyarrow.fs opens; option block_ids when writing. A write replaces the list of what was there before."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("block_ids", BLOCK_IDS)))


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) in ascending doc_id: the text's ids and the end id as little-endian 32-bit integers.

    Rows of one doc_id are told apart by text and place in the input, so that their number does not decide the size of a partition.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            texts = [t.decode("utf-8", "replace") for t in texts_of(b.column(1))]
            ids = [x.astype("<u4").tobytes() + end for x in batch_ids(tok, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.orderBy("doc_id", F.xxhash64("text"), "row")
    return ordered.select("doc_id", "text").mapInArrow(run, WRITTEN)


def stored(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the ids of all documents to files under path, in ascending doc_id (null first), and gives (doc_id, start, n_tokens, ids) as read back from them.

    Null or empty text: the end id alone. Rows with one doc_id are each kept, in the order of a hash of their texts, equal rows in the
    order of the input. A text of any length goes through as many blocks as it takes. An empty table gives no rows. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenBlocks)
    encoded(docs, tokenizer_path or default_tokenizer(), end_id).write.format(FORMAT).option("block_ids", block_ids).mode("append").save(path)
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files under path."""
    spark.dataSource.register(TokenBlocks)
    return spark.read.format(FORMAT).load(path)


def stored_digests(docs: DataFrame) -> DataFrame:
    """stored() with the crc32 of the ids in their place."""
    return stored(docs, scratch(docs.sparkSession, "token-files")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""Alignment of two tokenizers' tokens on the same bytes.

The tokens of a batch of texts are two arrays of ends on one line of bytes. Their union cuts the line into elementary intervals; a
search of each interval's end in both arrays gives the two tokens that own it, so that each interval is one overlap. An
end that is in both arrays closes a group, the smallest stretch that both tokenizers cut alike; a group's pairs are
the product of its tokens. Texts of a batch are laid end to end: each begins and ends with a group of its own.

A link is a pair of tokens that end together, the last two of a group. As both cover the bytes before that end, one is the end of
the other, so that the different links of a corpus are at most as many as the two vocabularies have suffixes: the sum of
their entries' lengths. That bounds the table of counts, which the driver gathers and broadcasts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of, written
from .packing import _byte_alphabet, tokenizer

CHUNK_BYTES = 4 << 20  # texts are laid end to end up to so many bytes
SPACE = "▁"


class Vocabularies:
    """Both tokenizers, their entries' bytes, and each entry's id as text with what stands behind it in a list of groups."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = tokenizer(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_alphabet()
        names = {i: t for t, i in self.a.file.get_vocab(with_added_tokens=True).items()}
        added = self.a.file.get_added_tokens_decoder()
        self.a_bytes = [b"" if i not in names else names[i].encode() if i in added else bytes(byte_of[c] for c in names[i]) for i in range(max(names) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.listed = [b"%d%s" % (i, end) for i in range(len(self.a_bytes)) for end in (b",", b"|")] + [b"%d%s" % (i, end) for i in range(len(self.b_bytes)) for end in (b",", b";")]
        self.key = "<u4" if len(self.a_bytes) * len(self.b_bytes) <= 1 << 32 else "<u8"

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def tokens(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both; none if the text is empty or either's bytes are not those of a space and the text."""
        none, plain = np.zeros(0, np.int64), text.decode("utf-8", "replace")
        if not text:
            return none, none
        a, b = self.a.encoding.encode_ordinary(" " + plain), self.b.encode(plain)
        if any(b"".join(map(table.__getitem__, ids)) != b" " + text for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            return none, none
        return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One for each worker process and pair of files."""
    return Vocabularies(a_path, b_path)


@dataclass
class Alignment:
    """Tokens of two kinds on one line of bytes, by their ends, which ascend; both cover the whole line."""

    a_ends: np.ndarray
    b_ends: np.ndarray

    @cached_property
    def bounds(self) -> np.ndarray:
        """The ends of the elementary intervals."""
        return np.union1d(self.a_ends, self.b_ends)

    @cached_property
    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """For each interval the places of the two tokens that own it."""
        return np.searchsorted(self.a_ends, self.bounds), np.searchsorted(self.b_ends, self.bounds)

    @cached_property
    def shared(self) -> np.ndarray:
        """The intervals that end a group."""
        return np.flatnonzero((self.a_ends[self.overlaps[0]] == self.bounds) & (self.b_ends[self.overlaps[1]] == self.bounds))

    @cached_property
    def last(self) -> tuple[np.ndarray, np.ndarray]:
        """The last tokens of each group."""
        return self.overlaps[0][self.shared], self.overlaps[1][self.shared]

    @cached_property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each group."""
        return tuple(np.diff(x, prepend=-1) for x in self.last)

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens of one group, in order."""
        (a, b), n = self.sizes, self.sizes[0] * self.sizes[1]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(b, n)
        return np.repeat(self.last[0] - a + 1, n) + place // np.maximum(wide, 1), np.repeat(self.last[1] - b + 1, n) + place % np.maximum(wide, 1)

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each token stands if the groups are written one after the other, a's tokens before b's."""
        a, b = self.sizes
        return np.arange(len(self.a_ends)) + np.repeat(self.last[1] - b + 1, a), np.arange(len(self.b_ends)) + np.repeat(self.last[0] + 1, b)


def _chunks(texts: list[bytes]) -> Iterator[slice]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def _aligned(v: Vocabularies, texts: list[bytes], whole: bool) -> Iterator[tuple]:
    """n_a, n_b, n_groups, n_overlaps, n_pairs, groups, links of each text; groups as text if whole, else its SHA-256."""
    tokens = [v.tokens(t) for t in texts]
    a, b = (np.concatenate([x[k] for x in tokens]) for k in (0, 1))
    n_a, n_b = (np.array([len(x[k]) for x in tokens]) for k in (0, 1))
    line = Alignment(np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b]))
    (last_a, last_b), (at_a, at_b) = line.last, line.order()
    ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    ends_a[last_a], ends_b[last_b] = 1, 1
    listed = np.empty(len(a) + len(b), np.int64)
    listed[at_a], listed[at_b] = 2 * a + ends_a, 2 * (len(v.a_bytes) + b) + ends_b
    links = (a[last_a] * len(v.b_bytes) + b[last_b]).astype(v.key)
    tokens_until = np.append(0, np.cumsum(n_a + n_b))
    # groups and intervals before each text: a text's tokens are whole groups
    groups_until = np.searchsorted(last_a, np.append(0, np.cumsum(n_a)))
    overlaps_until = np.append(0, line.shared + 1)[groups_until]
    pairs_until = np.append(0, np.cumsum(line.sizes[0] * line.sizes[1]))[groups_until]
    for i in range(len(texts)):
        said = b"".join(map(v.listed.__getitem__, listed[tokens_until[i] : tokens_until[i + 1]].tolist()))[:-1]
        g, h = groups_until[i], groups_until[i + 1]
        yield int(n_a[i]), int(n_b[i]), int(h - g), int(overlaps_until[i + 1] - overlaps_until[i]), int(pairs_until[i + 1] - pairs_until[i]), said.decode() if whole else hashlib.sha256(said).hexdigest() if said else "", links[g:h].tobytes()


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_pairs", "groups", "links"]


def aligned(docs: DataFrame, a_path: str, b_path: str, whole: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_overlaps, n_pairs, groups, links) of each row of docs.

    groups is `a1,a2|b1;a3|b2,b3`, or its SHA-256 if not whole; links has an integer of key_width bytes for each pair that ends
    together: the first id times the second vocabulary's size, plus the second id.
    """
    small_batches(docs.sparkSession)
    types = [pa.int64()] * 6 + [pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(a_path, b_path)
        for batch in batches:
            texts, docs = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for chunk in _chunks(texts):
                rows = [(d, *x) for d, x in zip(docs[chunk], _aligned(v, texts[chunk], whole), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ALIGNED)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_pairs long, groups string, links binary")


def pair_counts(table: DataFrame, key: str) -> DataFrame:
    """(pair, n): how many links of an aligned table have each pair of ids. A task counts its own links before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, key), np.zeros(0, np.int64)
        for batch in batches:
            here, times = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), key), return_counts=True)
            pairs, at = np.unique(np.concatenate([pairs, here]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, times]), minlength=len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], ["pair", "n"])

    return table.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def counted(table: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """An aligned table with n_links, n_best and count_sum in place of the links."""
    v = vocabularies(a_path, b_path)
    key, wide, entries = v.key, len(v.b_bytes), int(v.a_size.sum() + v.b_size.sum())
    got = pair_counts(table, key).toArrow()  # at most a row for each suffix of an entry of either vocabulary
    if got.num_rows > entries:
        raise RuntimeError("more different links than the vocabularies have suffixes")
    got = got.sort_by("pair")
    pairs, n = got["pair"].to_numpy(), got["n"].to_numpy()
    most = np.zeros(wide, np.int64)
    np.maximum.at(most, pairs % wide, n)
    given = table.sparkSession.sparkContext.broadcast((pairs.astype(key), n, n == most[pairs % wide]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = given.value
        for batch in batches:
            links = batch.column("links").to_pylist()
            until = np.append(0, np.cumsum([len(x) // np.dtype(key).itemsize for x in links]))
            at = np.searchsorted(pairs, np.frombuffer(b"".join(links), key))
            sums = [np.append(0, np.cumsum(x[at]))[until] for x in (best, n)]
            columns = [batch.column(c) for c in ALIGNED[:-1]] + [pa.array(np.diff(x).astype(np.int64)) for x in (until, *sums)]
            yield pa.RecordBatch.from_arrays(columns, [*ALIGNED[:-1], "n_links", "n_best", "count_sum"])

    return table.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_pairs long, groups string, n_links long, n_best long, count_sum long")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, whole: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_overlaps, n_pairs, groups, n_links, n_best, count_sum) of each row of docs.

    The first tokenizer (a byte-level file) reads a space and the text, the second (a piece model, which adds the space itself) the text. Null or empty texts, and
    those that either changes, have zeros and empty groups. Null doc_id: kept. Repeated rows are counted as often as they occur. A very
    long text is one line of tokens in one task. An empty table gives no rows. Columns besides doc_id and text are not read.
    """
    a, b = default_paths()
    a, b = a_path or a, b_path or b
    return counted(written(aligned(docs, a, b, whole), "aligned"), a, b)


def alignment_digests(docs: DataFrame) -> DataFrame:
    """alignment() with the SHA-256 of the groups."""
    return alignment(docs, whole=False).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_overlaps", "n_pairs")

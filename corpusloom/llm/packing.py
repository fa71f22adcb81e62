"""Packing documents into fixed windows by lexical retrieval.

Every document is tokenized once; its ids and an end id are dealt to shards of about SHARD_TOKENS tokens by a tree of
cuts, so that lexical neighbours meet: the tree is grown on a sample of the documents' weighted terms, projected to DIMS
numbers, and a leaf that no cut divides (copies) is dealt by a hash of row and copy, so that no shard grows with the
number of copies. Each shard builds an inverted index of its documents with BM25 weights, whose document frequencies, number of
documents and mean length are those of the whole corpus. A seed, the next unused document, asks the index for unused
neighbours; they fill its window greedily, and the last is cut where the window ends. What is left of it is the next
seed. So only the last window of a shard is not full. A window takes no second copy of a document (a row with the same
doc_id) while the shard has anything else.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of, written

WINDOW, END_ID = 2048, 1
SHARD_TOKENS = 1_000_000
DENSE_SHARE = 8  # terms in more than one document of so many have a column
K1, B = 1.2, 0.75
DIMS = 256
SAMPLE, SAMPLE_MAX = 64, 60_000  # sampled documents a shard, and in all


LOOK_AHEAD = r"|\s+(?!\S)|\s+"
_SPACE_RUN = re.compile(r"\s(?:\s|\Z)").search


class Tokenizer:
    """ids of the tokenizers file at `path`.

    Byte-level BPE works on one pre-token at a time, so the file's vocabulary is given to tiktoken's merge loop, which
    does the same merges at a lower cost; equality with the tokenizers library is a test. A text that holds one of the
    file's added tokens is left to the library, which maps the token to its one id.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        import tokenizers

        file, byte_of = tokenizers.Tokenizer.from_file(path), _byte_alphabet()
        special = file.get_added_tokens_decoder()
        self.file, self.added = file, [t.content for t in special.values()]
        ranks = {bytes(byte_of[c] for c in t): i for t, i in file.get_vocab(with_added_tokens=False).items() if i not in special}
        # none of the added tokens is ever allowed; but without any, encode_to_numpy() stops at each character to look for one
        added = {t.content: i for i, t in special.items()}
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        # without the look-ahead, which is slow and tells apart only white space that other white space or the end follows
        short = public_tokenizers.PATTERN.removesuffix(LOOK_AHEAD)
        self.plain = self.encoding if short == public_tokenizers.PATTERN else tiktoken.Encoding("plain", pat_str=short + r"|\s", mergeable_ranks=ranks, special_tokens=added)
        self.blank_first = np.zeros(max(self.file.get_vocab().values()) + 1, bool)
        self.blank_first[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    def numbers(self, text: str) -> np.ndarray:
        """ids of a text without added tokens, in which neither white space nor the end follows white space."""
        return self.plain.encode_to_numpy(text, disallowed_special=())

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.array(self.file.encode(text, add_special_tokens=False).ids, np.uint32)
        encoding = self.encoding if _SPACE_RUN(text) else self.plain
        return encoding.encode_to_numpy(text, disallowed_special=())


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is a visible Latin-1 one, else the next from U+0100 on."""
    visible = [b for b in range(256) if unicodedata.category(chr(b)) not in ("Cc", "Zs", "Cf")]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One for each worker process and file."""
    return Tokenizer(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, row_key, row, ids, n): little-endian 16-bit ids (32-bit where the vocabulary needs them) and the end id."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            ids = [np.append(tok.ids(t.decode("utf-8", "replace")), np.uint32(end_id)) for t in texts_of(b.column(2))]
            wide = [x.astype("<u4") if x.max() >= 1 << 16 else x.astype("<u2") for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in wide], pa.binary()), pa.array(map(len, ids), pa.int64())], ["doc_id", "row_key", "ids", "n"])

    ids = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(run, "doc_id long, row_key long, ids binary, n long")
    return ids.select("doc_id", "row_key", F.monotonically_increasing_id().alias("row"), "ids", "n")


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the number of its documents that hold each id."""
    df = np.zeros(1 << 16, np.int64)
    for b in batches:
        for raw, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = np.unique(_ids(raw, n)).astype(np.int64)
            if t[-1] >= len(df):
                df = np.append(df, np.zeros(int(t[-1]) + 1 - len(df), np.int64))
            df[t] += 1
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held], pa.int64())], ["term", "df"])


class Shard:
    """The inverted index of one shard. Lists of documents by term, in order of term, with BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        terms, owners, counts = [], [], []
        for i, ids in enumerate(docs):
            t, c = np.unique(ids[:-1], return_counts=True)
            terms.append(t), owners.append(np.full(len(t), i, np.int32)), counts.append(c)
        self.query = [x.astype(np.int64) for x in terms]
        t, o, c = np.concatenate(terms).astype(np.int64), np.concatenate(owners), np.concatenate(counts)
        order = np.argsort(t, kind="stable")
        t, o, c = t[order], o[order], c[order].astype(np.float32)
        length = np.array([len(x) for x in docs], np.float32)[o]
        weight = idf[t].astype(np.float32) * c * (K1 + 1) / (c + K1 * (1 - B + B * length / mean_length))
        df = np.bincount(t, minlength=len(idf))
        common = df * DENSE_SHARE > len(docs)
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        # common terms: a matrix of at most DENSE_SHARE numbers a posting; the others: lists
        self.dense = np.zeros((len(docs), int(common.sum())), np.float32)
        held = common[t]
        self.dense[o[held], self.column[t[held]]] = weight[held]
        self.owner, self.weight = o[~held], weight[~held]
        self.first = np.concatenate([[0], np.cumsum(np.where(common, 0, df))])
        self.size = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of each document for all terms of the seed."""
        t = self.query[seed]
        at = self.column[t]
        asked = np.zeros(self.dense.shape[1], np.float32)
        asked[at[at >= 0]] = 1
        first, n = self.first[t], self.first[t + 1] - self.first[t]
        places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.dense @ asked + np.bincount(self.owner[places], self.weight[places], self.size)

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents that share a term with the seed, best first (ties by position)."""
        score = self.scores(seed)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


class _Unused:
    """Documents in order, less those that are used; what a window could not take is offered first to the next ones."""

    def __init__(self, names: list):
        self.names, self.used, self.at = names, np.zeros(len(names), bool), 0
        self.held: dict = {}  # name -> documents passed over, in order

    def next(self, here: set) -> int | None:
        """The first one whose name is not here; if all are, the first one."""
        while (name := next((n for n in self.held if n not in here), None)) is not None:
            waiting = self.held[name]
            while waiting and self.used[waiting[0]]:
                waiting.popleft()
            if waiting:
                return waiting.popleft()
            del self.held[name]
        while self.at < len(self.names):
            d = self.at
            self.at += 1
            if self.used[d]:
                continue
            if self.names[d] not in here:
                return d
            self.held.setdefault(self.names[d], deque()).append(d)
        return next((d for waiting in self.held.values() for d in waiting if not self.used[d]), None)


def fill(lengths: list[int], neighbours, window: int, names: list | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece: whole windows are cut from long documents, what is left seeds a window that its neighbours fill.

    names: documents of one name share no window while there are others.
    """
    names = list(range(len(lengths))) if names is None else names
    unused, seq = _Unused(names), 0
    seed, start, offset, here = None, 0, 0, set()
    while True:
        if seed is None:
            seed = unused.next(here)
            if seed is None:
                return
            unused.used[seed], start = True, 0
        queue = iter(())
        asked, d = seed, seed
        while d is not None:  # one window: the seed, then its neighbours, then whoever is next
            take = min(lengths[d] - start, window - offset)
            yield d, start, take, seq, offset
            here.add(names[d])
            offset += take
            start += take
            left = d if start < lengths[d] else None
            if offset == window:
                seq, offset, seed, here = seq + 1, 0, left, set()
                break
            if asked is not None:
                queue, asked = iter(neighbours(asked)), None
            d = next((i for i in queue if not unused.used[i] and names[i] not in here), None)
            if d is None:
                d = unused.next(here)
            if d is None:
                return
            unused.used[d], start = True, 0


@lru_cache(maxsize=2)
def _directions(terms: int) -> np.ndarray:
    """A random direction for each term."""
    return np.random.RandomState(3).choice(np.array([-1, 1], np.float32), (terms, DIMS))


def vector(ids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The document's terms, weighted by idf and a damped count, projected and of length one."""
    t, c = np.unique(ids[:-1], return_counts=True)
    v = (idf[t] * c * (K1 + 1) / (c + K1)).astype(np.float32) @ _directions(len(idf)).take(t, axis=0) if len(t) else np.zeros(DIMS, np.float32)
    return v / max(1e-9, float(np.linalg.norm(v)))


class Tree:
    """Cuts that divide a weighted sample into leaves of about `limit`; a leaf has parts, which a hash deals."""

    def __init__(self, points: np.ndarray, weights: np.ndarray, limit: float):
        self.cuts: list[tuple[np.ndarray, float, int, int]] = []  # direction, threshold, below and above: a cut, or ~leaf
        self.leaves: list[tuple[int, int]] = []  # first shard, parts
        self.shards = 0
        self.root = self._grow(points, weights, limit)

    def _grow(self, x: np.ndarray, w: np.ndarray, limit: float) -> int:
        found = _cut(x, w) if w.sum() > limit else None
        if found is None:
            parts = max(1, -(-int(w.sum()) // max(1, int(limit))))
            self.leaves.append((self.shards, parts))
            self.shards += parts
            return ~(len(self.leaves) - 1)
        direction, at = found
        low, here = x @ direction <= at, len(self.cuts)
        self.cuts.append((direction, at, 0, 0))
        self.cuts[here] = (direction, at, self._grow(x[low], w[low], limit), self._grow(x[~low], w[~low], limit))
        return here

    def shard(self, x: np.ndarray, draw: int) -> int:
        n = self.root
        while n >= 0:
            direction, at, below, above = self.cuts[n]
            n = below if x @ direction <= at else above
        first, parts = self.leaves[~n]
        return first + draw % parts


def _cut(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Between two means if each side has a seventh of the weight, else the widest gap in the middle half of it; None if all points are one."""
    d = x - np.average(x, axis=0, weights=w)
    if float(np.abs(d).max(initial=0)) < 1e-4:
        return None
    side = d @ d[int(np.argmax((d * d).sum(axis=1)))] > 0
    direction, one, two = np.zeros(x.shape[1], np.float32), x[0], x[0]
    for _ in range(12):
        if side.all() or not side.any():
            break
        one, two = np.average(x[side], axis=0, weights=w[side]), np.average(x[~side], axis=0, weights=w[~side])
        direction = (one - two).astype(np.float32)
        side = x @ direction > (one + two) @ direction / 2
    p = x @ direction
    if 1 / 7 <= w[~side].sum() / w.sum() <= 6 / 7:
        return direction, float((one + two) @ direction / 2)
    order = np.argsort(p, kind="stable")
    share, gaps = np.cumsum(w[order]) / w.sum(), np.diff(p[order])
    middle = np.flatnonzero((share[:-1] >= 0.25) & (share[:-1] <= 0.75))
    middle = middle if len(middle) and gaps[middle].max() > 1e-6 else np.arange(len(gaps))
    if not len(middle) or gaps[middle].max() <= 1e-6:
        return None
    k = middle[int(np.argmax(gaps[middle]))]
    return direction, float((p[order[k]] + p[order[k + 1]]) / 2)


def deal(ids: DataFrame, idf: np.ndarray, n_docs: int, n_tokens: int, shard_tokens: int) -> DataFrame:
    """ids with shard."""
    if n_tokens <= shard_tokens:
        return ids.withColumn("shard", F.lit(0).cast("long"))
    spark, wanted = ids.sparkSession, min(SAMPLE_MAX, max(4000, SAMPLE * n_tokens // shard_tokens))
    given = spark.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [vector(_ids(raw, n), given.value).astype("<f2").tobytes() for raw, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary()), b.column(2)], ["row_key", "v", "n"])

    drawn = ids if wanted >= n_docs else ids.where(F.pmod(F.xxhash64("row_key", "row", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * wanted / n_docs))
    rows = sorted(map(tuple, drawn.select("row_key", "ids", "n").mapInArrow(vectors, "row_key long, v binary, n long").collect()))  # at most about SAMPLE_MAX
    w = np.array([r[2] for r in rows], np.float64)
    tree = spark.sparkContext.broadcast(Tree(np.array([np.frombuffer(r[1], "<f2") for r in rows], np.float32).reshape(-1, DIMS), w * n_tokens / max(1.0, w.sum()), shard_tokens))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            draws = (xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), seed=r) for k, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            at = [tree.value.shard(vector(_ids(raw, n), given.value), draw) for draw, raw, n in zip(draws, b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], ["doc_id", "row_key", "row", "ids", "n", "shard"])

    return ids.mapInArrow(dealt, "doc_id long, row_key long, row long, ids binary, n long, shard long")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text: the end id alone. Null doc_id: packed, with a null doc_id. Repeated rows are packed each on its own, in different windows
    while their shard has other documents.
    A document of any length is cut into whole windows. An empty table gives an empty result. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    ids = written(tokenized(docs, tokenizer_path or default_tokenizer(), end_id), "ids")
    df = ids.select("ids", "n").mapInArrow(_terms_of, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # bounded by the vocabulary
    n_docs, n_tokens = ids.agg(F.count("*"), F.sum("n")).first()
    idf = np.zeros(max([1 << 16, *(r.term + 1 for r in df)]), np.float32)
    for r in df:
        idf[r.term] = np.log(1 + (n_docs - r.df + 0.5) / (r.df + 0.5))
    mean_length = max(1.0, (n_tokens or 0) / max(1, n_docs))
    given = spark.sparkContext.broadcast((idf, mean_length))  # an entry for each id of the vocabulary

    def run(table: pa.Table) -> pa.Table:
        idf, mean = given.value
        table = table.sort_by([("row_key", "ascending"), ("row", "ascending")])
        ids = [_ids(raw, n) for raw, n in zip(table["ids"].to_pylist(), table["n"].to_pylist(), strict=True)]
        shard = Shard(ids, idf, mean)
        names, base, out = table["doc_id"].to_pylist(), table["shard"][0].as_py() << 32, []
        for d, start, length, seq, offset in fill([len(x) for x in ids], shard.neighbours, window, [f"row {i}" if n is None else n for i, n in enumerate(names)]):
            out.append((names[d], start, length, zlib.crc32(ids[d][start : start + length].astype("<u4").tobytes()), len(ids[d]), base + seq, offset))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return deal(ids, idf, n_docs, n_tokens or 0, shard_tokens).groupBy("shard").applyInArrow(run, PIECES)

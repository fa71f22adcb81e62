"""Document fingerprints of closed syncmers.

A k-mer of code points is a closed syncmer if the least of its s-mers stands at its first or last place. That depends on
the k-mer alone, so an edit moves no anchor outside the k-mers it touches. A document's fingerprint holds its ANCHORS
anchors of least hash, each with its place; two fingerprints match in the anchors that both hold and that stand, up to a
shift which most of them share, at the same places.

A fingerprint of all anchors is had with anchors=None; the README says how far the likeness by ANCHORS is from it.

Each document is also compared with the next one in descending doc_id and with a text that begins as it does and goes on
as the next one does. Next documents are found without a global order: the rows are dealt into buckets of ascending
doc_id, and the first row of a bucket is dealt to the bucket before it too. Rows of one doc_id, or without any, are in
order of a hash of their text, by which they have several buckets where they are many.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of

K, S = 24, 12
ANCHORS = 96
BUCKET_ROWS = 10_000
_SUB = 1 << 24  # bound of the buckets of one doc_id
_CHUNK = 1 << 17
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _mers(c: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k code points, by doubling: runs of 2, 4, ... and of what is left."""
    parts, size, at, out = c, 1, 0, None
    while at < k:
        if k & size:
            here = parts[at : at + len(c) - k + 1]
            out = here if out is None else out * _M + here
            at += size
        size *= 2
        if at < k:
            parts = _mixed(parts[: len(parts) - size // 2] * _M + parts[size // 2 :])
    return _mixed(out)


def syncmers(c: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the closed syncmers of an array of code points; a text shorter than k is one anchor as a whole."""
    if len(c) < k:
        return (np.zeros(1, np.int64), _mers(c.astype(np.uint64), len(c))) if len(c) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    places, hashes = [], []
    for i in range(0, len(c) - k + 1, _CHUNK):
        x = c[i : i + _CHUNK + k - 1].astype(np.uint64)
        h = _mers(x, s)
        n, m, step, inner = len(x) - k + 1, h, 1, k - s + 1
        while step < inner:
            by = min(step, inner - step)
            m = np.minimum(m[:-by], m[by:])
            step += by
        at = np.flatnonzero((h[:n] == m) | (h[k - s :][:n] == m))
        whole = _mixed(h[at] * _M + h[at + k - s]) if k <= 2 * s else _mers(x, k)[at]
        places.append(at + i), hashes.append(whole)
    return np.concatenate(places), np.concatenate(hashes)


def sketch(c: np.ndarray, anchors: int | None = ANCHORS) -> dict[int, int]:
    """hash -> place of so many anchors of least 32-bit hash, or all; a hash that repeats keeps its first place."""
    places, hashes = syncmers(c)
    short = (hashes >> np.uint64(32)).astype(np.int64)
    if anchors and len(short) > 8 * anchors:  # sorting fewer: all that are not above the bound hold the least ones
        near = short <= np.partition(short, 4 * anchors)[4 * anchors]
        short, places = (short[near], places[near]) if len(np.unique(short[near])) >= anchors else (short, places)
    values, first = np.unique(short, return_index=True)
    return dict(zip(values[:anchors].tolist(), places[first[:anchors]].tolist(), strict=True))


def written_out(anchors: dict[int, int]) -> str:
    """hash@place in hexadecimal, in order of hash."""
    return ",".join(f"{h:08x}@{p:x}" for h, p in sorted(anchors.items()))


def likeness(a: dict[int, int], b: dict[int, int], anchors: int | None = ANCHORS, slack: int = 8) -> float:
    """The share of anchors, of the least ones of both or of all, that both hold at places which differ by the same shift (give or take slack)."""
    if not a or not b:
        return float(a == b)
    union = sorted({*a, *b})[:anchors]
    shifts = [b[h] - a[h] for h in union if h in a and h in b]
    if not shifts:
        return 0.0
    shift = min(Counter(shifts).items(), key=lambda x: (-x[1], abs(x[0]), x[0]))[0]
    return sum(abs(x - shift) <= slack for x in shifts) / len(union)


def _code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (bucket, lent, doc_id, text_hash, packed) in partitions that hold whole buckets, sorted so that each row but a lent one is followed by its next one.

    Buckets have about bucket_rows rows. Tasks read them one row after the other, so their size bounds no memory; the driver
    holds a cut and a head for each. Equal rows, that is copies with one doc_id, are in one bucket.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    ids = rows.select("doc_id", "text_hash")
    n = max(1, -(-ids.count() // bucket_rows))
    found = ids.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    hot = {r.doc_id: min(_SUB, -(-r["count"] // bucket_rows)) for r in ids.groupBy("doc_id").count().where(F.col("count") > 2 * bucket_rows).collect()}  # fewer than buckets
    alone = [c for d in hot if d is not None for c in (d, max(d - 1, -(1 << 63)))]
    cuts = np.array(sorted({*(found or []), *alone}), np.int64)
    parts = np.ones(len(cuts) + 2, np.int64)
    for d, k in hot.items():
        parts[0 if d is None else 1 + int(np.searchsorted(cuts, d))] = k

    def buckets(doc_id: pa.Array, text_hash: pa.Array) -> np.ndarray:
        """Ascending with doc_id; of one bucket's parts the first hashes are above."""
        at = np.where(np.array(doc_id.is_null()), 0, 1 + np.searchsorted(cuts, doc_id.fill_null(0).to_numpy(zero_copy_only=False)))
        high = (text_hash.to_numpy(zero_copy_only=False) >> 40) + (1 << 23)  # 24 bits, in the order of the signed hash
        return at * _SUB + _SUB - 1 - high * parts[at] // (1 << 24)

    def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(buckets(*b.columns), pa.int64()), *b.columns], ["bucket", "doc_id", "text_hash"])

    # in descending order a bucket starts with its largest id, and of its texts the least hash: its head, which is lent to the next bucket above; the first head of all is lent to the last bucket
    first = F.min(F.struct(F.bitwise_not("doc_id").alias("below"), "doc_id", "text_hash"))
    heads = ids.mapInArrow(heads_of, "bucket long, doc_id long, text_hash long").groupBy("bucket").agg(first.alias("head")).orderBy("bucket").collect()
    lend = {(r.bucket, r["head"]["doc_id"], r["head"]["text_hash"]): heads[(i + 1) % len(heads)].bucket for i, r in enumerate(heads)}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = []
            for k, d, h, t in zip(buckets(b.column(0), b.column(1)).tolist(), b.column(0).to_pylist(), b.column(1).to_pylist(), map(z.compress, texts_of(b.column(2))), strict=True):
                out.append((k, 0, d, h, t))
                if (k, d, h) in lend:
                    out.append((lend[k, d, h], 1, d, h, t))
            if out:
                k, lent, d, h, t = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(lent, pa.int32()), pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(t, pa.binary())], ["bucket", "lent", "doc_id", "text_hash", "packed"])

    dealt = rows.mapInArrow(packed, "bucket long, lent int, doc_id long, text_hash long, packed binary").repartition(max(1, len(heads)), "bucket")
    return dealt.sortWithinPartitions("bucket", "lent", F.col("doc_id").desc_nulls_last(), "text_hash", "packed")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch], anchors: int | None = ANCHORS) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    held = None  # (bucket, doc_id, code points, sketch) of the row that waits for its next one

    def result(now: tuple, after: tuple) -> tuple:
        _, d, c, own = now
        cut = len(c) // 3
        edited = np.concatenate([c[: len(c) - cut], after[2][:cut]])
        new = sketch(edited, anchors)
        sha = hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest()
        return d, len(c), sha, written_out(own), written_out(new), likeness(own, new, anchors), likeness(own, after[3], anchors)

    for b in batches:
        out = []
        for bucket, lent, d, _, packed in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if lent and (held is None or held[0] != bucket):
                continue  # more than one row has the id that is lent: the first is the next one
            c = _code_points(z.decompress(packed))
            row = (bucket, d, c, sketch(c, anchors))
            if held is not None and held[0] == bucket:
                out.append(result(held, row))
            held = None if lent else row
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))], [x.split()[0] for x in RESULT.split(", ")])


def fingerprint_pairs(docs: DataFrame, anchors: int | None = ANCHORS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    Rows follow each other in descending doc_id, null ids last, rows with equal ids in a fixed order of their text; after the last comes the first.
    Null text is empty: an empty fingerprint, which is like an empty one only. A table of one row is its own next. An empty table gives an empty result.
    Other columns are not read.
    """
    return with_next(docs, bucket_rows).mapInArrow(partial(_compared, anchors=anchors), RESULT)

"""Substring deduplication over a log-structured index of window fingerprints.

A window is WINDOW consecutive words. Each window is named by its minimizer, the least hash of the GRAM-word grams in it:
equal windows have equal minimizers. Successive windows with one minimizer form a span; its words, and so all its
windows, are named by one 128-bit hash. An index entry is (minimizer, span hash, document, first and last window), one
for about (WINDOW - GRAM) / 2 windows.

Documents come in batches of ascending doc_id. The index is a folder of immutable runs, tables sorted by minimizer that
hold the first occurrence of each span, and a log of which runs are in force. A batch is merge-joined with the runs: a span
that a run or a smaller document of the batch holds is a repeat as a whole. What is left is new: it is joined by minimizer
with the runs and within the batch, which finds the spans that may share some of their windows; then it becomes a run of
level 0. FAN_IN runs of a level are compacted into one of the next, so an entry is rewritten as often as there are levels,
the logarithm of the number of batches. The spans found are verified window by window, by 128-bit hashes of the words
themselves. A later job opens the folder and adds its documents to what is there.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, freed_shuffles, packed, scratch, settled, small_batches, texts_of, unpacked, written

WINDOW, GRAM = 50, 12
BATCHES, FAN_IN = 3, 4  # batches of a table that is given at once; runs of a level
_B1, _B2, _BG = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))
KEY = ["doc_id", "text_key"]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """Hashes of the words of one text, of its windows and of their minimizers."""

    def __init__(self, text: bytes, window: int = WINDOW, gram: int = GRAM):
        self.words, self.window, self.gram = text.split(), window, gram
        self.n = len(self.words)
        self.windows = max(0, self.n - window + 1)
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if self.windows:
            self.x = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=7), self.words), np.uint64, self.n)

    def hashes(self, base: np.uint64, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """A polynomial hash mod 2^64 of the words from each start; equal word sequences have equal hashes wherever they stand."""
        with np.errstate(over="ignore"):
            if int(base) not in self._sums:
                up = _powers(base, self.n)
                down = _powers(np.uint64(pow(int(base), -1, 1 << 64)), self.n)
                self._sums[int(base)] = (np.concatenate([[np.uint64(0)], np.cumsum(self.x * up[: self.n], dtype=np.uint64)]), down)
            sums, down = self._sums[int(base)]
            return _mix((sums[starts + lengths] - sums[starts]) * down[starts])

    def minimizers(self) -> np.ndarray:
        """For each window the least hash of its grams."""
        m = self.hashes(_BG, np.arange(self.n - self.gram + 1), self.gram)
        left, step = self.window - self.gram + 1, 1
        while step < left:
            by = min(step, left - step)
            m = np.minimum(m[:-by], m[by:])
            step += by
        return m

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(minimizer, first window, last window) of each run of windows with one minimizer."""
        m = self.minimizers()
        first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        return m[first], first, np.append(first[1:], len(m)) - 1


RUN = "doc_id long, text_key long, m long, h1 long, h2 long, a int, b int"
SPANS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("m", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
STARTS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("a", pa.int32())])


def _spans(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for d, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                w = Words(t, window, gram)
                if w.windows:
                    m, a, b = w.spans()
                    n = b - a + window
                    got.append((np.full(len(m), d), np.full(len(m), k), m.view(np.int64), w.hashes(_B1, a, n).view(np.int64), w.hashes(_B2, a, n).view(np.int64), a.astype(np.int32), b.astype(np.int32)))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got, strict=True)], schema=SPANS)

    return run


def _starts(window: int):
    """The windows of the spans to verify: text with arrays a, b of their first and last windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, k, t, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), unpacked(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                w = Words(t, window)
                at = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b, strict=True)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d)), pa.array(np.full(len(at), k)), pa.array(w.hashes(_B1, at, window).view(np.int64)), pa.array(w.hashes(_B2, at, window).view(np.int64)), pa.array(at.astype(np.int32))], schema=STARTS)

    return run


LOG = "run string, level int, replaces array<string>, last_id long"


class FingerprintIndex:
    """Sorted immutable runs of first occurrences in a folder all executors share; whoever opens the folder later goes on from them.

    add() takes batches of ascending doc_id. Runs and log are only ever added to: a run that has been compacted is named in
    `replaces`, so a job that is lost midway leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.path = (path or scratch(spark, "window-index")).rstrip("/")
        self.log: list[tuple[str, int, list[str], int]] = []
        if path:
            with contextlib.suppress(AnalysisException):  # a new folder
                self.log = [(r.run, r.level, r.replaces, r.last_id) for r in spark.read.schema(LOG).parquet(f"{self.path}/log").collect()]  # a row for each run that was written

    def runs(self) -> list[tuple[str, int]]:
        """Names and levels of the runs in force."""
        gone = {r for _, _, replaced, _ in self.log for r in replaced}
        return [(run, level) for run, level, _, _ in self.log if run not in gone]

    def last_id(self) -> int | None:
        """The largest doc_id of what has been added."""
        return max((last for *_, last in self.log), default=None)

    def _read(self, run: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{self.path}/{run}")

    def history(self) -> DataFrame | None:
        runs = [self._read(run) for run, _ in self.runs()]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def add(self, batch: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame]:
        """(repeats, doubtful): spans of the batch that are repeats as a whole; spans, old and new, that share a minimizer and are to be verified.

        A batch that none will follow need not be kept.
        """
        known, ids = self.last_id(), batch.agg(F.min("doc_id"), F.max("doc_id")).first()
        if known is not None and ids[0] is not None and ids[0] <= known:
            raise ValueError(f"doc_ids up to {known} are in the index; a batch must be above them and begins at {ids[0]}")
        name = ["m", "h1", "h2"]
        first = batch.groupBy(*name).agg(F.min("doc_id").alias("first_id"))
        old = self.history()
        if old is not None:
            seen = old.select(*name, F.col("doc_id").alias("old_id"))  # a span is in one run: later ones leave out what is known
            first = first.join(seen, name, "left").select(*name, F.least("first_id", "old_id").alias("first_id"))  # least() skips nulls
        # joined by fewer columns than it is dealt by, so that both sides are dealt anew and AQE can split a frequent span
        judged = written(batch.join(first.drop("m"), ["h1", "h2"]).select(*batch.columns, "first_id"), "spans")
        repeats = judged.where("first_id < doc_id").select(*KEY, "a", "b")
        new = judged.where("first_id = doc_id").drop("first_id")
        pool = new if old is None else new.unionByName(old.select(*new.columns))
        shared = pool.groupBy("m", F.xxhash64("m")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("m")
        doubtful = written(pool.join(shared, "m", "left_semi").select(*KEY, "a", "b"), "doubtful")
        if keep and ids[1] is not None:
            self._write(new, 0, [], ids[1])
            self.compact()
        return repeats, doubtful

    def compact(self) -> None:
        """Merges the runs of each level that has fan_in of them into one of the next."""
        level = 0
        while level <= max((lv for _, lv in self.runs()), default=-1):
            full = [run for run, lv in self.runs() if lv == level]
            if len(full) >= self.fan_in:
                self._write(reduce(DataFrame.unionByName, map(self._read, full)), level + 1, full, self.last_id())
            level += 1

    def _write(self, df: DataFrame, level: int, replaces: list[str], last_id: int) -> None:
        """A run: one row for each span, sorted by minimizer. A span that a document repeats needs one entry."""
        run = f"run-{uuid.uuid4().hex}"
        one = df.groupBy("m", "h1", "h2").agg(F.min(F.struct("doc_id", "text_key", "a", "b")).alias("s")).select("s.doc_id", "s.text_key", "m", "h1", "h2", "s.a", "s.b")
        with freed_shuffles(self.spark):
            one.sortWithinPartitions("m").write.option("compression", "zstd").parquet(f"{self.path}/{run}")
        entry = (run, level, replaces, last_id)
        self.spark.createDataFrame([entry], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        self.log.append(entry)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, fan_in: int = FAN_IN, index: FingerprintIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_key, ranges): the repeated windows of each document that has any, as ranges of first and last window.

    index: one that has documents of smaller ids already (with the same window and gram), and is given these too; earlier: those documents, of which
    only such are read as may share a window.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def keyed_by(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").where("doc_id is not null and text is not null")

    keyed, own = keyed_by(docs), index is None
    index = index or FingerprintIndex(spark, fan_in=fan_in)
    if index.log and earlier is None:
        raise ValueError("the index has documents already: give them as `earlier`")
    cuts = keyed.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    number = sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts or []), F.lit(0))
    spans = written(keyed.mapInArrow(_spans(window, gram), RUN).withColumn("batch", number), "fingerprints", "batch")
    repeats, doubtful = [], []
    for i in range(batches):
        r, d = index.add(spans.where(F.col("batch") == i).drop("batch"), keep=i + 1 < batches or not own)
        repeats.append(r), doubtful.append(d)
    lists = reduce(DataFrame.unionByName, doubtful).distinct().groupBy(*KEY).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    texts = keyed if earlier is None else keyed.unionByName(keyed_by(earlier))
    starts = written(packed(texts, "text").join(lists, KEY).select(*KEY, "text", "a", "b").mapInArrow(_starts(window), "doc_id long, text_key long, w1 long, w2 long, a int"), "windows")
    first = starts.groupBy("w1", "w2", F.xxhash64("w1", "w2")).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("w1", "w2", "first_id")
    verified = starts.join(first, ["w1", "w2"]).where("first_id < doc_id").select(*KEY, "a", F.col("a").alias("b"))
    found = reduce(DataFrame.unionByName, [*repeats, verified]).groupBy(*KEY).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    return found if earlier is None else found.join(keyed.select("doc_id").distinct(), "doc_id", "left_semi")


def _kept(words: list[bytes], ranges: list[dict] | None, window: int) -> list[bytes]:
    if not ranges:
        return words
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, [r["a"] for r in ranges], 1)
    np.add.at(cover, [r["b"] + window for r in ranges], -1)
    gone = np.cumsum(cover[:-1]) > 0
    return [w for w, g in zip(words, gone, strict=True) if not g]


def _with_ranges(docs: DataFrame, window: int, **options) -> DataFrame:
    """docs, its text packed, and as the last column the ranges (whatever the names of docs)."""
    found = settled("ranges", repeated_windows, docs.select("doc_id", "text"), window=window, **options)
    key, ranges, found_id, found_key = (free_name(docs, n) for n in ("text_key", "ranges", "found_id", "found_key"))
    keyed = packed(docs.withColumn(key, F.xxhash64("text")), "text")
    found = found.select(F.col("doc_id").alias(found_id), F.col("text_key").alias(found_key), F.col("ranges").alias(ranges))
    return keyed.join(found, (F.col("doc_id").cast("long") == F.col(found_id)) & (F.col(key) == F.col(found_key)), "left").select(*docs.columns, ranges)


def removal_digests(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row; the kept words are joined by one space.

    Null text: no words. Null doc_id: no document is smaller or larger, nothing is removed. Repeated rows get the same result and do
    not remove each other. Texts under `window` words have no window. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [(t or b"").split() for t in unpacked(b.column(1))]
            kept = [_kept(w, r, window) for w, r in zip(words, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, words), pa.int64()), pa.array([len(w) - len(k) for w, k in zip(words, kept, strict=True)], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    small_batches(docs.sparkSession)
    return _with_ranges(docs.select("doc_id", "text"), window=window, **options).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """docs with repeated words taken out of text. Untouched texts stay as they are; a text that loses words is its kept words, joined by one space.

    A document that loses all its words goes. If there is a column n_chars it follows the text. Other columns are kept, whatever
    their names. Nulls, repeated rows and short texts as in removal_digests().
    """
    marked = _with_ranges(docs, window=window, **options)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            ranges = b.column(len(names)).to_pylist()
            out = [t if not r else b" ".join(_kept(t.split(), r, window)) for t, r in zip(unpacked(b.column(at)), ranges, strict=True)]
            live = pa.array([not r or bool(t) for t, r in zip(out, ranges, strict=True)])
            cols = [pa.array(out, pa.binary()).cast(pa.string()) if i == at else c for i, c in enumerate(b.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays(cols, names).filter(live)

    out = marked.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out

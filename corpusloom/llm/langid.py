"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The regression is trained with FTRL-proximal and elastic-net penalties and calibrated by a temperature. Document
frequencies come from all training rows. The regression itself is fitted on a bounded sample of the different rows, drawn by a hash of doc_id and
text: FIT_ROWS rows expected, and of each language LANGUAGE_ROWS or all it has, so that a rare one is learned as well. Rows that
are equal count as one, so that neither many copies nor many rows with one id or none make the sample larger or empty.
Predictions read nothing but the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fold, free_name, small_batches, texts_of

BUCKETS = 1 << 13  # hashed n-grams
FIT_ROWS = 2000  # bound of the fitting sample (expected rows),
LANGUAGE_ROWS = 100  # which has so many more of each language at most
MIN_SCORE = 0.3  # a pipeline rejects predictions below this probability
LETTER = regex.compile(r"\p{L}")  # not the fractions, roman and circled numerals that re takes for letters
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_CHUNK = 1 << 18


def ngram_counts(text: bytes) -> np.ndarray | None:
    """Counts of hashed character 1-, 2- and 3-grams of the lower-cased letters of a whole text; None if it has no letter."""
    whole = text.decode("utf-8", "replace")
    if not LETTER.search(whole):
        return None
    letters = _NOT_LETTERS.sub(" ", whole.lower())
    c = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    counts = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(c), _CHUNK):
        x = c[i : i + _CHUNK + 2]
        one = x[:_CHUNK] * np.uint64(0x9E3779B97F4A7C15)
        two = (x[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[1:] * np.uint64(0x165667B19E3779F9))[:_CHUNK]
        three = (x[:-2] * np.uint64(0xFF51AFD7ED558CCD) + x[1:-1] * np.uint64(0xC4CEB9FE1A85EC53) + x[2:] * np.uint64(0x2545F4914F6CDD1D))[:_CHUNK]
        for h in (one, two, three):
            counts += np.bincount((h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS)
    return counts


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: for each bucket the number of its rows that hold it; bucket -1 counts the rows."""
    df, rows = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        for t in texts_of(b.column(0)):
            if (c := ngram_counts(t)) is not None:
                df += c > 0
                rows += 1
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1), pa.int64()), pa.array(np.append(df[held], rows), pa.int64())], ["bucket", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_hash, lang, index, count) of the fitting sample."""
    for b in batches:
        ids, langs, idx, val = [], [], [], []
        for d, t, lang in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
            if (c := ngram_counts(t)) is not None:
                nz = np.flatnonzero(c)
                ids.append(d), langs.append(lang), idx.append(nz.astype(np.int32)), val.append(c[nz].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.int32()))], ["row_hash", "lang", "idx", "val"])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1, languages), the last row is the bias
    temperature: float = 1.0

    def features(self, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        x = np.log1p(val) * self.idf[idx]
        return x / max(np.sqrt(x @ x), 1e-12)

    def probabilities(self, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        z = (self.features(idx, val) @ self.weights[idx] + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, text: bytes) -> tuple[str, float]:
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return "und", 0.0
        idx = np.flatnonzero(counts)
        p = self.probabilities(idx, counts[idx])
        return self.languages[int(p.argmax())], float(p.max())


def _ftrl(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> None:
    """FTRL-proximal, one step a row; weights that the L1 penalty holds at zero stay exactly zero."""
    k = len(model.languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for y, idx, val in rows:
            at = np.append(idx, BUCKETS)
            x = np.append(model.features(idx, val), 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    model.weights = weights(slice(None))


def _temperature(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> float:
    """The temperature of least negative log-likelihood on rows that the regression has not seen."""
    if not rows:
        return 1.0
    logits = np.array([model.features(i, v) @ model.weights[i] + model.weights[-1] for _, i, v in rows])
    gold = np.array([y for y, _, _ in rows])

    def loss(t: float) -> float:
        s = logits / t
        s -= s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(gold)), gold]).mean())

    return float(min(np.geomspace(0.05, 5.0, 60), key=loss))


def train(docs: DataFrame, fit_rows: int = FIT_ROWS, language_rows: int = LANGUAGE_ROWS, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001) -> Model:
    """Learns from text and non-null lang of the rows whose crc32(doc_id) mod 3 is not 1; rows without doc_id are learned from. No such row: a model that says `und`."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang").where((F.coalesce(fold(F.col("doc_id"), 3), F.lit(0)) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    stats = {r.bucket: r.n for r in rows.select("text").mapInArrow(_document_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    n = stats.pop(-1, 0)
    df = np.zeros(BUCKETS)
    df[list(stats)] = list(stats.values())
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    keyed = rows.withColumn("row_hash", F.xxhash64(F.lit("langid"), "doc_id", "text"))
    # different rows by language, to a few per cent; counted, not drawn, so that the expected number holds whatever repeats
    sizes = {r.lang: r.n for r in keyed.groupBy("lang").agg(F.approx_count_distinct("row_hash", 0.02).alias("n")).collect()}  # a row a language
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, max(fit_rows / max(1, sum(sizes.values())), language_rows / m))) for lang, m in sizes.items()], "fit_lang string, share double")
    drawn = keyed.join(F.broadcast(shares), F.col("lang") == F.col("fit_lang")).where(F.pmod("row_hash", F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    drawn = drawn.groupBy("row_hash", "lang").agg(F.first("text").alias("text"))
    sample = drawn.select("row_hash", "text", "lang").mapInArrow(_sparse, "row_hash long, lang string, idx array<int>, val array<int>").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["row_hash"] * 0x9E3779B97F4A7C15 & (1 << 64) - 1, r["lang"], r["idx"], r["val"]))
    model = Model(sorted({r["lang"] for r in sample}), idf, np.zeros((BUCKETS + 1, 0)))
    at = {lang: i for i, lang in enumerate(model.languages)}
    data = [(at[r["lang"]], np.array(r["idx"], np.int64), np.array(r["val"], float)) for r in sample]
    if not data:
        return model
    held = data[::6] if len(data) >= 60 else []
    _ftrl(model, [x for i, x in enumerate(data) if not held or i % 6], epochs, alpha, beta, l1, l2)
    model.temperature = _temperature(model, held)
    return model


def predict(docs: DataFrame, model: Model, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns lang_pred and score, in place of what has these names. lang_pred is `und`, score 0, if text is null or has no letter."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in (lang_pred, score)]
    frame = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t) for t in texts_of(b.column(names.index("text")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], [*names, lang_pred, score])

    schema = StructType([*frame.schema.fields]).add(lang_pred, "string").add(score, "double")
    return frame.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row.

    Null doc_id: learned from, never held out. Repeated rows and copies: each gets the same prediction.
    An empty table gives an empty result. Columns besides doc_id, text and lang are not read.
    """
    model = train(docs)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows with a language: not `und`, and a calibrated probability of min_score or more. Columns of docs are kept as they are, also a lang_pred or score of its own."""
    lang_pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    return predict(docs, train(docs), lang_pred, score).where((F.col(lang_pred) != "und") & (F.col(score) >= min_score)).select(*docs.columns)

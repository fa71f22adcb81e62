"""A hidden Markov language model, trained by Baum-Welch over all training documents.

A state emits a word class and the class emits a word: P(word | state) = e[state, class] * (c + 1) / (n_class + v_class + 1),
with c the word's count in training and n_class, v_class the tokens and distinct words of its class; what the sum leaves
is the class's unknown word. A class is a hash of a word's last letters, so any word has one without a look-up, and the
states' tables have a fixed size. The end of a text is a token of a class of its own and closes the sequence.

Words are counted over all training documents. The HEAD most frequent words go to every task; the other counts, which
grow with the corpus, are joined by a shuffle on the words that need them. Expected counts of each Baum-Welch round are
summed across partitions; the forward recursion is scaled, and scores are exact log-likelihoods of whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches, texts_of, written

CLASSES = 1024  # the last one is the end of a text
STATES, ROUNDS = 6, 3
HEAD = 1 << 16  # bound of the word counts that every task gets
SMOOTH = 0.1
SEED = 11
_FLUSH = 200_000
_CELLS, _BUFFER = 400_000, 2_000_000  # of classes: in a group and in a block of the recursions, held by a task
END = CLASSES - 1


class _Classes(dict):
    """word -> class, by its last three letters; a word that is new is hashed. Emptied when it has grown to a fixed size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _FLUSH:
            self.clear()
        self[word] = c = xxhash.xxh32_intdigest(word.decode("utf-8", "replace")[-3:]) % END
        return c


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (word, class, n) of the tokens of some texts; the end token is the empty word."""
    seen, classes = Counter(), _Classes()

    def flush() -> pa.RecordBatch:
        words = list(seen)
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([classes[w] if w else END for w in words], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "class", "n"])
        seen.clear()
        return out

    for b in batches:
        for t in texts_of(b.column(0)):
            seen.update(t.lower().split())
            seen[b""] += 1
            if len(seen) > _FLUSH:
                yield flush()
    yield flush()


class Recursions:
    """Scaled forward and backward recursions of one model, over groups of class sequences."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (K,), (K, K), (CLASSES, K)

    @staticmethod
    def groups(seqs: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(positions, lengths, classes by time) of sequences of like length, the longest first; a group has _CELLS cells, or one sequence."""
        order, i = sorted(range(len(seqs)), key=lambda k: -len(seqs[k])), 0
        while i < len(order):
            at = order[i : i + max(1, _CELLS // len(seqs[order[i]]))]
            i += len(at)
            n = np.array([len(seqs[j]) for j in at])
            x = np.full((n[0], len(at)), END, np.int16)
            for k, j in enumerate(at):
                x[: n[k], k] = seqs[j]
            yield at, n, x

    @staticmethod
    def live(n: np.ndarray, steps: int) -> list[int]:
        """How many sequences, the longest first, reach each time."""
        return np.searchsorted(-n, -np.arange(1, steps + 1), side="right").tolist()

    def likelihoods(self, n: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Natural log-likelihoods."""
        scale, a = np.ones(x.shape), None
        for t, m in enumerate(self.live(n, len(x))):
            a = (self.start if a is None else a[:m] @ self.move) * self.emit[x[t, :m]]
            s = a.sum(axis=1)
            a /= s[:, None]
            scale[t, :m] = s
        return np.log(scale).sum(axis=0)

    def _forward(self, a: np.ndarray | None, e: np.ndarray, live: list[int], alpha: np.ndarray | None, scale: np.ndarray | None) -> np.ndarray | None:
        """The last row of scaled alphas of a block of times, after the row a before it; alpha and scale get all of them."""
        for t, m in enumerate(live):
            a = (self.start if a is None else a[:m] @ self.move) * e[t, :m]
            s = a.sum(axis=1)
            a /= s[:, None]
            if alpha is not None:
                alpha[t, :m], scale[t, :m] = a, s
        return a

    def expected(self, n: np.ndarray, x: np.ndarray, totals: tuple[np.ndarray, np.ndarray, np.ndarray], cells: int = _CELLS) -> float:
        """Adds the expected counts of starts, moves and emissions to totals; returns the log-likelihood.

        Times are worked on in blocks of about `cells` cells, the last first: a first pass keeps the alphas each block begins
        after, from which they are computed again. So memory does not grow with the length of a sequence, and no sequence is cut.
        """
        starts, moves, emits = totals
        live, k, log = self.live(n, len(x)), len(self.start), 0.0
        step = max(1, cells // x.shape[1])
        blocks, before = range(0, len(x), step), [None]
        for lo in blocks[:-1]:
            before.append(self._forward(before[-1], self.emit[x[lo : lo + step]], live[lo : lo + step], None, None))
        after, back = None, self.move.T  # after: what a move to the first time of the block behind is weighed by
        for lo, a in zip(reversed(blocks), reversed(before), strict=True):
            xs, ms = x[lo : lo + step], live[lo : lo + step]
            e = self.emit[xs]
            alpha, scale = np.zeros((*xs.shape, k)), np.ones(xs.shape)
            self._forward(a, e, ms, alpha, scale)
            log += float(np.log(scale).sum())
            e /= scale[..., None]
            beta = np.ones_like(alpha)
            if after is not None:
                beta[-1, : len(after)] = after @ back
                moves += self.move * (alpha[-1, : len(after)].T @ after)
            for t in range(len(xs) - 2, -1, -1):
                m = ms[t + 1]
                e[t + 1, :m] *= beta[t + 1, :m]  # from here on e holds what a move to this time is weighed by
                beta[t, :m] = e[t + 1, :m] @ back
            for t, m in enumerate(ms):
                e[t, m:] = 0
            moves += self.move * (alpha[:-1].reshape(-1, k).T @ e[1:].reshape(-1, k))
            after = e[0, : ms[0]] * beta[0, : ms[0]]
            alpha *= beta
            at = xs.ravel()
            for s in range(k):
                emits[:, s] += np.bincount(at, weights=alpha[..., s].ravel(), minlength=CLASSES)
            if lo == 0:
                starts += alpha[0].sum(axis=0)
        return log


def first_guess(states: int = STATES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, move and emission tables: states that tend to stay, and emissions that differ at random, so that Baum-Welch can part them."""
    rng = np.random.default_rng(seed)
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    emit = rng.dirichlet(np.full(CLASSES, 2.0), states).T
    return np.full(states, 1.0 / states), move / move.sum(axis=1, keepdims=True), emit


def _runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[list[np.ndarray]]:
    """Class sequences of some batches together, _BUFFER classes or so, so that groups have sequences of like length."""
    held, size = [], 0
    for b in batches:
        for raw in b.column(column).to_pylist():
            held.append(np.frombuffer(raw, "<u2"))
            size += len(held[-1])
        if size > _BUFFER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _expectations(model: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Per task: the sums of expected counts as (index, value) of the tables laid end to end; the log-likelihood comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Recursions(*model)
        totals = tuple(np.zeros_like(x) for x in model)
        log = 0.0
        for seqs in _runs(batches):
            for _, n, x in r.groups(seqs):
                log += r.expected(n, x, totals)
        flat = np.concatenate([*(x.ravel() for x in totals), [log]])
        held = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(flat[held])], ["at", "value"])

    return run


def baum_welch(sequences: DataFrame, rounds: int = ROUNDS, states: int = STATES, smooth: float = SMOOTH) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[float]]:
    """The tables after so many rounds over all of sequences (a binary column of 16-bit classes), and the log-likelihood that each round began with."""
    model, logs = first_guess(states), []
    sizes = np.cumsum([states, states * states])
    for _ in range(rounds):
        rows = sequences.mapInArrow(_expectations(model), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # bounded by the tables
        flat = np.zeros(states + states * states + CLASSES * states + 1)
        for row in rows:
            flat[row["at"]] = row["value"]
        start, move, emit = flat[: sizes[0]] + smooth, flat[sizes[0] : sizes[1]].reshape(states, states) + smooth, flat[sizes[1] : -1].reshape(CLASSES, states) + smooth
        model = (start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        logs.append(float(flat[-1]))
    return model, logs


def score(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Rows learn whose crc32(doc_id as text) mod 7 is not 2 (a null doc_id learns). Null text is empty: the end token alone.
    Repeated rows count and are scored each on its own. An empty table gives an empty result. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held_out = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    counts = written(rows.where("not held_out").select("text").mapInArrow(_counts, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n")), "word-counts")
    by_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # a row for each class
    total, distinct = sum(r.n for r in by_class), sum(r.v for r in by_class)
    log_class = np.zeros(CLASSES)  # log10 of n_class + v_class + 1; the end of a text is one word, which is known
    for r in by_class:
        log_class[r["class"]] = math.log10(r.n + r.v + 1)
    # the most frequent words by steps of an eighth of an octave, as many whole steps as the head has room for
    step = F.floor(F.log2("n") * 8)
    room, cut = head, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).orderBy(F.desc("step")).collect():  # some hundred rows
        if r.v > room:
            break
        room, cut = room - r.v, r.step
    top = [] if cut is None else [r for r in counts.where(step >= F.lit(cut)).collect() if r.word]
    ends = next((r.n for r in by_class if r["class"] == END), 0)
    places = {bytes(r.word): i for i, r in enumerate(top)}
    table = spark.sparkContext.broadcast((places, np.array([r["class"] for r in top], np.int32), np.array([math.log10(r.n + 1) for r in top]), log_class))  # at most `head` words

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (places, head_class, head_log, log_class), classes = table.value, _Classes()
        place = places.get
        for b in batches:
            out = []
            for t in texts_of(b.column(2)):
                words = t.lower().split()
                at = np.fromiter(map(place, words, repeat(-1)), np.int32, len(words))
                outside = np.flatnonzero(at < 0).tolist()
                known = at[at >= 0]
                seq = np.full(len(words) + 1, END, np.uint16)
                seq[:-1][at >= 0] = head_class[known]
                rest = [words[i] for i in outside]
                seq[outside] = [classes[w] for w in rest]
                tail = Counter(rest)
                out.append((seq.astype("<u2").tobytes(), len(words) + 1, float(head_log[known].sum()), len(known), float(log_class[seq[:-1]].sum()), list(tail), list(tail.values())))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c[0], pa.binary()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.float64()), pa.array(c[5], pa.list_(pa.binary())), pa.array(c[6], pa.list_(pa.int32()))], ["doc_id", "held_out", "seq", "n_tokens", "head_log", "head_n", "class_log", "tail", "times"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    kept = rows.mapInArrow(prepared, f"doc_id {id_type}, held_out boolean, seq binary, n_tokens long, head_log double, head_n long, class_log double, tail array<binary>, times array<int>")
    kept = written(kept.withColumn("row", F.monotonically_increasing_id()), "token-classes")
    # the tail: words outside the head, none of which has a large part of the rows
    tail = kept.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    rest = tail.join(counts.select("word", "n"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_log"), F.sum("times").alias("tail_n"))
    model, _ = baum_welch(kept.where("not held_out").select("seq"), rounds, states)

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Recursions(*model)
        for b in batches:
            seqs = [np.frombuffer(x, "<u2") for x in b.column(0).to_pylist()]
            log = np.zeros(len(seqs))
            for at, n, x in r.groups(seqs):
                log[at] = r.likelihoods(n, x)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(log / math.log(10))], ["row", "doc_id", "held_out", "n_tokens", "head_log", "head_n", "class_log", "hmm"])

    hmm = kept.select("seq", "row", "doc_id", "held_out", "n_tokens", "head_log", "head_n", "class_log").mapInArrow(likelihoods, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, head_log double, head_n long, class_log double, hmm double")
    words = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
    end_log = math.log10(ends + 1)
    return hmm.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_n") + F.coalesce("tail_n", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (words + F.lit(end_log) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("hmm") + words - F.col("class_log")).alias("score"),
    )

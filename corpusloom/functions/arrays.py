"""Signals and feature matrices as array columns: deltas, masks, padding, levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row, however often and how deep in lambdas it is used."""
    return F.transform(F.array(value), use)[0]


def rounded(value: Column | str, digits: int) -> Column:
    """A double rounded half away from zero after it is scaled by a power of ten, as C and SQL engines do; what rounds to zero keeps its sign.

    F.round takes the decimal digits that a double is printed with, so that a value a few units of its last place from a tie goes to the
    other side, and has no negative zero.
    """
    v = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.signum(v) * F.abs(F.round(v * scale) / scale)


def draw(bound: int | Column, *key: Column | str) -> Column:
    """An integer in [0, bound) from the MD5 of a key, the same in any engine."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
    return number % (F.lit(bound) if isinstance(bound, int) else bound)


def uniform(low: float, high: float, *key: Column | str) -> Column:
    return F.lit(low) + draw(1 << 30, *key) / float(1 << 30) * (high - low)


def deltas(x: Column, window: int = 2) -> Column:
    """The slope of each value of a matrix over `window` frames to both sides; the ends repeat."""
    norm = 2.0 * sum(k * k for k in range(1, window + 1))

    def slopes(m: Column) -> Column:
        def at(t: Column) -> Column:
            return F.element_at(m, F.greatest(F.lit(1), F.least(t, F.size(m))).cast("int"))

        def one(f: Column, t: Column) -> Column:
            out = F.transform(f, lambda _: F.lit(0.0))
            for k in range(1, window + 1):
                out = F.zip_with(out, F.zip_with(at(t + 1 + k), at(t + 1 - k), lambda a, b: (a - b) * k), lambda a, b: a + b)
            return F.transform(out, lambda v: v / norm)

        return F.transform(m, one)

    return bound(x, slopes)


def with_deltas(x: Column, window: int = 2, order: int = 2) -> Column:
    """A matrix with its deltas, their deltas and so on beside it."""
    out = now = x
    for _ in range(order):
        now = deltas(now, window)
        out = F.zip_with(out, now, lambda a, b: F.concat(a, b))
    return out


def louder(x: Column, ratio: Column | float, db: bool = True) -> Column:
    """A signal times a ratio, which is in decibels unless db is false."""
    r = F.lit(ratio) if isinstance(ratio, (int, float)) else ratio
    return F.transform(x, lambda v: v * (F.pow(F.lit(10.0), r / 20.0) if db else r))


def _mean(x: Column) -> Column:
    total = F.aggregate(x, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda a, f: F.struct((a["s"] + F.aggregate(f, F.lit(0.0), lambda p, q: p + q)).alias("s"), (a["n"] + F.size(f)).alias("n")))
    return total["s"] / total["n"]


def _inside(i: Column, spans: Column, masks: int) -> Column:
    out = F.lit(False)
    for k in range(masks):
        out = out | ((i >= spans[k]["a"]) & (i < spans[k]["b"]))
    return out


def _spans(size: Column, width: int, masks: int, name: str, key: Column | str, draws: Callable[..., Column] = draw) -> Column:
    """An array of (a, b), start and end of masks: a width f under `width`, a start under size - f, and then a width of its own draw; none where f is zero or fills the size."""
    out = []
    for k in range(masks):
        f = draws(width, key, name, str(k), "f")
        start = draws(F.greatest(size - f, F.lit(1)), key, name, str(k), "s")
        end = start + draws(width, key, name, str(k), "e")
        out.append(F.struct(start.alias("a"), F.when((f == 0) | (size - f <= 0), start).otherwise(end).alias("b")))
    return F.array(*out)


def freq_mask(x: Column, key: Column | str, width: int = 30, masks: int = 2, to_mean: bool = False) -> Column:
    """Stretches of places set to zero (or the mean) in all frames; key seeds the draws."""
    if not masks:
        return x
    drawn = F.struct(_spans(F.size(x[0]), width, masks, "freq", key).alias("spans"), (_mean(x) if to_mean else F.lit(0.0)).alias("fill"))
    return bound(drawn, lambda d: F.transform(x, lambda f: F.transform(f, lambda v, i: F.when(_inside(i, d["spans"], masks), d["fill"]).otherwise(v))))


def time_mask(x: Column, key: Column | str, width: int = 40, masks: int = 2, to_mean: bool = False) -> Column:
    """Stretches of frames set to zero (or the mean)."""
    if not masks:
        return x
    drawn = F.struct(_spans(F.size(x), width, masks, "time", key).alias("spans"), (_mean(x) if to_mean else F.lit(0.0)).alias("fill"))
    return bound(drawn, lambda d: F.transform(x, lambda f, t: F.when(_inside(t, d["spans"], masks), F.transform(f, lambda _: d["fill"])).otherwise(f)))


def bandpass(x: Column, key: Column | str, low: float = 0.0, high: float = 0.75) -> Column:
    """Places of a matrix kept or set to zero: a share in [low, high) of them goes, each by its own uniform draw."""
    share = uniform(low, high, key, "band")
    drawn = bound(share, lambda s: F.transform(F.sequence(F.lit(0), F.size(x[0]) - 1), lambda i: uniform(0.0, 1.0, key, i.cast("string")) >= s))
    return bound(drawn, lambda keep: F.transform(x, lambda f: F.zip_with(f, keep, lambda v, k: F.when(k, v).otherwise(F.lit(0.0)))))


def joined_frames(a: Column, b: Column) -> Column:
    """Two matrices side by side; they may differ by one frame, which goes."""
    n = F.least(F.size(a), F.size(b))
    fits = F.abs(F.size(a) - F.size(b)) < 2
    both = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda p, q: F.concat(p, q))
    return F.when(fits, both).otherwise(F.raise_error(F.lit("frames differ by two or more")).cast("array<array<double>>"))


def same_length(x: Column, size: Column) -> Column:
    """A signal cut at both ends, or filled up with zeros at both ends, to a length."""
    d = size - F.size(x)
    cut = F.slice(x, F.floor(-d / 2).cast("int") + 1, size)
    zeros = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda _: F.lit(0.0))
    left, right = F.floor(d / 2).cast("int"), (d - F.floor(d / 2)).cast("int")
    filled = F.concat(F.slice(zeros(left), F.lit(1), left), x, F.slice(zeros(right), F.lit(1), right))
    return F.when(d > 0, filled).otherwise(cut)


def padded(x: Column, size: Column, fill: Column | float = 0.0) -> Column:
    """x with fill behind it up to a size."""
    f = F.lit(fill) if isinstance(fill, (int, float)) else fill
    return F.concat(x, F.array_repeat(f, F.greatest(size - F.size(x), F.lit(0))))


def length_mask(n: Column, size: Column) -> Column:
    """True for the first n of size places."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: i < n)


def rms(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))

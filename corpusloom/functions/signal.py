"""Signal kernels that Column functions can't express, in Arrow batches of array columns.

Each kernel is a small numpy function of one signal; `applied` runs it over a column of a DataFrame. Seeds come from the utterance id, so
that a retried task draws the same.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType


def applied(df: DataFrame, column: str, kernel: Callable[..., np.ndarray], returns: str, *inputs: Column, many: Callable[..., list] | None = None) -> DataFrame:
    """df with column replaced by kernel over each row's column and inputs (arrays and scalars); a null one gives null.

    If df has a column `error`, a row that fails has its reason there and null in column; else the job fails. many does the same for a
    list of rows' columns and lists of their inputs, and gives a list of arrays, or of errors in their places.
    """
    isolated = "error" in df.columns
    names = [f"_in{i}" for i in range(len(inputs))]
    given = df.withColumns(dict(zip(names, inputs, strict=True))) if inputs else df
    rest = [f for f in df.schema.fields if f.name != column]
    kept, kind = [f.name for f in rest], to_arrow_type(_parsed(returns))

    def one(*row):
        try:
            return kernel(*row)
        except Exception as e:
            if not isolated:
                raise
            return e

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns = [_values(part.column(c)) for c in [column, *names]]
            out: list = [None] * part.num_rows
            whole = [i for i, row in enumerate(zip(*columns, strict=True)) if all(x is not None for x in row)]
            for some in _stretches(whole, columns[0]) if many else [whole]:
                rows = [[c[i] for i in some] for c in columns]
                for i, y in zip(some, many(*rows) if many else map(one, *rows), strict=True):
                    out[i] = y
            failed = {i: y for i, y in enumerate(out) if isinstance(y, Exception)}
            if failed and not isolated:
                raise next(iter(failed.values()))
            held = [part.column(c) for c in kept]
            if failed:
                at = kept.index("error")
                held[at] = pa.array([f"{type(failed[i]).__name__}: {failed[i]}" if i in failed else e for i, e in enumerate(held[at].to_pylist())], held[at].type)
            yield pa.RecordBatch.from_arrays([*held, _lists([None if i in failed else y for i, y in enumerate(out)], kind)], [*kept, column])

    return given.mapInArrow(run, StructType([*rest, StructField(column, _parsed(returns))])).select(*df.columns)


def _stretches(rows: list[int], x: list, most: int = 1 << 19) -> Iterator[list[int]]:
    """rows in stretches that hold about `most` numbers of x."""
    some, size = [], 0
    for i in rows:
        some.append(i)
        size += x[i].size
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def _values(column: pa.Array) -> list:
    """Scalars, vectors or matrices of a column; None for null."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    ends, inner = column.offsets.to_numpy(), column.values
    counts = np.diff(ends).tolist()
    deep = pa.types.is_list(inner.type)
    if deep:
        ends, inner = inner.offsets.to_numpy()[ends], inner.values
    flat, ends = inner.to_numpy(zero_copy_only=False), ends.tolist()
    out = [flat[a:b].reshape(n, -1) if deep and n else flat[a:b] for a, b, n in zip(ends, ends[1:], counts, strict=False)]
    return [x if ok else None for x, ok in zip(out, column.is_valid().to_pylist(), strict=True)] if column.null_count else out


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    """Vectors or matrices (None: null) as an array of lists, or of lists of lists."""
    deep = pa.types.is_list(kind.value_type)
    leaf = kind.value_type.value_type if deep else kind.value_type
    there = [np.asarray(y) for y in rows if y is not None]
    flat = np.concatenate([y.reshape(-1) for y in there]) if there else np.zeros(0)
    values = pa.array(flat.astype(leaf.to_pandas_dtype(), copy=False), leaf)
    if deep:
        wide = np.concatenate([np.full(len(y), y.shape[1] if y.ndim > 1 else 0, np.int64) for y in there]) if there else np.zeros(0, np.int64)
        values = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(wide)), pa.int32()), values)
    ends = np.append(0, np.cumsum([0 if y is None else len(y) for y in rows]))
    missing = np.array([y is None for y in rows], bool)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(missing)) if missing.any() else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _parsed(ddl: str) -> DataType:
    return StructType.fromDDL(f"x {ddl}")["x"].dataType


def random_of(*key: object) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32("|".join(map(str, key)).encode()))


# ---- features


def frame_matrix(x: np.ndarray, rate: float, length_ms: float = 25.0, shift_ms: float = 10.0) -> np.ndarray:
    """Whole frames of a signal: 1 + (n - w) // s of them."""
    w, s = int(rate * length_ms / 1000), int(rate * shift_ms / 1000)
    n = 1 + (len(x) - w) // s if len(x) >= w else 0
    if n <= 0:
        raise RuntimeError(f"a signal of {len(x)} samples has no frame of {w}")
    return x[np.arange(n)[:, None] * s + np.arange(w)].astype(np.float64)


def power_spectrum(x: np.ndarray, rate: float, length_ms: float = 25.0, shift_ms: float = 10.0, emphasis: float = 0.97) -> np.ndarray:
    """Frames without their mean, pre-emphasised, under a Hann window to the power 0.85, as powers of a transform of 2^k points."""
    return _powers_of(frame_matrix(x, rate, length_ms, shift_ms), emphasis)


def _powers_of(f: np.ndarray, emphasis: float = 0.97) -> np.ndarray:
    f = f - f.mean(axis=1, keepdims=True)
    f = f - emphasis * np.concatenate([f[:, :1], f[:, :-1]], axis=1)
    w = f.shape[1]
    f = f * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(w) / (w - 1))) ** 0.85
    return np.abs(np.fft.rfft(f, 1 << (w - 1).bit_length(), axis=1)) ** 2


def mel(hz: np.ndarray | float) -> np.ndarray:
    return 1127.0 * np.log(1.0 + np.asarray(hz) / 700.0)


def mel_weights(bins: int, points: int, rate: float, low: float = 20.0) -> np.ndarray:
    """(bins, points // 2) triangles of equal width on the mel scale, from `low` to half the rate."""
    edges = np.linspace(mel(low), mel(rate / 2), bins + 2)
    at = mel(np.arange(points // 2) * rate / points)
    left, mid, right = (edges[i : i + bins, None] for i in range(3))
    return np.maximum(0.0, np.minimum((at - left) / (mid - left), (right - at) / (right - mid)))


_EPS = float(np.finfo(np.float32).eps)


def log_spectrogram(x: np.ndarray, rate: float, length_ms: float = 25.0, shift_ms: float = 10.0) -> np.ndarray:
    """Log powers; the first place holds the log energy of the frame."""
    f = frame_matrix(x, rate, length_ms, shift_ms)
    out = np.log(np.maximum(power_spectrum(x, rate, length_ms, shift_ms), _EPS))
    f = f - f.mean(axis=1, keepdims=True)
    out[:, 0] = np.log(np.maximum((f * f).sum(axis=1), _EPS))
    return out.astype(np.float32)


def fbank(x: np.ndarray, rate: float, bins: int = 80, length_ms: float = 25.0, shift_ms: float = 10.0) -> np.ndarray:
    """Log mel energies without dither."""
    return _fbank_of(frame_matrix(x, rate, length_ms, shift_ms), rate, bins)


def _fbank_of(f: np.ndarray, rate: float, bins: int) -> np.ndarray:
    p = _powers_of(f)
    points = 2 * (p.shape[1] - 1)
    return np.log(np.maximum(p[:, : points // 2] @ mel_weights(bins, points, rate).T, _EPS)).astype(np.float32)


def pitch(x: np.ndarray, rate: float, length_ms: float = 25.0, shift_ms: float = 10.0, low: float = 50.0, high: float = 400.0, change: float = 0.1) -> np.ndarray:
    """(voicing, log pitch minus its weighted mean nearby, its slope) of each frame.

    Lags are scored by normalised autocorrelation and a path through them by dynamic programming that charges for changes of log lag.
    """
    f = frame_matrix(x, rate, length_ms, shift_ms)
    f = f - f.mean(axis=1, keepdims=True)
    lags = np.arange(max(2, int(rate / high)), min(int(rate / low), f.shape[1] - 2) + 1)
    if not len(lags):
        raise RuntimeError("frames are too short for the lowest pitch")
    score = np.stack([(f[:, :-k] * f[:, k:]).sum(axis=1) / np.sqrt((f[:, :-k] ** 2).sum(axis=1) * (f[:, k:] ** 2).sum(axis=1) + 1e-9 * (f * f).sum(axis=1) + 1e-12) for k in lags], axis=1)
    cost = change * np.abs(np.log(lags)[:, None] - np.log(lags)) * 10
    best, back = -score[0], []
    for t in range(1, len(f)):
        total = best[:, None] + cost
        back.append(total.argmin(axis=0))
        best = total.min(axis=0) - score[t]
    path = [int(best.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path = np.array(path[::-1])
    voiced = np.clip(score[np.arange(len(f)), path], 0.0, 1.0)
    logs = np.log(rate / lags[path])
    near = np.ones(min(151, 2 * len(f) - 1))
    same = lambda v: np.convolve(v, near)[len(near) // 2 :][: len(v)]
    centred = logs - same(logs * (voiced + 1e-6)) / same(voiced + 1e-6)
    at = np.pad(logs, 2, mode="edge")
    slope = (at[3:-1] - at[1:-3] + 2 * (at[4:] - at[:-4])) / 10
    return np.stack([voiced, centred, slope], axis=1).astype(np.float32)


def fbank_pitch(x: np.ndarray, rate: float, bins: int = 80, length_ms: float = 25.0, shift_ms: float = 10.0) -> np.ndarray:
    """fbank and pitch side by side; they may differ by one frame, which goes."""
    a, b = fbank(x, rate, bins, length_ms, shift_ms), pitch(x, rate, length_ms, shift_ms)
    if abs(len(a) - len(b)) > 1:
        raise RuntimeError("frames differ by two or more")
    n = min(len(a), len(b))
    return np.concatenate([a[:n], b[:n]], axis=1)


def fbank_pitch_many(xs: list[np.ndarray], rates: list[float], bins: int = 80, length_ms: float = 25.0, shift_ms: float = 10.0) -> list[np.ndarray | Exception]:
    """fbank_pitch() of many signals side by side: one transform for all frames, and a step of the paths for all signals that are as long. Signals that fail have their errors."""
    out: list = [None] * len(xs)
    for rate in sorted(set(rates)):
        rows = [i for i, r in enumerate(rates) if r == rate]
        w, s = int(rate * length_ms / 1000), int(rate * shift_ms / 1000)
        lags = np.arange(max(2, int(rate / 400.0)), min(int(rate / 50.0), w - 2) + 1)
        good = []
        for i in rows:
            if len(xs[i]) >= w and len(lags) and s > 0:
                good.append(i)
                continue
            try:
                out[i] = fbank_pitch(xs[i], rate, bins, length_ms, shift_ms)
            except Exception as e:  # noqa: BLE001  it is the row's result
                out[i] = e
        if not good:
            continue
        good.sort(key=lambda i: -len(xs[i]))
        sizes = np.array([len(xs[i]) for i in good])
        counts = 1 + (sizes - w) // s
        ends = np.cumsum(counts)
        starts = ends - counts
        within = np.arange(ends[-1]) - np.repeat(starts, counts)
        places = np.repeat(np.cumsum(sizes) - sizes, counts) + within * s
        frames = np.concatenate([xs[i] for i in good])[places[:, None] + np.arange(w)].astype(np.float64)
        banks, voice = _fbank_of(frames, rate, bins), _pitch_of(frames, rate, lags, starts, counts, 0.1)
        both = np.concatenate([banks, voice], axis=1)
        for i, a, b in zip(good, starts.tolist(), ends.tolist(), strict=True):
            out[i] = both[a:b]
    return out


def _pitch_of(f: np.ndarray, rate: float, lags: np.ndarray, starts: np.ndarray, counts: np.ndarray, change: float) -> np.ndarray:
    """pitch() of the frames of many signals, which stand one after the other, longest first."""
    f = f - f.mean(axis=1, keepdims=True)
    score = np.stack([(f[:, :-k] * f[:, k:]).sum(axis=1) / np.sqrt((f[:, :-k] ** 2).sum(axis=1) * (f[:, k:] ** 2).sum(axis=1) + 1e-9 * (f * f).sum(axis=1) + 1e-12) for k in lags], axis=1)
    cost = change * np.abs(np.log(lags)[:, None] - np.log(lags)) * 10
    longest = int(counts[0])
    alive = np.searchsorted(-counts, -np.arange(longest), side="left")  # signals with more than t frames
    best, back = -score[starts], np.zeros(score.shape, np.int64)
    for t in range(1, longest):
        m = alive[t]
        total, at = best[:m, :, None] + cost, starts[:m] + t
        back[at] = total.argmin(axis=1)
        best[:m] = total.min(axis=1) - score[at]
    path, now = np.zeros(len(f), np.int64), best.argmin(axis=1)
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        at = starts[:m] + t
        path[at] = now[:m]
        now[:m] = back[at, now[:m]]
    voiced = np.clip(score[np.arange(len(f)), path], 0.0, 1.0)
    logs = np.log(rate / lags[path])
    weight = voiced + 1e-6
    mean = np.repeat(np.add.reduceat(logs * weight, starts) / np.add.reduceat(weight, starts), counts)
    for a, n in zip(starts.tolist(), counts.tolist(), strict=True):
        if n <= 76:  # and all after it: the neighbourhood is the whole signal
            break
        near = np.ones(min(151, 2 * n - 1))
        same = lambda v: np.convolve(v, near)[len(near) // 2 :][: len(v)]  # noqa: B023, E731
        mean[a : a + n] = same((logs * weight)[a : a + n]) / same(weight[a : a + n])
    first, last, i = np.repeat(starts, counts), np.repeat(starts + counts - 1, counts), np.arange(len(f))
    at = lambda k: logs[np.clip(i + k, first, last)]
    slope = (at(1) - at(-1) + 2 * (at(2) - at(-2))) / 10
    return np.stack([voiced, logs - mean, slope], axis=1).astype(np.float32)


# ---- augmentation


def cubic_rows(x: np.ndarray, rows: int) -> np.ndarray:
    """A matrix with another number of rows, by cubic convolution (a = -0.5) that widens when it shrinks."""
    ratio = len(x) / rows
    reach = 2.0 * max(1.0, ratio)
    centre = (np.arange(rows) + 0.5) * ratio
    first = np.maximum(0, np.floor(centre - reach + 0.5)).astype(int)
    out = np.empty((rows, x.shape[1]))
    for i, (c, a) in enumerate(zip(centre, first, strict=True)):
        k = np.arange(a, min(len(x), int(c + reach + 0.5)))
        d = np.abs((k + 0.5 - c) / max(1.0, ratio))
        w = np.where(d < 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0.0))
        out[i] = (w / w.sum()) @ x[k]
    return out


def time_warp(x: np.ndarray, uttid: str, window: int = 80) -> np.ndarray:
    """The frames before a point and those after it resized, so that the point moves by less than window; unchanged if there are 2 * window frames or fewer."""
    n = len(x)
    if n - window <= window:
        return np.asarray(x)
    rng = random_of("time_warp", uttid)
    centre = int(rng.integers(window, n - window))
    moved = int(rng.integers(centre - window, centre + window)) + 1
    return np.concatenate([cubic_rows(x[:centre], moved), cubic_rows(x[centre:], n - moved)]).astype(np.float32)


def spline_warp(x: np.ndarray, uttid: str, window: int = 80) -> np.ndarray:
    """The middle of a frame moved in time by less than window, and all else with it by a polyharmonic spline of order two that leaves corners and middles of both ends in their places.

    The spline gives every place of the matrix its shift; its value is that between the two nearest frames where it came from. Unchanged if there are 2 * window frames or fewer.
    """
    x = np.asarray(x, np.float64)
    n, d = x.shape
    if n - window <= window:
        return x.astype(np.float32)
    rng = random_of("spline_warp", uttid)
    at, by = int(rng.integers(window, n - window)), int(rng.integers(1 - window, window))
    held = [(t, f) for t in (0.0, n - 1.0) for f in sorted({0.0, (d - 1) / 2, d - 1.0})]
    points = np.array([(at + by, (d - 1) / 2), *held])

    def bend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        square = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        return 0.5 * square * np.log(np.maximum(square, 1e-10))

    plane = np.column_stack([points, np.ones(len(points))])
    system = np.block([[bend(points, points), plane], [plane.T, np.zeros((3, 3))]])
    weights = np.linalg.lstsq(system, np.concatenate([[by], np.zeros(len(system) - 1)]), rcond=None)[0]
    grid = np.stack(np.meshgrid(np.arange(float(n)), np.arange(float(d)), indexing="ij"), axis=2).reshape(-1, 2)
    shift = (np.column_stack([bend(grid, points), grid, np.ones(len(grid))]) @ weights).reshape(n, d)
    came = np.clip(np.arange(n)[:, None] - shift, 0, n - 1)
    low = np.minimum(came.astype(int), n - 2)
    column = np.arange(d)
    return (x[low, column] + (came - low) * (x[low + 1, column] - x[low, column])).astype(np.float32)


PHASES = 256  # places between samples, up to which their taps are kept


def _taps(f: np.ndarray, cut: float, reach: int) -> np.ndarray:
    """Weights of the 2 * reach samples around places that are a part f behind a sample: a sinc under a raised cosine.

    Sines of differences follow from those of f and of the whole steps, so that none is taken for each tap.
    """
    j = np.arange(-reach + 1, reach + 1)
    a, b = np.pi * cut, np.pi / reach
    out = np.stack([np.sin(a * f), -np.cos(a * f)], axis=1) @ np.stack([np.cos(a * j), np.sin(a * j)])
    out *= 0.5 + np.stack([np.cos(b * f), np.sin(b * f)], axis=1) @ (0.5 * np.stack([np.cos(b * j), np.sin(b * j)]))
    d = np.pi * f[:, None] - np.pi * j
    near = [(np.abs(f - k) < 1e-6, reach - 1 + k) for k in (0, 1)]  # on a sample
    for rows, column in near:
        d[rows, column] = 1.0
    out /= d
    for rows, column in near:
        out[rows, column] = cut
    return out


@cache
def _phase_taps(up: int, down: int, cut: float, reach: int) -> np.ndarray:
    return _taps(np.arange(up) * down % up / up, cut, reach)


def resample(x: np.ndarray, rate: float, target: float, zeros: int = 32) -> np.ndarray:
    """A signal at another rate by windowed-sinc interpolation."""
    if rate == target or not len(x):
        return np.asarray(x)
    ratio = target / rate
    n = int(len(x) * ratio)
    cut = min(1.0, ratio) * 0.95
    reach = int(math.ceil(zeros / cut))
    padded = np.concatenate([np.zeros(reach - 1), np.asarray(x, float), np.zeros(reach)])
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach)
    out = np.zeros(n)
    share = Fraction(target) / Fraction(rate)
    up, down = share.numerator, share.denominator
    if up <= PHASES and down <= PHASES:  # the places between samples recur
        for phase, w in enumerate(_phase_taps(up, down, cut, reach)[: min(n, up)]):
            some = around[phase * down // up :: down]
            out[phase::up] = some[: -(-(n - phase) // up)] @ w
    else:
        for a in range(0, n, 1 << 9):  # what fits in a cache
            at = np.arange(a, min(n, a + (1 << 9))) / ratio
            first = at.astype(int)
            out[a : a + len(at)] = np.einsum("ij,ij->i", _taps(at - first, cut, reach), around[first])
    if np.issubdtype(np.asarray(x).dtype, np.integer):
        info = np.iinfo(np.asarray(x).dtype)
        return np.clip(np.rint(out), info.min, info.max).astype(np.asarray(x).dtype)
    return out.astype(np.asarray(x).dtype)


def speed(x: np.ndarray, uttid: str, low: float = 0.9, high: float = 1.1, keep_length: bool = True, ratio: float | None = None) -> np.ndarray:
    """A signal at ratio times its speed (drawn, if not given); at its old length if asked, cut or filled at both ends."""
    r = float(random_of("speed", uttid).uniform(low, high)) if ratio is None else ratio
    y = resample(np.asarray(x, np.float64), r, 1.0)
    d = len(x) - len(y)
    if not keep_length or d == 0:
        return y
    return y[(-d) // 2 :][: len(x)] if d < 0 else np.pad(y, (d // 2, d - d // 2))


def noisy(x: np.ndarray, uttid: str, noise: np.ndarray, low: float = -20.0, high: float = -5.0) -> np.ndarray:
    """A signal with noise at a level that is drawn in decibels against its own; no noise given: white. Noise is cut at a random place or repeated."""
    rng = random_of("noise", uttid)
    x = np.asarray(x, np.float64)
    level = 10 ** (rng.uniform(low, high) / 20) * np.sqrt((x * x).mean()) if len(x) else 0.0
    if not len(noise):
        return x + level * rng.standard_normal(len(x))
    n = np.asarray(noise, np.float64)
    n = n / max(np.sqrt((n * n).mean()), 1e-12)
    if len(n) > len(x):
        a = int(rng.integers(0, len(n) - len(x) + 1))
        n = n[a : a + len(x)]
    return x + level * np.resize(n, len(x))


def reverberant(x: np.ndarray, rir: np.ndarray) -> np.ndarray:
    """A signal through a room's response, of the signal's length; a response of several channels (rows) gives a column for each."""
    if np.ndim(x) != 1:
        raise RuntimeError("one channel is asked for")
    one = lambda r: np.convolve(x, r)[(len(r) - 1) // 2 :][: len(x)]
    return one(np.asarray(rir)) if np.ndim(rir) == 1 else np.stack([one(r) for r in rir], axis=1)

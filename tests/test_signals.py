"""Rows of the signal queries against plain loops."""

import cmath
import math

import pytest

from corpusloom import queries
from corpusloom.functions import signal
from corpusloom.plans.pipeline import Pipeline

SF = "/root/testdata/sf0.001"
RATE, LENGTH, SHIFT, POINTS = 400.0, 32, 8, 32


def rows(spark, name):
    return {r.uttid: r.x for r in queries.QUERIES[name](spark, SF).collect()}


@pytest.fixture(scope="module")
def signals(spark):
    return {r.uttid: r.x for r in queries._signals(spark, SF).collect()}


@pytest.fixture(scope="module")
def matrices(spark):
    return {r.uttid: r.x for r in queries._matrix_rows(spark, SF).collect()}


def frames(x):
    for a in range(0, len(x) - LENGTH + 1, SHIFT):
        f = x[a : a + LENGTH]
        m = sum(f) / LENGTH
        yield [v - m for v in f]


def powers(f):
    g = [f[0] - 0.97 * f[0]] + [f[i] - 0.97 * f[i - 1] for i in range(1, LENGTH)]
    g = [v * (0.5 - 0.5 * math.cos(2 * math.pi * i / (LENGTH - 1))) ** 0.85 for i, v in enumerate(g)]
    return [abs(sum(v * cmath.exp(-2j * math.pi * k * i / POINTS) for i, v in enumerate(g))) ** 2 for k in range(POINTS // 2 + 1)]


def mel(hz):
    return 1127.0 * math.log(1 + hz / 700.0)


def banks(p, bins=3):
    low, high = mel(20.0), mel(RATE / 2)
    out = []
    for b in range(bins):
        left, mid, right = (low + (high - low) * (b + i) / (bins + 1) for i in range(3))
        total = 0.0
        for k in range(POINTS // 2):
            m = mel(k * RATE / POINTS)
            w = (m - left) / (mid - left) if m <= mid else (right - m) / (right - mid)
            total += max(0.0, w) * p[k]
        out.append(math.log(max(total, 2.0**-23)))
    return out


def close(a, b, tolerance=1e-4):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        if isinstance(x, (list, tuple)):
            close(x, y, tolerance)
        else:
            assert x == pytest.approx(y, abs=tolerance, rel=tolerance)


def test_fbank_and_spectrogram(spark, signals):
    banked, spectra, pitched = rows(spark, "fbank"), rows(spark, "spectrogram"), rows(spark, "fbank_pitch_cmvn_delta")
    assert set(banked) == set(spectra) == set(pitched) == set(signals)
    ratio = Pipeline([{"type": "fbank", "sample_frequency": RATE, "num_mel_bins": 3, "frame_shift_ms": 20.0}]).length_ratio()
    for u, x in signals.items():
        cut = list(frames(x))
        power = [powers(f) for f in cut]
        close(banked[u], [banks(p) for p in power], 1e-3)
        close(spectra[u], [[math.log(max(sum(v * v for v in f), 2.0**-23)), *(math.log(max(v, 2.0**-23)) for v in p[1:])] for f, p in zip(cut, power, strict=True)], 1e-3)
        assert abs(len(x) * ratio - len(banked[u])) <= LENGTH / SHIFT  # the predicted number of frames


def test_pitch_takes_the_best_path(signals):
    """The path through the lags is the cheapest of all, by trying each of them on few frames and lags."""
    import itertools

    import numpy as np

    for u in sorted(signals)[:12]:
        x = np.array(signals[u][: LENGTH + 3 * SHIFT])
        got = signal.pitch(x, RATE, 80.0, 20.0, low=50.0, high=100.0)
        cut = list(frames(x.tolist()))
        lags = list(range(4, 9))

        def score(f, k):
            a, b = f[:-k], f[k:]
            own = sum(v * v for v in f)
            return sum(p * q for p, q in zip(a, b, strict=True)) / math.sqrt(sum(p * p for p in a) * sum(q * q for q in b) + 1e-9 * own + 1e-12)

        def cost(path):
            return sum(-score(f, k) for f, k in zip(cut, path, strict=True)) + sum(abs(math.log(p) - math.log(q)) for p, q in itertools.pairwise(path))

        best = min(itertools.product(lags, repeat=len(cut)), key=cost)
        close(got[:, 0].tolist(), [min(1.0, max(0.0, score(f, k))) for f, k in zip(cut, best, strict=True)], 1e-5)


def cubic(d):
    d = abs(d)
    return (1.5 * d - 2.5) * d * d + 1 if d < 1 else ((-0.5 * d + 2.5) * d - 4) * d + 2 if d < 2 else 0.0


def resized(x, n):
    ratio = len(x) / n
    wide = max(1.0, ratio)
    out = []
    for i in range(n):
        c = (i + 0.5) * ratio
        near = range(max(0, int(math.floor(c - 2 * wide + 0.5))), min(len(x), int(c + 2 * wide + 0.5)))
        w = [cubic((k + 0.5 - c) / wide) for k in near]
        out.append([sum(a * x[k][j] for a, k in zip(w, near, strict=True)) / sum(w) for j in range(len(x[0]))])
    return out


def test_time_warp(spark, matrices):
    got = rows(spark, "time_warp")
    assert set(got) == set(matrices)
    moved = 0
    for u, x in matrices.items():
        n = len(x)
        want = x
        if n > 10:
            rng = signal.random_of("time_warp", f"{u}|0")
            centre = int(rng.integers(5, n - 5))
            to = int(rng.integers(centre - 5, centre + 5)) + 1
            want = resized(x[:centre], to) + resized(x[centre:], n - to)
            moved += to != centre
        assert len(got[u]) == n
        close(got[u], want)
    assert moved


def test_spline_warp(spark, matrices):
    """The spline's conditions: the point is moved, the six at the ends are not, and each value lies between the two frames that its shift names, which a plain solution of the system gives."""
    import numpy as np

    got, moved = rows(spark, "spline_warp"), 0
    for u in sorted(matrices):
        x, n, d = matrices[u], len(matrices[u]), len(matrices[u][0])
        if n <= 10:
            close(got[u], x)
            continue
        rng = signal.random_of("spline_warp", f"{u}|0")
        at, by = int(rng.integers(5, n - 5)), int(rng.integers(-4, 5))
        moved += by != 0
        mid = (d - 1) / 2
        points = [(at + by, mid)] + [(t, f) for t in (0, n - 1) for f in (0, mid, d - 1)]
        bend = lambda p, q: 0.5 * r * math.log(r) if (r := (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) > 1e-10 else 0.0
        k = len(points)
        system = [[bend(p, q) for q in points] + [p[0], p[1], 1] for p in points] + [[p[i] if i < 2 else 1 for p in points] + [0, 0, 0] for i in range(3)]
        w = np.linalg.solve(np.array(system, float), [by] + [0] * (k + 2)).tolist()
        shift = lambda t, f: sum(a * bend((t, f), p) for a, p in zip(w, points, strict=False)) + w[k] * t + w[k + 1] * f + w[k + 2]
        assert shift(at + by, mid) == pytest.approx(by, abs=1e-6) and all(abs(shift(*p)) < 1e-6 for p in points[1:])
        for t in range(0, n, 7):
            for f in range(0, d, 5):
                c = min(max(t - shift(t, f), 0), n - 1)
                low = min(int(c), n - 2)
                assert got[u][t][f] == pytest.approx(x[low][f] + (c - low) * (x[low + 1][f] - x[low][f]), abs=1e-4)
    assert moved


def test_spec_augment_is_warp_and_masks(spark, matrices):
    warped, got = rows(spark, "time_warp"), rows(spark, "spec_augment")
    masked = 0
    for u, x in got.items():
        zero_columns = {j for j in range(len(x[0])) if all(f[j] == 0 for f in x)}
        zero_rows = {i for i, f in enumerate(x) if all(v == 0 for v in f)}
        for i, (f, g) in enumerate(zip(x, warped[u], strict=True)):
            for j, (v, w) in enumerate(zip(f, g, strict=True)):
                assert v == pytest.approx(w, abs=1e-5) or (v == 0 and (i in zero_rows or j in zero_columns))
        masked += bool(zero_columns or zero_rows)
    assert masked > len(got) / 2


def test_speed(spark, signals):
    got = rows(spark, "speed_perturb")
    for u in sorted(signals)[:25]:
        x = signals[u]
        r = float(signal.random_of("speed", f"{u}|0").uniform(0.9, 1.1))
        ratio, cut = 1.0 / r, min(1.0, 1.0 / r) * 0.95
        reach = math.ceil(32 / cut)
        y = []
        for i in range(int(len(x) * ratio)):
            c, total = i / ratio, 0.0
            for k in range(max(0, math.floor(c) - reach + 1), min(len(x), math.floor(c) + reach + 1)):
                d = c - k
                if abs(d) < reach:
                    sinc = 1.0 if d == 0 else math.sin(math.pi * cut * d) / (math.pi * cut * d)
                    total += x[k] * sinc * cut * (0.5 + 0.5 * math.cos(math.pi * d / reach))
            y.append(total)
        d = len(x) - len(y)
        want = y[(-d) // 2 :][: len(x)] if d < 0 else [0.0] * (d // 2) + y + [0.0] * (d - d // 2)
        close(got[u], want, 1e-6)


def level(x):
    return math.sqrt(sum(v * v for v in x) / len(x))


def test_noises(spark, signals):
    white, real = rows(spark, "noise_inject"), rows(spark, "noise_from_store")
    noises = {r.uttid: r.noise for r in queries.QUERIES["noise_store"](spark, SF).collect()}
    assert set(white) == set(real) == set(signals) == set(noises)
    for u, x in signals.items():
        rng = signal.random_of("noise", f"{u}|0")
        scale = 10 ** (rng.uniform(-20.0, -5.0) / 20) * level(x)
        close(white[u], [v + scale * float(z) for v, z in zip(x, rng.standard_normal(len(x)), strict=True)], 1e-6)
        rng = signal.random_of("noise", f"{u}|0")
        rng.uniform(-20.0, -5.0)
        n = [v / level(noises[u]) for v in noises[u]]
        a = int(rng.integers(0, len(n) - len(x) + 1)) if len(n) > len(x) else 0
        close(real[u], [v + scale * n[(a + i) % len(n)] for i, v in enumerate(x)], 2e-3)  # the store's query rounds to six places


def test_loader_gives_the_batches_of_its_plan(spark):
    """Iteration, next() over the end of an epoch, len() and num_utts agree with the plan."""
    from corpusloom.schema import utterances
    from corpusloom.streaming.loader import Loader

    u = utterances(spark, SF)
    index = u.select("uttid", "archive", u["num_frames"].alias("length"), "ord")
    payload = u.selectExpr("uttid", "array(array(cast(num_frames as double))) AS x", "100.0D AS rate")
    with Loader(index, payload, batch_size=8, max_len=900, shuffle=True, num_replicas=3, rank=1) as loader:
        plan = loader.own().collect()
        seen = [[i.uttid for i in items] for items in loader]
        assert len(seen) == len(loader) and sum(map(len, seen)) == loader.num_utts == len(plan)
        want = {}
        for r in sorted(plan, key=lambda r: (r.padded, r.batch, r.pos)):
            want.setdefault((r.padded, r.batch), []).append(r.uttid)
        assert seen == list(want.values())
        again = [[i.uttid for i in loader.next()] for _ in range(len(seen) + 1)]
        assert again[:-1] == seen and loader.epoch == 1
        loader.set_epoch(1)
        assert [i.uttid for i in next(iter(loader))] == again[-1]

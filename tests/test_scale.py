"""Steps that must not grow faster than their input, against the plain ways to do them."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import queries
from corpusloom.functions import signal
from corpusloom.operators import quality

SF = "/root/testdata/sf0.001"
RND = np.random.RandomState(5)


def test_parts_of_a_file_are_one_file(spark, tmp_path):
    """A file in parts is judged as a whole; a part that lacks its newline counts once."""
    for name, parts in {"good": [b"a\n", b"b\n"], "cut": [b"a", b"b"], "bad": [b"\xe9\n", b"a\xc2\xa0\n"], "spaced": [b"a\n", b"a\xc2\xa0\nb\xc2\xa0\n"]}.items():
        (tmp_path / name).mkdir()
        for i, raw in enumerate(parts):
            (tmp_path / name / f"{i}.txt").write_bytes(raw)
    found = quality.file_faults(spark, str(tmp_path), parts=True).collect()
    assert {(r.rule, r.key.rsplit("/", 1)[1], r.detail) for r in found} == {("file: no final newline", "cut", "1"), ("file: not UTF-8", "bad", "1"), ("file: illegal white space", "spaced", "2")}


def test_no_text_decides_a_shuffle(spark):
    """Prompts meet by a hash that is a column of its own, not by an expression of texts that go along."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.filter_prompts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert keys and all(re.fullmatch(r"\w+#\d+L?", k) for k in keys)


def plain(x, rate, target):
    """Windowed sinc, a tap at a time."""
    ratio = target / rate
    cut = min(1.0, ratio) * 0.95
    reach, out = math.ceil(32 / cut), []
    for i in range(int(len(x) * ratio)):
        c = i / ratio
        total = 0.0
        for k in range(max(0, math.floor(c) - reach + 1), min(len(x), math.floor(c) + reach + 1)):
            d = c - k
            sinc = cut if abs(d) < 1e-12 else math.sin(math.pi * cut * d) / (math.pi * d)
            total += x[k] * sinc * (0.5 + 0.5 * math.cos(math.pi * d / reach)) if abs(d) < reach else 0.0
        out.append(total)
    return out


@pytest.mark.parametrize("rates", [(400.0, 300.0), (300.0, 400.0), (400.0, 400.0 / 3), (0.9371, 1.0), (1.0813, 1.0), (8000.0, 16000.0)])
def test_resampled_as_by_loops(rates):
    for n in (1, 2, 40, 333):
        x = RND.randn(n) * 30
        assert np.allclose(signal.resample(x, *rates), plain(x, *rates), atol=1e-9, rtol=0)
    signal._phase_taps.cache_clear()
    for _ in range(3):
        signal.resample(RND.randn(50), 400.0, 300.0)
    assert signal._phase_taps.cache_info().misses == 1


def test_pitch_of_many_as_of_one(spark):
    xs = [RND.randn(n) * 30 for n in (40, 33, 700, 32, 5000, 40, 120, 650)] + [np.zeros(200), np.zeros(3)]
    got = signal.fbank_pitch_many(xs, [400.0] * len(xs), 3, 80.0, 20.0)
    for x, y in zip(xs[:-1], got, strict=False):
        want = signal.fbank_pitch(x, 400.0, 3, 80.0, 20.0)
        assert y.shape == want.shape and np.allclose(y, want, atol=1e-6)
    assert isinstance(got[-1], RuntimeError)
    df = spark.createDataFrame([(i, x.tolist(), None) for i, x in enumerate(xs)] + [(99, None, None)], "i int, x array<double>, error string")
    many = lambda x, r: signal.fbank_pitch_many(x, r, 3, 80.0, 20.0)
    back = {r.i: r for r in signal.applied(df, "x", lambda x, r: signal.fbank_pitch(x, r, 3, 80.0, 20.0), "array<array<float>>", F.lit(400.0), many=many).collect()}
    assert np.allclose(back[4].x, got[4]) and back[4].error is None and back[99].x is None and back[99].error is None
    assert back[9].x is None and back[9].error == "RuntimeError: a signal of 3 samples has no frame of 32"

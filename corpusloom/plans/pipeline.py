"""Transform configurations: lists of {type, options} applied to the column x in order.

A transform is a class with `apply(df, row) -> df`, which changes the column x; row gives the columns it may look up (uttid, rate).
Relational look-ups (statistics, ratios, noises) are joined by the caller before, as columns.
"""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, signal
from ..operators.stats import normalised, utterance_normalised


@dataclass
class Transform:
    """The base of transforms; in training some do what they leave out otherwise."""

    training_only: ClassVar[bool] = False

    def apply(self, df: DataFrame, row: Row) -> DataFrame:
        raise NotImplementedError


@dataclass
class Row:
    """Columns that transforms may use."""

    uttid: Column
    rate: Column
    epoch: int = 0
    extra: dict[str, Column] | None = None

    def key(self) -> Column:
        return F.concat_ws("|", self.uttid, F.lit(str(self.epoch)))


@dataclass
class Identity(Transform):
    def apply(self, df, row):
        return df


def _x(df: DataFrame, x: Column) -> DataFrame:
    return df.withColumn("x", x)


def _rate(row: Row, wanted: float) -> Column:
    wrong = F.raise_error(F.concat(F.lit(f"the rate must be {wanted:g}, not "), row.rate.cast("string"))).cast("double")
    return F.when(row.rate.isNull() | (row.rate == wanted), F.lit(float(wanted))).otherwise(wrong)


@dataclass
class Fbank(Transform):
    sample_frequency: float
    num_mel_bins: int
    frame_length_ms: float = 25.0
    frame_shift_ms: float = 10.0

    def apply(self, df, row):
        o = self
        return signal.applied(df, "x", lambda s, r: signal.fbank(s, r, o.num_mel_bins, o.frame_length_ms, o.frame_shift_ms), "array<array<float>>", _rate(row, self.sample_frequency))


@dataclass
class Spectrogram(Transform):
    sample_frequency: float
    frame_length_ms: float = 25.0
    frame_shift_ms: float = 10.0

    def apply(self, df, row):
        o = self
        return signal.applied(df, "x", lambda s, r: signal.log_spectrogram(s, r, o.frame_length_ms, o.frame_shift_ms), "array<array<float>>", _rate(row, self.sample_frequency))


@dataclass
class FbankPitch(Fbank):
    def apply(self, df, row):
        o = self
        one = lambda s, r: signal.fbank_pitch(s, r, o.num_mel_bins, o.frame_length_ms, o.frame_shift_ms)
        many = lambda s, r: signal.fbank_pitch_many(s, r, o.num_mel_bins, o.frame_length_ms, o.frame_shift_ms)
        return signal.applied(df, "x", one, "array<array<float>>", _rate(row, self.sample_frequency), many=many)


@dataclass
class Cmvn(Transform):
    """By statistics in the columns bias and scale of row.extra, or by an utterance's own."""

    cmvn_type: str = "utterance"
    norm_means: bool = True
    norm_vars: bool = False
    reverse: bool = False

    def apply(self, df, row):
        if self.cmvn_type == "utterance":
            return _x(df, utterance_normalised(F.col("x").cast("array<array<double>>"), self.norm_means, self.norm_vars))
        return _x(df, F.transform("x", lambda f: normalised(f, row.extra["bias"], row.extra["scale"], self.norm_means, self.norm_vars, self.reverse)))


@dataclass
class Delta(Transform):
    window: int = 2
    order: int = 2

    def apply(self, df, row):
        return _x(df, arrays.with_deltas(F.col("x").cast("array<array<double>>"), self.window, self.order))


@dataclass
class TimeWarp(Transform):
    training_only: ClassVar[bool] = True
    max_time_warp: int = 80
    mode: str = "PIL"

    def apply(self, df, row):
        kernels = {"PIL": signal.time_warp, "sparse_image_warp": signal.spline_warp}
        if self.mode not in kernels:
            raise ValueError(f"{self.mode} is none of {', '.join(kernels)}")
        w, kernel = self.max_time_warp, kernels[self.mode]
        return signal.applied(df, "x", lambda m, k: kernel(m, k, w), "array<array<float>>", row.key())


@dataclass
class FreqMask(Transform):
    training_only: ClassVar[bool] = True
    F: int = 30
    n_mask: int = 2
    replace_with_zero: bool = True

    def apply(self, df, row):
        return _x(df, arrays.freq_mask(F.col("x").cast("array<array<double>>"), row.key(), self.F, self.n_mask, not self.replace_with_zero))


@dataclass
class TimeMask(Transform):
    training_only: ClassVar[bool] = True
    T: int = 40
    n_mask: int = 2
    replace_with_zero: bool = True

    def apply(self, df, row):
        return _x(df, arrays.time_mask(F.col("x").cast("array<array<double>>"), row.key(), self.T, self.n_mask, not self.replace_with_zero))


@dataclass
class SpecAugment(Transform):
    training_only: ClassVar[bool] = True
    max_time_warp: int = 80
    max_freq_width: int = 27
    n_freq_mask: int = 2
    max_time_width: int = 100
    n_time_mask: int = 2
    replace_with_zero: bool = True
    resize_mode: str = "PIL"

    def apply(self, df, row):
        steps = [TimeWarp(self.max_time_warp, self.resize_mode), FreqMask(self.max_freq_width, self.n_freq_mask, self.replace_with_zero), TimeMask(self.max_time_width, self.n_time_mask, self.replace_with_zero)]
        for s in steps:
            df = s.apply(df, row)
        return df


@dataclass
class SpeedPerturbation(Transform):
    training_only: ClassVar[bool] = True
    lower: float = 0.9
    upper: float = 1.1
    keep_length: bool = True

    def apply(self, df, row):
        low, high, keep = self.lower, self.upper, self.keep_length
        if row.extra and "speed" in row.extra:
            return signal.applied(df, "x", lambda s, k, r: signal.speed(s, k, low, high, keep, r), "array<double>", row.key(), row.extra["speed"])
        return signal.applied(df, "x", lambda s, k: signal.speed(s, k, low, high, keep), "array<double>", row.key())


@dataclass
class VolumePerturbation(Transform):
    training_only: ClassVar[bool] = True
    lower: float = -1.6
    upper: float = 1.6
    dbunit: bool = True

    def apply(self, df, row):
        ratio = row.extra["volume"] if row.extra and "volume" in row.extra else arrays.uniform(self.lower, self.upper, row.key(), "volume")
        return _x(df, arrays.louder(F.col("x"), ratio, self.dbunit))


@dataclass
class NoiseInjection(Transform):
    training_only: ClassVar[bool] = True
    lower: float = -20.0
    upper: float = -5.0

    def apply(self, df, row):
        low, high = self.lower, self.upper
        noise = row.extra["noise"] if row.extra and "noise" in row.extra else F.array().cast("array<double>")
        return signal.applied(df, "x", lambda s, k, n: signal.noisy(s, k, n, low, high), "array<double>", row.key(), F.coalesce(noise, F.array().cast("array<double>")))


@dataclass
class Bandpass(Transform):
    training_only: ClassVar[bool] = True
    lower: float = 0.0
    upper: float = 0.75

    def apply(self, df, row):
        return _x(df, arrays.bandpass(F.col("x"), row.key(), self.lower, self.upper))


@dataclass
class RirConvolve(Transform):
    training_only: ClassVar[bool] = True

    def apply(self, df, row):
        return signal.applied(df, "x", signal.reverberant, "array<double>", row.extra["rir"])


#: Names of transforms in configurations.
ALIASES: dict[str, Callable[..., Transform]] = {
    "identity": Identity,
    "time_warp": TimeWarp,
    "time_mask": TimeMask,
    "freq_mask": FreqMask,
    "spec_augment": SpecAugment,
    "speed_perturbation": SpeedPerturbation,
    "volume_perturbation": VolumePerturbation,
    "noise_injection": NoiseInjection,
    "bandpass_perturbation": Bandpass,
    "rir_convolve": RirConvolve,
    "delta": Delta,
    "cmvn": Cmvn,
    "fbank": Fbank,
    "fbank_pitch": FbankPitch,
    "spectrogram": Spectrogram,
}


def named(name: str) -> Callable[..., Transform]:
    """The transform of an alias or of module:Class."""
    if name in ALIASES:
        return ALIASES[name]
    if ":" not in name:
        raise ValueError(f"{name} is neither one of {', '.join(sorted(ALIASES))} nor module:Class")
    module, cls = name.split(":")
    return getattr(importlib.import_module(module), cls)


class Pipeline:
    """A configuration's transforms. precomputed: the type of features that are stored; all up to its last step is skipped."""

    def __init__(self, conf: Sequence[dict] | None = None, precomputed: str | None = None):
        conf = [dict(c) for c in conf or []]
        done = max((i + 1 for i, c in enumerate(conf) if c["type"] == precomputed), default=0)
        self.steps = []
        for c in conf[done:]:
            make, options = named(c.pop("type")), c
            try:
                self.steps.append(make(**options))
            except TypeError as e:
                raise TypeError(f"{make.__name__}{inspect.signature(make)}: {e}") from e

    def is_null(self) -> bool:
        return all(isinstance(s, Identity) for s in self.steps)

    def length_ratio(self) -> float:
        """Rows out for each row in, by the rates that the steps name."""
        rates = [r for s in self.steps for r in (getattr(s, "sample_frequency", None), 1000 / s.frame_shift_ms if hasattr(s, "frame_shift_ms") else None) if r]
        return rates[-1] / rates[0] if rates else 1.0

    def apply(self, df: DataFrame, train: bool = False, epoch: int = 0, extra: Sequence[str] = ()) -> DataFrame:
        """df (uttid, x, rate and what extra names) with x transformed."""
        row = Row(F.col("uttid"), F.col("rate"), epoch, {c: F.col(c) for c in extra})
        for s in self.steps:
            df = df if s.training_only and not train else s.apply(df, row)
        return df

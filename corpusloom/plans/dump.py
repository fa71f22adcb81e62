"""The dump job: signals resampled where they need it, transformed, and written; what fails is set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal
from .ordering import reliable
from .pipeline import Pipeline


def resampled(df: DataFrame, rate: float) -> DataFrame:
    """(uttid, x, rate …) with each signal at the rate."""
    out = signal.applied(df, "x", lambda x, r: signal.resample(x, r, rate), df.schema["x"].dataType.simpleString(), F.col("rate"))
    return out.withColumn("rate", F.lit(float(rate)))


def dumped(df: DataFrame, pipeline: Pipeline, rate: float, train: bool = False) -> tuple[DataFrame, DataFrame]:
    """(done, failed): utterances at `rate`, transformed, their rate now that of their frames; and (uttid, error) of those that failed.

    One utterance that can't be read or transformed does not end the job. The result is checkpointed, since it is read twice.
    """
    marked = df.withColumn("error", F.lit(None).cast("string"))
    out = reliable(pipeline.apply(resampled(marked, rate), train).withColumn("rate", F.col("rate") * F.lit(pipeline.length_ratio())))
    return out.where("error is null").drop("error"), out.where("error is not null").select("uttid", "error")

"""Noises and room responses: a store of signals, and which of them goes with which utterance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import draw
from ..plans.ordering import numbered, reliable
from ..sources.archives import read_sounds

BROADCAST_NUMBERS = 4 << 20  # samples of a store that is sent to all tasks
PER_COPY = 2000  # utterances that share one copy of a signal in a join


def write_store(signals: DataFrame, path: str) -> DataFrame:
    """Writes (key, x, rate) and reads it back; a key has one signal."""
    signals.select(F.col("key").cast("string").alias("key"), F.col("x").cast("array<double>").alias("x"), F.col("rate").cast("double").alias("rate")).write.mode("overwrite").parquet(path)
    return signals.sparkSession.read.parquet(path)


def listed_store(spark: SparkSession, files: DataFrame, path: str) -> DataFrame:
    """(key, x, rate) of a list (key, path) of sound files under a folder: the first channel of each. A file that is listed but can't be read is an error when the rows are."""
    sounds = read_sounds(spark, path).select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), "x", "rate", "error")
    both = files.select("key", F.regexp_replace("path", "^file:/+", "/").alias("_path")).join(sounds, "_path", "left")
    read = F.when(F.col("x").isNotNull(), F.transform("x", lambda s: s[0].cast("double"))).otherwise(F.raise_error(F.concat_ws(": ", "_path", F.coalesce("error", F.lit("not there")))).cast("array<double>"))
    return both.select("key", read.alias("x"), "rate")


def assigned(utts: DataFrame, store: DataFrame, seed: int | str = 0, key: str = "uttid") -> DataFrame:
    """(uttid, source): the utterance's own signal where the store has one of its name, else one drawn by a seeded number among all of the store's, in order of key.

    Only keys are read of either side. An empty store gives null sources.
    """
    names, n = numbered(store.select(F.col("key").alias("source")).distinct(), ["source"], "_rank")
    ids = utts.select(F.col(key).alias("uttid")).distinct()
    own = ids.join(names.select(F.col("source").alias("_own")), F.col("uttid") == F.col("_own"), "left")
    if not n:
        return own.select("uttid", F.col("_own").alias("source"))
    drawn = own.withColumn("_drawn", F.when(F.col("_own").isNull(), draw(n, str(seed), F.col("uttid")) + 1))
    return drawn.join(names, F.col("_drawn") == F.col("_rank"), "left").select("uttid", F.coalesce("_own", "source").alias("source"))


def with_side_signal(df: DataFrame, store: DataFrame, sources: DataFrame, name: str = "noise", key: str = "uttid", broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """df with a column `name`: the signal of each utterance's source (null without one).

    A store of at most `broadcast_numbers` samples, which are counted, goes to all tasks. A larger one is joined by a shuffle in which a
    signal has a copy for every PER_COPY utterances, so that one that many share is many tasks.
    """
    known = df.join(sources.select(F.col("uttid").alias("_uttid"), F.col("source").alias("_source")), F.col(key) == F.col("_uttid"), "left").drop("_uttid")
    signals = store.select(F.col("key").alias("_key"), F.col("x").alias(name))
    if (store.agg(F.sum(F.size("x"))).first()[0] or 0) <= broadcast_numbers:
        return known.join(F.broadcast(signals), F.col("_source") == F.col("_key"), "left").drop("_source", "_key")
    users = reliable(sources.where("source IS NOT NULL").groupBy("source").agg(F.ceil(F.count("*") / PER_COPY).cast("int").alias("_copies")))
    copies = signals.join(users, F.col("_key") == F.col("source")).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("source", "_copies")
    dealt = known.join(users.withColumnRenamed("source", "_user"), F.col("_source") == F.col("_user"), "left").withColumn("_at", F.pmod(F.xxhash64(key), F.coalesce("_copies", F.lit(1))).cast("int"))
    return dealt.join(copies, (F.col("_source") == F.col("_key")) & (F.col("_at") == F.col("_copy")), "left").drop("_source", "_key", "_user", "_copies", "_at", "_copy")

"""Schemas of a speech corpus and the views of the test tables as such a corpus."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "uttid string, path string, loc string, ord long"
SEGMENTS = "uttid string, reco string, start double, end double"
CMVN = "key string, count double, sum array<double>, sum_squares array<double>"
UTTERANCE = "uttid string, x array<array<float>>, rate double, speaker string, text string, labels array<int>"
TOKENS = "token string, id int"

#: The key column of each table a data directory may have, and the columns that refer to other tables.
UTTERANCE_TABLES = ("text", "feats", "utt2num_frames", "utt2dur", "utt2lang", "utt2uniq", "utt2warp", "vad")
SPEAKER_TABLES = ("spk2gender", "spk2warp", "cmvn")
RECORDING_TABLES = ("wav", "reco2dur", "reco2file_and_channel", "stm")


@dataclass
class DataDir:
    """The tables of one split: (key, value) frames by name. utt2spk is always there; segments has SEGMENTS' columns; frame_shift is in seconds."""

    utt2spk: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    segments: DataFrame | None = None
    frame_shift: float | None = None

    def replace(self, **changes) -> DataDir:
        return DataDir(**{"utt2spk": self.utt2spk, "tables": self.tables, "segments": self.segments, "frame_shift": self.frame_shift} | changes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uttid, speaker, archive, text, num_frames, ord of documents."""
    d = table(spark, sf_dir, "documents")
    speaker = F.concat(F.lit("{"), "lang", F.lit("}"), "source")
    return d.select(F.concat(speaker, F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("uttid"), speaker.alias("speaker"), F.concat("source", F.lit(".h5")).alias("archive"), "text", F.col("n_chars").alias("num_frames"), F.col("doc_id").alias("ord"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as segments: a user's recording, from the second of the event on for `value` seconds."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("event_id").cast("string").alias("uttid"), F.col("user_id").cast("string").alias("reco"), start.alias("start"), (start + F.col("value")).alias("end"), F.col("event_id").alias("ord"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as frames (key, t, x); a label's frames are in order of vec_id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("key"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("x"))


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as sides of a call."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("reco"), F.when(F.col("role") == "user", "A").otherwise("B").alias("channel"), "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("uttid"), "text")


#: The same views for DuckDB.
UTT_SQL = "utt AS (SELECT '{' || lang || '}' || source || '-' || lpad(doc_id::VARCHAR, 8, '0') AS uttid, '{' || lang || '}' || source AS speaker, source || '.h5' AS archive, text, n_chars AS num_frames, doc_id AS ord FROM documents)"
SEG_SQL = "seg AS (SELECT event_id::VARCHAR AS uttid, user_id::VARCHAR AS reco, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + value AS \"end\", event_id AS ord FROM events)"
FRAMES_SQL = "frames AS (SELECT label::VARCHAR AS key, vec_id AS t, embedding::DOUBLE[] AS x FROM embeddings)"
SIDES_SQL = "sides AS (SELECT conv_id::VARCHAR AS reco, CASE WHEN role = 'user' THEN 'A' ELSE 'B' END AS channel, turn, conv_id::VARCHAR || '-' || lpad(turn::VARCHAR, 6, '0') AS uttid, text FROM conversations)"

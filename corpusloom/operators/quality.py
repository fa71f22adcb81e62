"""Checks of data directories, and their repair."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fields
from ..schema import SPEAKER_TABLES, UTTERANCE_TABLES, DataDir
from .tables import first_of_key, keep_ids, spk2utt

#: Symbols that a transcript may not hold.
ILLEGAL = ["<s>", "</s>", "#0"]
#: White space that a transcript may not hold besides tab, line feed and space.
WHITE = r"[\r\x0B\x0C\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: What stands between the symbols of a transcript. A vertical tab does not; it is a fault of its own.
BETWEEN = r"[ \t\n\f\r]+"
#: Positive numbers.
COUNTED = ("utt2num_frames", "utt2dur", "reco2dur")

def _positive(value: Column) -> Column:
    return (F.size(fields(value)) == 1) & (F.coalesce(value.try_cast("double"), F.lit(0.0)) > 0)


def fixed(d: DataDir) -> DataDir:
    """A data directory with the first row of each key, and only ids that all of its tables have.

    The first row is that of least `ord`; in a table without this column, of least value: rows have no other order that a shuffle keeps.
    Recordings are those that segments name and wav has; utterances are in every table of utterances; speakers in every table of
    speakers and with an utterance. Durations and frame counts that are no positive number do not count as rows.
    """
    def ordered(df: DataFrame, key: str) -> DataFrame:
        order = F.col("ord") if "ord" in df.columns else F.struct(*(c for c in df.columns if c != key))
        return first_of_key(df.withColumn("_ord", order).drop("ord"), key, "_ord")

    tables = {n: ordered(t.where(_positive(F.col("value"))) if n in COUNTED else t, "key") for n, t in d.tables.items()}
    utt2spk, segs = ordered(d.utt2spk, "uttid"), None if d.segments is None else ordered(d.segments, "uttid")
    ids = utt2spk.select("uttid")
    if segs is not None:
        segs = segs.where((F.col("end") == -1) | (F.col("end") > F.col("start")))
        if "wav" in tables:
            segs = keep_ids(segs, tables["wav"], "reco", "key")
        ids = ids.intersect(segs.select("uttid"))
    elif "wav" in tables:
        ids = ids.intersect(tables["wav"].select("key"))
    for n in UTTERANCE_TABLES:
        if n in tables and n not in ("utt2uniq", "utt2warp"):
            ids = ids.intersect(tables[n].select("key"))
    utt2spk = keep_ids(utt2spk, ids, "uttid", "uttid")
    for n in SPEAKER_TABLES:
        if n in tables:
            utt2spk = keep_ids(utt2spk, tables[n], "speaker", "key")
    speakers = utt2spk.select("speaker").distinct()
    segs = None if segs is None else keep_ids(segs, utt2spk, "uttid", "uttid")
    recos = utt2spk.select(F.col("uttid").alias("reco")) if segs is None else segs.select("reco").distinct()
    out = {n: keep_ids(t, speakers, "key", "speaker") if n in SPEAKER_TABLES else keep_ids(t, utt2spk, "key", "uttid") if n in UTTERANCE_TABLES else keep_ids(t, recos, "key", "reco") for n, t in tables.items()}
    return DataDir(utt2spk, out, segs, d.frame_shift)


def _found(rule: str, df: DataFrame, key: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def repeated_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    return _found(f"{name}: repeated key", df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), F.col(key), F.col("n"))


def out_of_order(df: DataFrame, key: str, order: str, name: str, block: int = 100_000) -> DataFrame:
    """Keys that are not above the one before them. Rows are compared in blocks of their order and at the blocks' edges, so no task has them all."""
    w = Window.partitionBy("_b").orderBy(order)
    rows = df.select(F.col(key).alias("_k"), F.col(order).cast("long").alias(order)).withColumn("_b", F.floor(F.col(order) / block))
    inner = rows.withColumn("_p", F.lag("_k").over(w)).where(F.col("_p") > F.col("_k"))
    edges = rows.groupBy("_b").agg(F.min_by("_k", order).alias("first"), F.max_by("_k", order).alias("last"))
    across = edges.withColumn("_p", F.lag("last").over(Window.orderBy("_b"))).where(F.col("_p") > F.col("first"))  # a row a block
    return _found(f"{name}: not sorted", inner, F.col("_k"), F.col("_p")).unionByName(_found(f"{name}: not sorted", across, F.col("first"), F.col("_p")))


def text_faults(df: DataFrame, key: str, text: str) -> DataFrame:
    """Transcripts with symbols or white space that they may not hold."""
    bad = F.arrays_overlap(F.split(F.col(text), BETWEEN), F.array(*map(F.lit, ILLEGAL)))
    return _found("text: illegal symbol", df.where(bad), F.col(key)).unionByName(_found("text: illegal white space", df.where(F.col(text).rlike(WHITE)), F.col(key)))


def invalid_utf8(raw: DataFrame, column: str, key: str) -> DataFrame:
    return _found("text: not UTF-8", raw.where(~F.is_valid_utf8(F.col(column))), F.col(key))


def counts_differ(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Whether a table that was made from another has another number of rows, as after a job that skipped what failed."""
    both = a.agg(F.count("*").alias("n")).crossJoin(b.agg(F.count("*").alias("m")))  # one row each
    return _found(f"{name}: counts differ", both.where("n <> m"), F.lit(""), F.concat_ws(" of ", F.col("n").cast("string"), F.col("m").cast("string")))


def file_faults(spark: SparkSession, paths: str | Sequence[str], parts: bool = False) -> DataFrame:
    """(rule, key, detail) of plain text files, by file: no newline at the end, bytes that are no UTF-8, and, in files that are UTF-8 throughout, white space that lines may not hold.

    detail is the number of lines. Files are read by ranges of bytes and only sums of them are shuffled; that lines and their newlines add up to one byte more
    than the file has says that the last one is missing. Empty files have no faults. With parts, the files of a folder are parts of one file, whose key is the folder.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(paths).select("value", F.col("_metadata.file_path").alias("key"), F.col("_metadata.file_size").alias("size"))
    valid = F.is_valid_utf8("value")
    files = lines.groupBy("key").agg(F.max("size").alias("size"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.count_if(~valid).alias("broken"), F.count_if(valid & F.make_valid_utf8("value").rlike(WHITE)).alias("spaced"))
    if parts:
        files = files.groupBy(F.regexp_replace("key", r"/[^/]*$", "").alias("key")).agg(*(F.sum(c).alias(c) for c in ("size", "bytes", "broken", "spaced")))
    told = F.array(
        F.struct(F.lit("file: no final newline").alias("rule"), F.when(F.col("bytes") > F.col("size"), 1).otherwise(0).cast("long").alias("n")),
        F.struct(F.lit("file: not UTF-8").alias("rule"), F.col("broken").alias("n")),
        F.struct(F.lit("file: illegal white space").alias("rule"), F.when(F.col("broken") == 0, F.col("spaced")).otherwise(0).alias("n")),
    )
    return files.select("key", F.explode(told).alias("t")).where("t.n > 0").select("t.rule", "key", F.col("t.n").cast("string").alias("detail"))


def validated(d: DataDir, spk_sort: bool = True, order: str | None = None, lists: DataFrame | None = None) -> DataFrame:
    """(rule, key, detail) of all that is wrong with a data directory; empty if it is sound. With `order`, utt2spk must be sorted by key in it. lists: (speaker, utts), which must be its inverse."""
    ids = d.utt2spk.select("uttid")
    found = [
        _found("utt2spk: empty", d.utt2spk.agg(F.count("*").alias("n")).where("n = 0"), F.lit(None)),
        _found("utt2spk: bad field", d.utt2spk.where((F.size(fields(F.col("uttid"))) != 1) | (F.size(fields(F.col("speaker"))) != 1)), F.col("uttid"), F.col("speaker")),
        repeated_keys(d.utt2spk, "uttid", "utt2spk"),
    ]
    if spk_sort:
        found.append(_found("utt2spk: speaker is no prefix", d.utt2spk.where(~F.col("uttid").startswith(F.col("speaker"))), F.col("uttid"), F.col("speaker")))
    if order is not None:
        found.append(out_of_order(d.utt2spk, "uttid", order, "utt2spk"))
    if lists is not None:
        found.append(inverse(d.utt2spk, lists))
    for n, t in sorted(d.tables.items()):
        found.append(repeated_keys(t, "key", n))
        if n in SPEAKER_TABLES:
            speakers = d.utt2spk.select("speaker").distinct()
            found.append(_found(f"{n}: not in utt2spk", t.join(speakers, t["key"] == speakers["speaker"], "left_anti"), F.col("key")))
            found.append(_found(f"{n}: missing", speakers.join(t, speakers["speaker"] == t["key"], "left_anti"), F.col("speaker")))
        if n in UTTERANCE_TABLES:
            found.append(_found(f"{n}: not in utt2spk", t.join(ids, t["key"] == ids["uttid"], "left_anti"), F.col("key")))
            found.append(_found(f"{n}: missing", ids.join(t, ids["uttid"] == t["key"], "left_anti"), F.col("uttid")))
        if n in COUNTED:
            found.append(_found(f"{n}: not positive", t.where(~_positive(F.col("value"))), F.col("key"), F.col("value")))
        if n == "text":
            found.append(text_faults(t, "key", "value"))
        if n == "spk2gender":
            found.append(_found("spk2gender: not m or f", t.where(~F.col("value").isin("m", "f")), F.col("key"), F.col("value")))
        if n in ("spk2warp", "utt2warp"):
            w = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))
            found.append(_found(f"{n}: out of range", t.where(~((w > 0.5) & (w < 1.5))), F.col("key"), F.col("value")))
        if n == "wav":
            found.append(_found("wav: home path", t.where(F.col("value").startswith("~")), F.col("key"), F.col("value")))
        if n == "reco2file_and_channel":
            ch = F.element_at(fields(F.col("value")), -1)
            found.append(_found("reco2file_and_channel: channel", t.where(~ch.isin("A", "B", "1")), F.col("key"), ch))
    if d.segments is not None:
        s = d.segments
        found.append(repeated_keys(s, "uttid", "segments"))
        found.append(_found("segments: bad times", s.where(~((F.col("end") == -1) | (F.col("end") > F.col("start")))), F.col("uttid")))
        found.append(_found("segments: not in utt2spk", s.join(ids, "uttid", "left_anti"), F.col("uttid")))
        found.append(_found("segments: missing", ids.join(s, "uttid", "left_anti"), F.col("uttid")))
        if "wav" in d.tables:
            found.append(_found("segments: no recording", s.join(d.tables["wav"], s["reco"] == d.tables["wav"]["key"], "left_anti"), F.col("uttid"), F.col("reco")))
    return reduce(DataFrame.unionByName, found)


def inverse(utt2spk: DataFrame, lists: DataFrame) -> DataFrame:
    """Speakers whose list of utterances is not the one that utt2spk gives."""
    own = spk2utt(utt2spk)
    return _found("spk2utt: not the inverse", own.join(lists.select("speaker", F.col("utts").alias("given")), "speaker", "full").where(~F.col("utts").eqNullSafe(F.col("given"))), F.col("speaker"))

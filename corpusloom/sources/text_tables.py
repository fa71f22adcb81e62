"""Keyed text tables: one row a line, a key and the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordering import numbered


def keyed(line: Column) -> Column:
    """(key, value): the first field and what follows it, without white space at the ends; an empty value is a value."""
    parts = F.split(F.trim(F.regexp_replace(line, r"[\t\r]", " ")), r"\s+", 2)
    return F.struct(parts[0].alias("key"), F.coalesce(F.get(parts, 1), F.lit("")).alias("value"))


def read_keyed(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """(key, value) of a file or folder; with `ordered`, ord grows with the line (it has gaps between parts of a file). Blank lines are no rows."""
    lines = spark.read.text(path)
    if ordered:
        lines = lines.withColumn("ord", F.monotonically_increasing_id())
    rows = lines.where(F.trim("value") != "").select(keyed(F.col("value")).alias("kv"), *(["ord"] if ordered else []))
    return rows.select("kv.key", "kv.value", *(["ord"] if ordered else []))


def write_keyed(df: DataFrame, path: str, key: str = "key", value: str = "value") -> None:
    """Lines `key value`, sorted by key within and across files."""
    df.orderBy(key).select(F.rtrim(F.concat_ws(" ", F.col(key), F.col(value).cast("string"))).alias("value")).write.text(path)


def index_entry(value: Column) -> Column:
    """(path, loc) of `path[:loc]`, split at the first colon; nothing behind the colon is an error."""
    parts = F.split(value, ":", 2)
    loc = F.get(parts, 1)
    checked = F.when(loc == "", F.raise_error(F.concat(F.lit("no location in "), value)).cast("string")).otherwise(loc)
    return F.struct(parts[0].alias("path"), checked.alias("loc"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(uttid, path, loc, ord) of an archive index."""
    return read_keyed(spark, path, ordered=True).select(F.col("key").alias("uttid"), index_entry(F.col("value")).alias("e"), "ord").select("uttid", "e.path", "e.loc", "ord")


def by_archive(index: DataFrame) -> DataFrame:
    """index with archive_rank, the order in which archives first appear, and pos, an utterance's place: archive after archive."""
    ranks, _ = numbered(index.groupBy("path").agg(F.min("ord").alias("_first")), ["_first"], "archive_rank")
    ranked = index.join(ranks.select("path", "archive_rank"), "path")
    out, _ = numbered(ranked, ["archive_rank", "ord"], "pos")
    return out


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a file with a token a line."""
    lines = spark.read.text(path).select(F.col("value").alias("token"), F.monotonically_increasing_id().alias("_o"))
    out, _ = numbered(lines, ["_o"])
    return out.select("token", (F.col("rn") - 1).cast("int").alias("id"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(combo_idx, specs) of a registry of combinations."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_o"))
    out, _ = numbered(lines, ["_o"])
    return out.select(F.col("rn").cast("int").alias("combo_idx"), F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("specs"))

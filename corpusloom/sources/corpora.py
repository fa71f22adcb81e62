"""Transcript formats of speech corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import centiseconds, conversation_line, has_braces, news_transcript, prompt_sentence, telephone_line
from ..plans.ordering import numbered
from .text_tables import keyed

PROMPTS = "client_id string, path string, sentence string, up_votes int, down_votes int, age string, gender string, accent string"


def prompts(spark: SparkSession, path: str, corpus: str = "commonvoice") -> DataFrame:
    """(uttid, speaker, text, gender, path) of a tab-separated list of read sentences."""
    return prompt_rows(spark.read.schema(PROMPTS).options(sep="\t", header=True, quote="").csv(path), corpus)


def prompt_rows(rows: DataFrame, corpus: str = "commonvoice") -> DataFrame:
    speaker = F.concat(F.lit(f"{{{corpus}}}"), "client_id")
    name = F.translate(F.regexp_replace("path", r"\.mp3", ""), "/", "-")
    text = prompt_sentence(F.col("sentence"))
    return rows.where(~has_braces(text)).select(F.concat(speaker, F.lit("-"), name).alias("uttid"), speaker.alias("speaker"), text.alias("text"), F.when(F.col("gender") == "female", "f").otherwise("m").alias("gender"), "path")


def conversations(spark: SparkSession, path: str, corpus: str = "fisher", prefix: str = "fe_03_") -> DataFrame:
    """(uttid, reco, side, start, end, text) of files with lines `start end A: words`; a file's call is its name."""
    lines = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("call"))
    return conversation_rows(lines, corpus, prefix)


def conversation_rows(lines: DataFrame, corpus: str = "fisher", prefix: str = "fe_03_") -> DataFrame:
    rule = r"([0-9.]+)\s+([0-9.]+) ([AB]):\s*(\S.+\S|\S)\s*$"
    part = lambda i: F.regexp_extract("value", rule, i)
    call = F.concat(F.lit(f"{{{corpus}}}"), F.regexp_replace("call", f"^{prefix}", ""))
    cut = lines.where(F.col("value").rlike(rule)).select(call.alias("call"), part(3).alias("side"), part(1).cast("double").alias("s"), part(2).cast("double").alias("e"), conversation_line(part(4)).alias("text")).where("text is not null")
    start, end = centiseconds(F.col("s")), centiseconds(F.col("e"))
    reco = F.concat_ws("-", "call", "side")
    return cut.select(F.concat_ws("-", "call", "side", start, end).alias("uttid"), reco.alias("reco"), "side", (start.cast("double") * 0.01).alias("start"), (end.cast("double") * 0.01).alias("end"), "text")


def call_sides(lines: DataFrame, corpus: str = "swbd") -> DataFrame:
    """(uttid, reco, start, end, text) of lines `sw2001A-ms98-a-0001 0.00 1.50 words`: times in rounded hundredths."""
    rule = r"^sw0*(\d+)([AB])\S*\s+([0-9.]+)\s+([0-9.]+)\s+(.*)$"
    part = lambda i: F.regexp_extract("value", rule, i)
    reco = F.concat(F.lit(f"{{{corpus}}}"), F.lpad(part(1), 5, "0"), F.lit("-"), part(2))
    hundredths = lambda c: F.floor(100 * c.cast("double") + 0.5)
    rows = lines.where(F.col("value").rlike(rule)).select(reco.alias("reco"), hundredths(part(3)).alias("s"), hundredths(part(4)).alias("e"), telephone_line(part(5)).alias("text"))
    return rows.where(F.trim("text") != "").select(F.concat_ws("-", "reco", F.format_string("%06d", "s"), F.format_string("%06d", "e")).alias("uttid"), "reco", (F.col("s") / 100).alias("start"), (F.col("e") / 100).alias("end"), F.trim("text").alias("text"))


def reference_segments(lines: DataFrame, labels: bool = True) -> DataFrame:
    """(uttid, reco, speaker, start, end, text) of STM lines `file channel speaker start end [<labels>] words`; ;; are comments."""
    rule = r"^(\S+)\s+(\S+)\s+(\S+)\s+([0-9.]+)\s+([0-9.]+)\s*" + (r"(?:<[^>]*>)?\s*" if labels else "") + r"(.*)$"
    part = lambda i: F.regexp_extract("value", rule, i)
    reco = F.concat_ws("-", part(1), part(2))
    cut = lines.where(~F.col("value").rlike(r"^\s*;;") & F.col("value").rlike(rule)).select(reco.alias("reco"), part(3).alias("speaker"), part(4).cast("double").alias("start"), part(5).cast("double").alias("end"), part(6).alias("text"))
    return cut.select(F.concat_ws("-", "reco", centiseconds(F.col("start")), centiseconds(F.col("end"))).alias("uttid"), "reco", "speaker", "start", "end", "text")


def chapters(spark: SparkSession, path: str) -> DataFrame:
    """(uttid, speaker, text) of a tree of reader/chapter/*.trans.txt; a speaker is reader-chapter."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.trans.txt").text(path)
    rows = lines.select(keyed(F.col("value")).alias("kv"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.trans\.txt$", 1).alias("speaker"))
    return rows.select(F.col("kv.key").alias("uttid"), "speaker", F.col("kv.value").alias("text"))


def genders(spark: SparkSession, path: str) -> DataFrame:
    """(reader, gender) of a list with | between its columns; ; are comments."""
    cols = F.split("value", r"\s*\|\s*")
    return spark.read.text(path).where(~F.col("value").startswith(";")).select(F.trim(cols[0]).alias("reader"), F.lower(F.trim(cols[1])).alias("gender"))


def news_files(lines: DataFrame, disks: DataFrame) -> DataFrame:
    """(uttid, path) of index lines `13_16_1: dir/file.wv1`, with the folder that disks (disk, root) names; ; are comments."""
    rule = r"^\s*(\d+)_(\d+)_(\d+)\s*:\s*/?(\S+)\s*$"
    part = lambda i: F.regexp_extract("value", rule, i)
    rows = lines.where(F.col("value").rlike(rule)).select(F.concat_ws("-", part(1), F.concat_ws(".", part(2), part(3))).alias("disk"), part(4).alias("rest"))
    return rows.join(disks, "disk").select(F.regexp_extract("rest", r"([^/.]+)\.\w+$", 1).alias("uttid"), F.concat_ws("/", "root", "rest").alias("path"))


def news_transcripts(lines: DataFrame) -> DataFrame:
    """(uttid, text) of lines `words (utterance)`, normalised."""
    rule = r"^(.+)\((\w+)\)\s*$"
    part = lambda i: F.regexp_extract("value", rule, i)
    return lines.where(F.col("value").rlike(rule)).select(F.concat(F.lit("{wsj}"), part(2)).alias("uttid"), news_transcript(part(1)).alias("text"))


def language_text(lines: DataFrame, order: Column | str, prefix: str = "{wsj}lng_") -> DataFrame:
    """(uttid, text) of lines without <, in lower case, numbered by their place among those kept."""
    out, _ = numbered(lines.where(~F.col("value").contains("<")).select(F.lower("value").alias("text"), F.col(order).alias("_o") if isinstance(order, str) else order.alias("_o")), ["_o"])
    return out.select(F.concat(F.lit(prefix), F.format_string("%07d", "rn")).alias("uttid"), "text")


#: Entries that a lexicon has besides its words, and the pronoun after acronyms are made.
SILENCES = {"!sil": "sil", "<noise>": "nsn", "<unk>": "spn"}
PRONOUN = {"i": "ay"}


def lexicon(lines: DataFrame, extra: dict[str, str] | None = None, letters: DataFrame | None = None) -> DataFrame:
    """(word, phones): comments and blank lines dropped, words lower-cased, entries unique, with extra ones.

    letters: lines of single letters with their phones (as `W d ah b ax l y uw`), which are entries of their own under the letter and a dot;
    the pronoun that is no letter then has an entry too.
    """

    def entries(df: DataFrame) -> DataFrame:
        rows = df.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+", 2).alias("p"))
        return rows.select(F.lower(F.col("p")[0]).alias("word"), F.lower(F.get("p", 1)).alias("phones"))

    given = SILENCES if extra is None else extra
    out = entries(lines)
    if letters is not None:
        out = out.unionByName(entries(letters).withColumn("word", F.concat("word", F.lit("."))))
        given = given | PRONOUN
    return out.unionByName(lines.sparkSession.createDataFrame(list(given.items()), "word string, phones string")).distinct()

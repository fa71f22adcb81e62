"""Keyed tables: filters, maps, joins and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Vocabulary, entry, fields, mapped_tokens, squeezed
from ..schema import RECORDING_TABLES, SPEAKER_TABLES, UTTERANCE_TABLES, DataDir


def last_of_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by `order`."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("s")).select(key, *(F.col(f"s.{c}").alias(c) for c in rest))


def first_of_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the first by `order`, which is not kept."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("s")).select(key, *(F.col(f"s.{c}").alias(c) for c in rest if c != order))


def keep_ids(df: DataFrame, ids: DataFrame, column: str, id_column: str, exclude: bool = False) -> DataFrame:
    """Rows whose column is (or, excluding, is not) among the ids; their order and number stay."""
    given = ids.select(F.col(id_column).alias("_id"))
    return df.join(given, df[column] == given["_id"], "left_anti" if exclude else "left_semi")


def route(df: DataFrame, lists: DataFrame, column: str, id_column: str, job: str) -> DataFrame:
    """A copy of each row for every job whose list holds its id; write it partitioned by the job."""
    given = lists.select(F.col(id_column).alias("_id"), job).distinct()
    return df.join(given, df[column] == given["_id"]).drop("_id")


def route_coverage(df: DataFrame, lists: DataFrame, column: str, id_column: str, job: str) -> DataFrame:
    """(id, jobs) of rows that no job or more than one takes."""
    jobs = lists.select(F.col(id_column).alias("_id"), job).distinct().groupBy("_id").agg(F.count("*").alias("jobs"))
    return df.join(jobs, df[column] == jobs["_id"], "left").select(F.col(column), F.coalesce("jobs", F.lit(0)).alias("jobs")).where("jobs <> 1")


def looked_up(df: DataFrame, mapping: DataFrame, column: str, key: str, value: str, permissive: bool = False) -> DataFrame:
    """column replaced by the value that mapping has for it. Missing: an error, or as it was if permissive."""
    m = mapping.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    missing = F.col(column).cast("string") if permissive else F.raise_error(F.concat(F.lit("undefined key "), F.col(column).cast("string"))).cast("string")
    found = F.when(F.col("_key").isNotNull(), F.col("_value").cast("string")).otherwise(missing)
    return df.join(m, df[column] == m["_key"], "left").withColumn(column, found).drop("_key", "_value")


def apply_map(text: Column, mapping: Column | Vocabulary, first: int = 1, last: int | None = None, permissive: bool = False) -> Column:
    """The fields first..last of a line, each replaced by what a map column holds (which may be several words)."""
    def rule(w: Column) -> Column:
        missing = w if permissive else F.raise_error(F.concat(F.lit("undefined key "), w)).cast("string")
        return F.coalesce(entry(mapping, w), missing)

    return mapped_tokens(text, rule, first, last)


def symbols_to_integers(text: Column, symbols: Column | Vocabulary, unknown: str | None = None, first: int = 1, last: int | None = None) -> Column:
    """Fields as the integers of a symbol map; unknown names the symbol that stands for those without one (else an error)."""
    def rule(w: Column) -> Column:
        missing = entry(symbols, F.lit(unknown)).cast("string") if unknown is not None else F.raise_error(F.concat(F.lit("undefined symbol "), w)).cast("string")
        return F.coalesce(entry(symbols, w).cast("string"), missing)

    return mapped_tokens(text, rule, first, last)


def consolidated(index: DataFrame, text: DataFrame | None = None, utt2spk: DataFrame | None = None, num_frames: DataFrame | None = None, permissive: bool = True) -> DataFrame:
    """Utterances that all given tables have, with the columns of each; the last line of a key counts (by `ord`).

    Not permissive: an utterance that some table lacks is an error when the result is read.
    """
    parts = [last_of_key(t, "uttid", "ord").drop("ord") for t in (text, utt2spk, num_frames) if t is not None]
    base = last_of_key(index, "uttid", "ord")
    if permissive:
        return reduce(lambda a, b: a.join(b, "uttid"), parts, base)
    marked = [p.withColumn(f"_has{i}", F.lit(True)) for i, p in enumerate(parts)]
    out = reduce(lambda a, b: a.join(b, "uttid", "full"), marked, base.withColumn("_has", F.lit(True)))
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ["_has", *(f"_has{i}" for i in range(len(parts)))]])
    checked = F.when(complete, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not in all tables: "), "uttid")).cast("boolean"))
    return out.where(checked).drop("_has", *(f"_has{i}" for i in range(len(parts))))


def with_lookup(df: DataFrame, side: DataFrame, key: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Left join on a key that is unique in side; defaults fill what is missing."""
    out = df.join(side, key, "left")
    return out.fillna(defaults) if defaults else out


def spk2utt(utt2spk: DataFrame, order: str = "uttid") -> DataFrame:
    """(speaker, utts): a speaker's utterances in order."""
    return utt2spk.groupBy("speaker").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), "uttid"))), lambda s: s["uttid"]).alias("utts"))


def utt2spk(lists: DataFrame) -> DataFrame:
    return lists.select(F.explode("utts").alias("uttid"), "speaker")


def long_enough(df: DataFrame, raw: bool = False, frames: str = "num_frames") -> DataFrame:
    """More than 2560 samples of raw audio, or more than 10 frames of features."""
    return df.where(F.col(frames) > (2560 if raw else 10))


def with_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.size(fields(F.col(text))) > 0)


def text_hash(text: Column | str) -> Column:
    """The SHA-256 of a text, its white space made one."""
    return F.unhex(F.sha2(squeezed(F.col(text) if isinstance(text, str) else text), 256))


def with_prompt(df: DataFrame, prompts: DataFrame, text: str = "text", prompt: str = "prompt", exclude: bool = False, hashed: bool = False) -> DataFrame:
    """Utterances whose text, its white space made one, is (not) a prompt.

    Texts are compared by their text_hash(), taken once a row before the join, so that no text is shuffled for its own sake. With hashed,
    both columns hold it already.
    """
    said, asked = (F.col(text), F.col(prompt)) if hashed else (text_hash(text), text_hash(prompt))
    given = prompts.select(asked.alias("_prompt")).distinct()
    return df.withColumn("_said", said).join(given, F.col("_said") == F.col("_prompt"), "left_anti" if exclude else "left_semi").drop("_said")


def renamed(d: DataDir, utt_prefix: str = "", utt_suffix: str = "", spk_prefix: str = "", spk_suffix: str = "") -> DataDir:
    """All ids of a data directory with prefixes and suffixes; utt2uniq leads from the new to the original id."""
    utt = lambda c: F.concat(F.lit(utt_prefix), c, F.lit(utt_suffix))
    spk = lambda c: F.concat(F.lit(spk_prefix), c, F.lit(spk_suffix))
    names = {n: t.withColumn("key", spk(F.col("key")) if n in SPEAKER_TABLES else utt(F.col("key")) if n in UTTERANCE_TABLES or n == "wav" and d.segments is None else F.col("key")) for n, t in d.tables.items()}
    if "utt2uniq" not in d.tables:
        names["utt2uniq"] = d.utt2spk.select(utt(F.col("uttid")).alias("key"), F.col("uttid").alias("value"))
    ids = d.utt2spk.select(utt(F.col("uttid")).alias("uttid"), spk(F.col("speaker")).alias("speaker"))
    return DataDir(ids, names, None if d.segments is None else d.segments.withColumn("uttid", utt(F.col("uttid"))), d.frame_shift)


def reduced(d: DataDir, ids: DataFrame, id_column: str = "uttid") -> DataDir:
    """A data directory with only some utterances, and the speakers and recordings that they have."""
    utts = keep_ids(d.utt2spk, ids, "uttid", id_column)
    segs = None if d.segments is None else keep_ids(d.segments, utts, "uttid", "uttid")
    recos = utts.select(F.col("uttid").alias("reco")) if segs is None else segs.select("reco").distinct()
    out = {}
    for n, t in d.tables.items():
        out[n] = keep_ids(t, utts.select("speaker").distinct(), "key", "speaker") if n in SPEAKER_TABLES else keep_ids(t, recos, "key", "reco") if n in RECORDING_TABLES else keep_ids(t, utts, "key", "uttid")
    return DataDir(utts, out, segs, d.frame_shift)


def combined(dirs: Sequence[DataDir]) -> DataDir:
    """The union of data directories: tables that all have. utt2uniq is made up where only some have it, and so are segments (whole recordings).

    Directories with features must have one frame shift, as far as they name it.
    """
    shifts = {d.frame_shift for d in dirs if d.frame_shift is not None and "feats" in d.tables}
    if len(shifts) > 1:
        raise ValueError(f"features with different frame shifts: {', '.join(map(str, sorted(shifts)))}")
    names = set.intersection(*(set(d.tables) for d in dirs))
    if any("utt2uniq" in d.tables for d in dirs):
        names.add("utt2uniq")
    own = lambda d, n: d.tables.get(n, d.utt2spk.select(F.col("uttid").alias("key"), F.col("uttid").alias("value")))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    segs = None
    if any(d.segments is not None for d in dirs):
        segs = union([d.segments.select("uttid", "reco", "start", "end") if d.segments is not None else d.utt2spk.select("uttid", F.col("uttid").alias("reco"), F.lit(0.0).alias("start"), F.lit(-1.0).alias("end")) for d in dirs])
    return DataDir(union([d.utt2spk for d in dirs]), {n: union([own(d, n) for d in dirs]) for n in sorted(names)}, segs, next(iter(shifts), None))


def registered(registry: DataFrame, specs: Sequence[str]) -> DataFrame:
    """(combo_idx): the first line of a registry (combo_idx, specs) whose set of specs is this one; empty if there is none."""
    wanted = F.array(*(F.lit(s) for s in sorted(set(specs))))
    return registry.where(F.array_sort(F.array_distinct("specs")) == wanted).agg(F.min("combo_idx").alias("combo_idx")).where("combo_idx is not null")


def register(registry: DataFrame, specs: Sequence[str]) -> DataFrame:
    """The registry with this set of specs at its end, if it has no such line."""
    new = registry.agg(F.coalesce(F.max("combo_idx"), F.lit(0)).alias("last")).select((F.col("last") + 1).cast("int").alias("combo_idx"), F.array(*(F.lit(s) for s in sorted(set(specs)))).alias("specs"))
    return registry.unionByName(new.join(registered(registry, specs).select(F.lit(1).alias("_known")), how="left_anti"))


def ids_difference(a: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(DataFrame.subtract, others, a)


def ids_intersection(a: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersect, others, a)


def source_texts(parts: Sequence[DataFrame], text: str = "text") -> DataFrame:
    """Texts of several corpora, those that are empty dropped."""
    return with_text(reduce(DataFrame.unionByName, [p.select(text) for p in parts]), text)


def speed_perturbed(d: DataDir, factor: float) -> DataDir:
    """A data directory at another speed: ids with the factor as prefix, times divided, segments under a hundredth dropped, recordings read through a speed command."""
    mark = f"sp{factor:g}-"
    out = renamed(d, utt_prefix=mark, spk_prefix=mark)
    if "utt2uniq" in d.tables:
        out.tables["utt2uniq"] = d.tables["utt2uniq"].withColumn("key", F.concat(F.lit(mark), "key"))
    if d.segments is not None:
        out = out.replace(segments=speed_segments(d.segments, factor))
    if "wav" in d.tables:
        rx = F.rtrim(F.col("value"))
        sped = (
            F.when(rx.endswith("|"), F.concat(F.regexp_replace(rx, r"\s*\|$", " |"), F.lit(f" sox -t wav - -t wav - speed {factor:g} |")))
            .when(rx.rlike(r":[0-9]+$"), F.concat(F.lit("wav-copy "), rx, F.lit(f" - | sox -t wav - -t wav - speed {factor:g} |")))
            .otherwise(F.concat(F.lit("sox -t wav "), rx, F.lit(f" -t wav - speed {factor:g} |")))
        )
        out.tables["wav"] = d.tables["wav"].select(F.concat(F.lit(mark), "key").alias("key"), sped.alias("value"))
    return out


def speed_segments(segments: DataFrame, factor: float) -> DataFrame:
    mark = F.lit(f"sp{factor:g}-")
    s, e = F.col("start") / factor, F.col("end") / factor
    return segments.where(e > s + 0.01).select(F.concat(mark, "uttid").alias("uttid"), F.concat(mark, "reco").alias("reco"), F.round(s, 2).alias("start"), F.round(e, 2).alias("end"))


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def fixed_speakers(utt2spk: DataFrame, sides: DataFrame) -> DataFrame:
    """Speakers of call sides (call-side ids) replaced by the persons that sides (side, person) names; unknown sides keep theirs."""
    return utt2spk.join(sides, utt2spk["speaker"] == sides["side"], "left").select("uttid", F.coalesce("person", "speaker").alias("speaker"))

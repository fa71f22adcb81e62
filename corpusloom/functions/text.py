"""Transcript normalisation, tokens and edit distance as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import top_ranked
from .arrays import bound

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOISE = "<noise>"


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def fields(text: Column) -> Column:
    """The fields between white space; none for a blank text."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def squeezed(text: Column) -> Column:
    """Fields joined by one space: white space that is not just one space becomes one, and none is left at the ends."""
    return F.trim(F.regexp_replace(text, r" [ \t\n\x0B\f\r]+|[\t\n\x0B\f\r][ \t\n\x0B\f\r]*", " "))


def replaced(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Regular-expression replacements, one after the other."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def mapped_tokens(text: Column, rule: Callable[[Column], Column], first: int = 1, last: int | None = None) -> Column:
    """Applies rule to the fields in first..last (1-based, inclusive) and joins all by a space."""
    end = 1 << 30 if last is None else last
    return F.array_join(F.transform(fields(text), lambda w, i: F.when((i >= first - 1) & (i <= end - 1), rule(w)).otherwise(w)), " ")


# Fixed values. Prompt sentences: A-Z lowered, punctuation but apostrophes gone, apostrophes next to white space gone.
PROMPT_RULES = [(r"[^\p{L}\p{N}_\s']", ""), (r"(\s)'", "$1"), (r"'(\s)", "$1")]


def prompt_sentence(text: Column) -> Column:
    return replaced(ascii_lower(text), PROMPT_RULES)


def has_braces(text: Column) -> Column:
    """Sentences with both braces are not used."""
    return text.contains("{") & text.contains("}")


def _plain_news(w: Column) -> Column:
    return replaced(F.regexp_replace(ascii_lower(w), r"\\", ""), [(r"^%percent", "percent"), (r"^\.point", "point"), (r"\*(.*)\*", "$1")])


def _marked_news(w: Column, noise: str) -> Column:
    dropped = w.rlike(r"^\[<\w+\]$") | w.rlike(r"^\[\w+>\]$") | w.rlike(r"\[\w+/\]$") | w.rlike(r"\[/\w+\]$") | w.isin("~", ".")
    return (
        F.when(dropped, None)
        .when(w.rlike(r"\[\w+\]"), F.lit(noise))
        .when(w.rlike(r"^<[\w'.]+>$"), F.regexp_replace(w, r"^<([\w'.]+)>$", "$1"))
        .when(w == "--dash", F.lit("-dash"))
        .otherwise(w)
    )


def news_tokens(words: Column, noise: str = NOISE) -> Column:
    """Tokens of read news; null where one is dropped. One step after the other over the array, so that each is computed once a token."""
    steps = [
        _plain_news,
        lambda w: F.when(w == "!exclamation-point", w).otherwise(F.regexp_replace(w, "!", "")),
        lambda w: F.when(w == ":colon", w).otherwise(F.regexp_replace(w, ":", "")),
        lambda w: _marked_news(w, noise),
    ]
    for step in steps:
        words = F.transform(words, step)
    return words


def news_token(word: Column, noise: str = NOISE) -> Column:
    """One token of read news: null where it is dropped."""
    return news_tokens(F.array(word), noise)[0]


def news_transcript(text: Column, noise: str = NOISE) -> Column:
    return F.array_join(F.filter(news_tokens(fields(text), noise), lambda w: w.isNotNull()), " ")


def telephone_line(text: Column) -> Column:
    """Noises of telephone speech made one, silences and asides removed."""
    return replaced(text, [(r"(?i)(^|\s)\[SILENCE\](\s|$)", "$2"), (r"(?i)\[VOCALIZED-NOISE\]|\[LAUGHTER\]|\[NOISE\]", NOISE), (r"(?i)<B_ASIDE>", ""), (r"(?i)<E_ASIDE>", "")])


# Fixed values. Words of telephone transcripts, in order: laughed words, corrected words, partial words, invented words, variants.
WORD_RULES = [
    (r"(?i)^\[LAUGHTER-(.+)\](|-)$", "$1$2"),
    (r"^\[(.+)/.+\](|-)$", "$1$2"),
    (r"^(|-)\[[^\]\[]+\](.+)$", "-$2"),
    (r"^(.+)\[[^\]\[]+\](|-)$", "$1-"),
    (r"([^\]\[]+)\[.+\]$", "$1"),
    (r"^\{(.+)\}$", "$1"),
    (r"(?i)([A-Z])\[[^\]\[]+\]([A-Z])", "$1-$2"),
    (r"_\d$", ""),
]


def telephone_word(word: Column) -> Column:
    return replaced(word, WORD_RULES)


def telephone_words(text: Column, first: int = 1, last: int | None = None) -> Column:
    return mapped_tokens(text, telephone_word, first, last)


def evaluation_line(text: Column) -> Column:
    """The text behind an id, in lower case: tags in (% ) and < > go with the blank before them, greedily, at its start too; then parentheses; white space is made one."""
    out = replaced(F.concat(F.lit(" "), squeezed(F.lower(text))), [(r" \(%.*\)", ""), (r" <.*>", ""), (r"[()]", ""), (r"\s+", " ")])
    return F.ltrim(out)


# Fixed values. Noises of conversations.
CONVERSATION_NOISES = ["laugh", "laughter", "sigh", "cough", "sneeze", "mn", "breath", "lipsmack", "noise"]


def conversation_line(text: Column) -> Column:
    """Noises made one; skips and pauses removed. Null for lines with (( and for empty ones."""
    out = replaced(text, [(rf"\[(?:{'|'.join(CONVERSATION_NOISES)})\]", NOISE), (r"\[\[skip\]\]", ""), (r"\[pause\]", "")])
    return F.when(text.contains("((") | (F.size(fields(text)) == 0), None).otherwise(out)


def centiseconds(seconds: Column, width: int = 6) -> Column:
    """Seconds as hundredths with leading zeros, cut, not rounded."""
    return F.lpad((seconds * 100.0).cast("long").cast("string"), width, "0")


def acronyms(text: Column, letters: Column, with_i: Column) -> Column:
    """Single capitals mapped to acronym letters, then all lower-cased; the first field is an id and stays as it is.

    with_i, letters: maps of words. A capital I belongs to the run of single capitals it touches: in such a run all are
    mapped by with_i. What is left is mapped by letters.
    """
    single = lambda x: x.rlike("^[A-Z]$")

    def mapped(w: Column) -> Column:
        # the run of single capitals around a place: none of the fields between it and the I breaks the run
        def near_i(i: Column) -> Column:
            reach = lambda j: F.forall(F.slice(w, F.least(i, j) + 1, F.abs(i - j) + 1), single)
            touches = F.exists(F.sequence(F.lit(0), F.size(w) - 1), lambda j: (F.element_at(w, (j + 1).cast("int")) == "I") & reach(j))
            long = F.exists(F.array(i - 1, i + 1), lambda j: (j >= 0) & (j < F.size(w)) & single(F.get(w, j.cast("int"))))
            return touches & long

        done = F.transform(w, lambda x, i: F.when(single(x) & near_i(i), F.coalesce(F.try_element_at(with_i, x), x)).otherwise(F.coalesce(F.try_element_at(letters, x), x)))
        return F.concat_ws(" ", F.element_at(w, 1), F.lower(F.array_join(F.slice(done, 2, F.greatest(F.size(w) - 1, F.lit(0))), " ")))

    return bound(fields(text), mapped)


def acronym_entry(word: Column, phones: Column, letters: Column) -> Column:
    """i._b._m. where a word's phones are those of its letters one by one (with s or 's at the end alike), else null. letters: map of capitals to phones."""
    tail = F.when(word.rlike("^[A-Za-z]+'s$"), F.lit("'s")).when(word.rlike("^[A-Za-z]+s$"), F.lit("s")).otherwise(F.lit(""))
    base = F.substring(word, F.lit(1), F.length(word) - F.length(tail))
    heard = F.when(tail == "", phones).otherwise(F.substring(phones, F.lit(1), F.length(phones) - 2))
    spelt = F.array_join(F.transform(F.split(base, ""), lambda x: F.coalesce(F.try_element_at(letters, F.upper(x)), F.lit("?"))), " ")
    fits = word.rlike("^[A-Za-z]+('s|s)?$") & (spelt == heard) & ((tail == "") | phones.rlike("[sz]$"))
    return F.when(fits, F.concat(F.array_join(F.split(F.lower(base), ""), "._"), F.lit("."), tail))


@dataclass(frozen=True)
class Vocabulary:
    """A map as an array of small maps by the hash of their keys: a map column is searched from its first entry on, so that a large one costs its length for each token."""

    column: Column
    buckets: int

    @staticmethod
    def row(inventory: DataFrame, key: str, value: str, buckets: int, name: str = "m") -> DataFrame:
        """A bounded inventory as one row with the array that Vocabulary(name, buckets) reads."""
        place = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
        maps = inventory.groupBy(place.alias("b")).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
        held = maps.agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("held"))
        return held.select(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.try_element_at("held", b)).alias(name))


def entry(mapping: Column | Vocabulary, key: Column) -> Column:
    """What a map has for a key; null if it lacks it."""
    if isinstance(mapping, Vocabulary):
        mapping = F.get(mapping.column, F.pmod(F.xxhash64(key), F.lit(mapping.buckets)).cast("int"))
    return F.try_element_at(mapping, key)


def token_ids(text: Column, ids: Column | Vocabulary, unknown: Column) -> Column:
    """The ids of a text's fields in a map of tokens; unknown for those that are not in it."""
    return F.transform(fields(text), lambda w: F.coalesce(entry(ids, w), unknown))


def id_tokens(numbers: Column, tokens: Column) -> Column:
    """The tokens at places of an array that starts with id 0."""
    return F.transform(numbers, lambda i: F.get(tokens, i))


def vocabulary_map(inventory: DataFrame, key: str, value: str) -> Column:
    """A one-row scalar subquery of a bounded inventory as a map column."""
    return inventory.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m")).scalar()


def token_inventory(texts: DataFrame, text: str = "text", unit: str = "word", blank: str = "<blank>", unknown: str = "<unk>", end: str = "<sos/eos>", size: int | None = None) -> DataFrame:
    """(token, id, n): blank is 0, unknown 1, then units by falling count (ties by the unit), the end token last. size bounds the units kept."""
    pieces = F.explode(fields(F.col(text)) if unit == "word" else F.filter(F.split(F.col(text), ""), lambda c: (c != "") & ~c.rlike(r"^\s$")))
    counts = texts.select(pieces.alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked, n = top_ranked(counts, [F.desc("n"), F.asc("token")], size)
    special = texts.sparkSession.createDataFrame([(blank, 0, 0), (unknown, 1, 0), (end, n + 2, 0)], "token string, id long, n long")
    return special.unionByName(ranked.select("token", (F.col("rn") + 1).alias("id"), "n"))


def as_characters(numbers: Column) -> Column:
    """A string with one character for each id (from 0, under 55 000, else an error), so that string functions work on id sequences."""
    numbers = F.when(F.exists(numbers, lambda i: (i < 0) | (i >= 55_000)), F.raise_error(F.lit("ids are from 0 and under 55000")).cast("array<bigint>")).otherwise(numbers.cast("array<bigint>"))
    return F.decode(F.unhex(F.array_join(F.transform(numbers, lambda i: F.lpad(F.hex((i + 256).cast("long")), 4, "0")), "")), "UTF-16BE")


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions and substitutions between two id sequences."""
    return F.levenshtein(as_characters(a), as_characters(b))


def side_of(recording: Column) -> Column:
    """(file, channel) of a recording id that ends in -A or -B."""
    return F.struct(F.regexp_extract(recording, r"^(.*)-([AB])$", 1).alias("file"), F.regexp_extract(recording, r"^(.*)-([AB])$", 2).alias("channel"))

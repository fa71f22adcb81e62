"""License scans: fuzzy search for short notices.

A text is its words, lower-cased and joined by one space. A notice that may differ in k characters is cut into k + 1
seeds; by the pigeonhole principle one of them stands unchanged in any occurrence. One automaton finds the seeds of all
notices; around each the regex library's bounded-error matching verifies the whole notice and reports its span and
edits. The exact phrases (base labels) are found as words that stand consecutively.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of

#: Exact phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices that may be misspelt in up to so many characters (insertions, deletions, substitutions), and their labels.
NOTICES = [
    ("released under the mit license", 3, "mit"),
    ("licensed under the mit license", 3, "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", 5, "mit"),
    ("licensed under the apache license version 2 0", 4, "apache-2"),
    ("licensed under cc by nc 4 0", 2, "cc-by-nc"),
    ("creative commons attribution noncommercial", 4, "cc-by-nc"),
    ("licensed under cc by sa 4 0", 2, "cc-by-sa"),
    ("creative commons attribution sharealike", 4, "cc-by-sa"),
    ("licensed under cc by 4 0", 1, "cc-by"),
    ("licensed under the gnu general public license version 3", 4, "gpl-3"),
    ("licensed under the gnu general public license version 2", 4, "gpl-2"),
    ("gnu lesser general public license", 3, "lgpl"),
    ("gnu affero general public license", 3, "agpl"),
    ("mozilla public license version 2 0", 3, "mpl-2"),
    ("redistribution and use in source and binary forms", 4, "bsd"),
    ("all rights reserved", 1, "all-rights-reserved"),
]

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Hit:
    label: str
    first_word: int
    n_words: int
    start: int  # characters, in the joined words
    end: int
    edits: int
    score: float
    fuzzy: bool


def normalised(text: bytes) -> list[bytes]:
    """Words of A-Z lower-cased, digits, a-z and whatever is not ASCII."""
    return text.translate(_WORD_BYTES).split()


def seeds(notice: str, edits: int) -> list[tuple[str, int]]:
    """The notice in edits + 1 pieces of about equal length, with their places."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: list[tuple[str, int, str]] = NOTICES):
        self.base = list(base.items())
        self.notices = notices
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, edits, _) in enumerate(notices):
            for seed, at in seeds(notice, edits):
                places.setdefault(seed, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for seed, where in places.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()
        # the least error first; words at the ends are whole
        self.verified = lru_cache(maxsize=1 << 16)(self._verified)  # notices are often copied with what stands around them
        longest = [len(n.split()) + e for n, e, _ in notices] + [len(p.split()) for p in base]
        self.most_words = max(longest, default=1)
        self.patterns = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n)}){{e<={e}}}(?![^ ])") for n, e, _ in notices]

    def exact(self, text: str, starts: list[int]) -> list[Hit]:
        out, padded = [], f" {text} "
        for phrase, label in self.base:
            at = padded.find(f" {phrase} ")
            while at >= 0:
                out.append(Hit(label, bisect.bisect_right(starts, at) - 1, phrase.count(" ") + 1, at, at + len(phrase), 0, 1.0, False))
                at = padded.find(f" {phrase} ", at + 1)
        return out

    def _verified(self, i: int, window: str, at: int, end: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) of what notice i matches in a window, whose first and last characters may only be looked at."""
        return [(*m.span(), sum(m.fuzzy_counts)) for m in self.patterns[i].finditer(window, at, end)]

    def fuzzy(self, text: str, starts: list[int]) -> list[Hit]:
        windows: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for i, at in where:
                windows.setdefault(i, set()).add(last - size + 1 - at)
        out = []
        for i, found in windows.items():
            notice, edits, label = self.notices[i]
            # each window by itself: best match looks at one occurrence, not for the best of several; of overlapping ones the closest stays
            places: dict[tuple[int, int], int] = {}
            for start in sorted(found):
                a, b = max(0, start - edits - 1), min(len(text), start + len(notice) + edits + 1)
                before = min(1, a)
                for x, y, wrong in self.verified(i, text[a - before : b + 1], before, b - a + before):
                    span = (x + a - before, y + a - before)
                    places[span] = min(wrong, places.get(span, edits))
            taken = _Taken(len(notice) + edits)
            for (a, b), wrong in sorted(places.items(), key=lambda p: (p[1], p[0])):
                if taken.over(a, b):
                    continue
                taken.add(a, b, None)
                first = bisect.bisect_right(starts, a) - 1
                out.append(Hit(label, first, bisect.bisect_left(starts, b) - first, a, b, wrong, 1 - wrong / len(notice), True))
        return out

    def scan(self, words: list[bytes]) -> list[Hit]:
        """All exact places, and fuzzy ones but those that share words with a closer match of another label (versions of one notice differ by a letter).

        Each place costs the same however many there are.
        """
        text, starts = joined(words)
        kept = self.exact(text, starts)
        taken = _Taken(self.most_words)
        for h in kept:
            taken.add(h.first_word, h.first_word + h.n_words, h)
        for h in sorted(self.fuzzy(text, starts), key=lambda h: (h.edits, h.first_word, h.label)):
            if not any(k.label != h.label and k.edits < h.edits for k in taken.over(h.first_word, h.first_word + h.n_words)):
                kept.append(h)
                taken.add(h.first_word, h.first_word + h.n_words, h)
        return sorted(kept, key=lambda h: (h.first_word, h.fuzzy, h.label, h.n_words))


def joined(words: list[bytes]) -> tuple[str, list[int]]:
    """The words joined by one space, and where each begins."""
    texts = [w.decode("utf-8", "replace") for w in words]
    return " ".join(texts), [0, *itertools.accumulate(len(w) + 1 for w in texts)][: len(texts)]


class _Taken:
    """Spans of at most `size`, by the cells of that size that they begin in, so that a look-up reads three cells."""

    def __init__(self, size: int):
        self.size = size
        self.cells: dict[int, list[tuple[int, int, Hit | None]]] = {}

    def add(self, a: int, b: int, what: Hit | None) -> None:
        self.cells.setdefault(a // self.size, []).append((a, b, what))

    def over(self, a: int, b: int) -> list[Hit | None]:
        """What shares a place with [a, b)."""
        return [what for cell in range(a // self.size - 1, (b - 1) // self.size + 1) for x, y, what in self.cells.get(cell, ()) if x < b and a < y]


@lru_cache(maxsize=4)
def scanner(base: tuple[tuple[str, str], ...] = tuple(BASE.items()), notices: tuple[tuple[str, int, str], ...] = tuple(NOTICES)) -> Scanner:
    """One for each worker process and list of notices."""
    return Scanner(dict(base), list(notices))


_HIT = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64()), ("score", pa.float64()), ("fuzzy", pa.bool_()), ("match", pa.string())])
HITS = "array<struct<label:string,first_word:bigint,n_words:bigint,edits:bigint,score:double,fuzzy:boolean,match:string>>"


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: list[tuple[str, int, str]] = NOTICES) -> DataFrame:
    """(doc_id, n_words, hits): all exact and fuzzy places in each whole text, in order of their first word.

    base: exact phrases and their labels. notices: (notice, edits, label), words in lower case and joined by one space.

    Null text is empty: no words, no hits. Null doc_ids stay null. Repeated rows and copies each get their own hits.
    An empty table gives an empty result. Columns besides doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    phrases, fuzzy = tuple(base.items()), tuple(map(tuple, notices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(phrases, fuzzy)
        for b in batches:
            n, hits = [], []
            for t in texts_of(b.column(1)):
                words = normalised(t)
                n.append(len(words))
                hits.append([{"label": h.label, "first_word": h.first_word, "n_words": h.n_words, "edits": h.edits, "score": h.score, "fuzzy": h.fuzzy, "match": b" ".join(words[h.first_word : h.first_word + h.n_words]).decode("utf-8", "replace")} for h in s.scan(words)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.list_(_HIT))], ["doc_id", "n_words", "hits"])

    schema = docs.select("doc_id").schema.add("n_words", "long")
    return docs.select("doc_id", "text").mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, hits {HITS}")


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score). score: the best match's share of unchanged characters, 1 for an exact phrase, else 0."""
    base = F.filter("hits", lambda h: ~h["fuzzy"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda h: h["label"]))), ",")
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["first_word"])).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"),
    )

"""SimHash near-duplicates by multi-index hashing.

A fingerprint is one or more words of 64 bits, cut into segments. A table holds each distinct fingerprint once for each
segment, under the segment's number and value. Each fingerprint asks the table for the values in a small Hamming ball
around each of its own segments, and what it fetches is kept if the complete distance is within bounds.

Two fingerprints whose segments differ in one bit meet once: the one that lacks the bit asks with the bit set. So a ball
of radius one in w bits is w / 2 rows on average, and equal segments meet in the table itself.

near_duplicates() has one word in two segments of 32 bits. Of two bits that differ, the first segment has one at most or
the second has none, so radius one there and zero here find every pair. keep_one() says 'near' as word shingles do: five
words, a Jaccard similarity of 0.8 or more; its fingerprints have more words, and what they find is verified on the
shingles themselves.

Segment values that more than a bounded number of fingerprints hold are hot, and are not joined as they are. Within two bits, each
member of a hot value names the 65 points within one bit of its whole fingerprint: pairs meet at a point between them,
and a point has at most 65 fingerprints. For wider balls, members are held against a few pivots of the value first. Where a
value still has members of different groups, those members meet by their rarest shingles: two sets of Jaccard 0.8 or more share one
of the (1 - 0.8) * size + 1 shingles that are the least frequent in each, so that a passage that many texts share, which is in none of
these, brings none of them together, and no pair is lost. Before texts are compared, the parities of two sets (near_signature) turn away
pairs that differ in too many shingles: a bound that no pair within the similarity exceeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, settled, small_batches, texts_of, unpacked, written
from .connected import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
NEAR_SHINGLE, MIN_JACCARD = 5, 0.8
LIMIT = 200  # fingerprints of a segment value of 32 bits that is joined as it is
NEAR_LIMIT = 4  # the same of shorter segments, besides four times what chance gives a value
PIVOTS = 2
PARITY = 8  # words of a set's parities


@dataclass(frozen=True)
class Segments:
    """words of 64 bits, segments of `bits` bits with the radius of each one's ball, and the largest distance of all words."""

    words: int
    bits: int
    radii: tuple[int, ...]
    max_bits: int

    def places(self) -> list[tuple[int, int, int]]:
        """(word, shift, radius) of each segment."""
        each = 64 // self.bits
        return [(i // each, i % each * self.bits, r) for i, r in enumerate(self.radii)]

    def checked_bits(self) -> int:
        """The bound of the word that rows hold beside a key: of a part of the words, three deviations more than its share."""
        share = self.max_bits / self.words
        return self.max_bits if self.words == 1 else round(share + 3 * (share / 4) ** 0.5)


#: Exact for distances of two bits and less.
TWO_BITS = Segments(1, 32, (1, 0), 2)
#: For shingle sets of Jaccard 0.8 and more: such a pair differs in 15 % of its bits, and shares a segment but for one bit in 0.97 of cases at 0.8, in 0.999 at 0.9.
NEAR = Segments(4, 20, (1,) * 12, 56)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of UTF-8 text: lower-cased A-Z, words between ASCII white space, word shingles with repeats."""
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), np.dtype("<u8"))
    return int(majority(h[:, None])[0])


def majority(h: np.ndarray) -> np.ndarray:
    """Of rows of words, the words (signed) of the bits that more than half of the rows have."""
    ones = np.zeros(64 * h.shape[1], np.int64)
    for i in range(0, len(h), 1 << 13):
        part = np.ascontiguousarray(h[i : i + (1 << 13)])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<i8")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(fingerprint, texts_of(b.column(1))), pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; null text counts as empty, whose fingerprint is zero."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def _held(s: Segments) -> list[tuple[Column, Column, Column, int]]:
    """For each segment: its value, the key with its number, the word to check, the radius. The word is the next one, which the key does not fix."""
    out = []
    for i, (word, shift, radius) in enumerate(s.places()):
        value = F.shiftrightunsigned(F.col("sig")[word], shift).bitwiseAND(F.lit((1 << s.bits) - 1))
        out.append((value, F.lit(i << s.bits) + value, F.col("sig")[(word + 1) % s.words], radius))
    return out


def table(nodes: DataFrame, s: Segments, *more: str) -> DataFrame:
    """The segment tables: (key, node, word) of each fingerprint and segment, with more columns of nodes. nodes: node, sig (array of words)."""
    rows = F.array(*(F.struct(key.alias("key"), word.alias("word")) for _, key, word, _ in _held(s)))
    return nodes.select("node", *more, F.explode(rows).alias("s")).select("s.key", "node", "s.word", *more)


def asked(nodes: DataFrame, s: Segments, *more: str) -> DataFrame:
    """(key, node, word, same) and more columns of nodes: each segment's own value, and those with one bit more that its ball holds."""
    bits = F.array(*(F.lit(1 << b) for b in range(s.bits)))

    def ball(value: Column, key: Column, word: Column) -> Column:
        return F.transform(F.filter(bits, lambda b: value.bitwiseAND(b) == 0), lambda b: F.struct((key + b).alias("key"), word.alias("word"), F.lit(False).alias("same")))

    held = _held(s)
    own = F.array(*(F.struct(key.alias("key"), word.alias("word"), F.lit(True).alias("same")) for _, key, word, _ in held))
    return nodes.select("node", *more, F.explode(F.concat(own, *(ball(v, key, word) for v, key, word, r in held if r))).alias("s")).select("s.key", "node", "s.word", "s.same", *more)


def _pairs(found: DataFrame, s: Segments) -> DataFrame:
    """Distinct (node, other), the larger first, of what the word beside the key does not reject."""
    near = found.where((F.col("node") != F.col("other")) & (F.bit_count(F.col("word").bitwiseXOR(F.col("other_word"))) <= s.checked_bits()))
    return near.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct()


def _other(df: DataFrame, *more: str) -> DataFrame:
    return df.select("key", F.col("node").alias("other"), F.col("word").alias("other_word"), *(F.col(c).alias(f"other_{c}") for c in more))


def hot_values(nodes: DataFrame, s: Segments, limit: int) -> DataFrame:
    """(key) of more than limit fingerprints."""
    return written(table(nodes, s).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("key"), "hot-segments")


def cold_pairs(nodes: DataFrame, s: Segments, hot: DataFrame, *apart: str) -> DataFrame:
    """Candidates of the values that are not hot. apart: columns of nodes in which the two must differ."""
    fetched = asked(nodes, s, *apart).join(_other(table(nodes, s, *apart).join(hot, "key", "left_anti"), *apart), "key")
    for c in apart:
        fetched = fetched.where(F.col(c) != F.col(f"other_{c}"))
    return _pairs(fetched.where(~F.col("same") | (F.col("node") > F.col("other"))), s)


def links(nodes: DataFrame, max_bits: int = MAX_BITS, limit: int = LIMIT) -> DataFrame:
    """Links (node, other) that join all fingerprints within max_bits (at most two); nodes: distinct fp, node."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    s = Segments(1, 32, (1, 0), max_bits)
    held = nodes.select("node", F.array("fp").alias("sig"))
    hot = hot_values(held, s, limit)
    cold = cold_pairs(held, s, hot)
    if hot.isEmpty():
        return cold
    # whoever asks a hot value or holds it: its whole fingerprint, and that with each bit changed, are the keys
    flips = F.array(*(F.lit(x) for x in [0, *(1 << b for b in range(63)), -(1 << 63)]))
    members = asked(held, s).join(hot, "key", "left_semi").select("node", "word").distinct()
    points = members.select(F.explode(F.transform(flips, lambda x: F.col("word").bitwiseXOR(x))).alias("key"), "node", "word")
    least = points.groupBy("key", F.xxhash64("key")).agg(F.min(F.struct("node", "word")).alias("one")).select("key", F.col("one.node").alias("other"), F.col("one.word").alias("other_word"))
    return cold.unionByName(_pairs(points.join(least, "key"), s)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    component_id is the smallest doc_id that can be reached over links of at most max_bits bits.
    Nulls: null text is empty; a row with a null doc_id links like any other and gets its group's id, which it does not name
    (null if no row of the group has one). Repeated rows and equal texts share a fingerprint, hence a group; rows with one
    doc_id and different texts are in the group of their own text. An empty table gives an empty result. Other columns are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = components(links(nodes.select("fp", F.col("fp").alias("node")), max_bits), "node", "other")
    rooted = nodes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root", F.xxhash64("root")).agg(F.min("first").alias("component_id")).select("root", "component_id")
    return fps.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingles(text: bytes, shingle: int = NEAR_SHINGLE) -> set[bytes]:
    """Word shingles without repeats, words as in fingerprint(); a shorter text is one shingle."""
    words = text.lower().split()
    return set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) or {b" ".join(words)}


def near_signature(text: bytes, words: int = NEAR.words) -> tuple[int, list[int]]:
    """(hash of the set of shingles, its signature), signed. Signature: SimHash of the set in so many words, the set's size, PARITY words of parities.

    A shingle's hash names one bit of the parities, which says whether an odd number of shingles name it. So two sets differ in at least as many shingles as
    their parities differ in bits.
    """
    h = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, shingles(text)), np.dtype("<u8")))
    x = h[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    odd = np.bincount((h & np.uint64(64 * PARITY - 1)).view(np.int64), minlength=64 * PARITY).astype(np.uint8) & 1
    sig = [*majority(x ^ (x >> np.uint64(31))).tolist(), len(h), *np.packbits(odd, bitorder="little").view("<i8").tolist()]
    return int(np.array([xxhash.xxh64_intdigest(h.tobytes())], np.uint64).view(np.int64)[0]), sig


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        texts = texts_of(b.column(1))
        node, sig = zip(*map(near_signature, texts), strict=True) if texts else ((), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(sig, pa.list_(pa.int64())), pa.array(map(z.compress, texts), pa.binary()), b.column(2)], ["doc_id", "node", "sig", "z", "row_key"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = lru_cache(maxsize=16)(shingles)
    for b in batches:
        found = []
        for one, two in zip(unpacked(b.column(2)), unpacked(b.column(3)), strict=True):
            x, y = of(one), shingles(two)
            both = len(x & y)
            found.append(both >= MIN_JACCARD * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["node", "other"]).filter(pa.array(found, pa.bool_()))


def _distance(one: str, two: str, s: Segments) -> Column:
    return reduce(lambda a, b: a + b, (F.bit_count(F.col(one)[i].bitwiseXOR(F.col(two)[i])) for i in range(s.words)))


def _may_match(one: str, two: str, s: Segments, share: float = MIN_JACCARD) -> Column:
    """Whether two signatures are within s.max_bits and their parities allow a Jaccard similarity of `share`; the latter turns no such pair away."""
    a, b = F.col(one), F.col(two)
    odd = reduce(lambda x, y: x + y, (F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(NEAR.words + 1, NEAR.words + 1 + PARITY)))
    slack = 1e-6  # for pairs at exactly `share`, whose products are rounded
    return (_distance(one, two, s) <= s.max_bits) & (odd * (1 + share) <= (a[NEAR.words] + b[NEAR.words]) * (1 - share) + slack)


def _beside(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Pairs (node, other) with a column of both."""
    one, two = (right.select(F.col("node").alias(n), F.col(column).alias(f"{column}_{n}")) for n in ("node", "other"))
    return left.join(two, "other").join(one, "node")


def _close(pairs: DataFrame, nodes: DataFrame, s: Segments) -> DataFrame:
    """The pairs whose signatures may match."""
    return _beside(pairs, nodes, "sig").where(_may_match("sig_node", "sig_other", s)).select("node", "other")


def _similar(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs whose shingles have a Jaccard similarity of MIN_JACCARD or more."""
    close = written(pairs, "pairs")
    named = close.select("node").unionAll(close.select("other")).distinct()
    texts = written(rows.select("node", "z").join(named, "node", "left_semi").groupBy("node").agg(F.first("z").alias("z")), "candidates")
    return _beside(close, texts, "z").select("node", "other", "z_other", "z_node").mapInArrow(_verified, "node long, other long")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs, the larger node first."""
    return pairs.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct()


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with root; a node without links is its own."""
    return written(nodes.join(components(links, "node", "other"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")


def near_links(rows: DataFrame, s: Segments = NEAR, limit: int | None = None) -> DataFrame:
    """(node, root) of the nodes that have links; rows: node, sig, z. limit: of hot values, by NEAR_LIMIT and the number of nodes unless given."""
    nodes = written(rows.groupBy("node").agg(F.first("sig").alias("sig")), "nodes")
    limit = NEAR_LIMIT + 4 * (nodes.count() >> s.bits) if limit is None else limit
    hot = hot_values(nodes, s, limit)
    if hot.isEmpty():
        return components(settled("links", _similar, _close(cold_pairs(nodes, s, hot), nodes, s), rows), "node", "other")
    # the hot values first, with whole signatures, as they are few: what they link need not be compared again
    seeds = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "sig")) for i in range(PIVOTS)]
    hot_table = table(nodes, s, "sig").join(hot, "key", "left_semi")
    keys = asked(nodes, s).join(hot, "key", "left_semi").groupBy("node").agg(F.collect_list("key").alias("keys"))  # at most as many as a node asks for
    hot_asked = written(keys.join(nodes, "node"), "hot-asked")
    pivots = hot_table.groupBy("key", F.xxhash64("key")).agg(F.array(*seeds).alias("p")).select("key", F.explode("p").alias("p")).select("key", F.col("p.node").alias("other"), F.col("p.sig").alias("other_sig"))
    near = hot_asked.select("node", "sig", F.explode("keys").alias("key")).join(pivots, "key").where((F.col("node") != F.col("other")) & _may_match("sig", "other_sig", s))
    near = written(near.groupBy("node").agg(F.collect_set(F.struct(F.xxhash64("other").alias("h"), "other")).alias("p")), "near-pivots")
    # a node's first pivot in an order that all nodes share, then those that this leaves in other groups
    first = settled("links", _similar, _ordered(near.select("node", F.array_min("p")["other"].alias("other"))), rows)
    rooted = _rooted(nodes.select("node"), first)
    apart = near.join(rooted, "node").select("node", "root", F.explode("p.other").alias("other")).join(rooted.select(F.col("node").alias("other"), F.col("root").alias("other_root")), "other").where("root <> other_root")
    first = first.unionByName(settled("links", _similar, _ordered(apart), rows))
    rooted = _rooted(nodes, first)
    roots = hot_asked.join(rooted.select("node", "root"), "node")
    each = roots.select("root", F.explode("keys").alias("key"))
    mixed = each.groupBy("key", F.xxhash64("key")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    members = roots.select("node", "root", "sig", F.explode("keys").alias("key")).join(mixed, "key", "left_semi")
    members = written(members.groupBy("node").agg(F.first("root").alias("root"), F.first("sig").alias("sig")), "members")
    # rare_pairs() finds all pairs of members: of the other values, those that have one member at most are left
    side = F.when(F.col("member").isNotNull(), 0).otherwise(F.when(F.col("root") == 0, 1).otherwise(F.col("root")))
    sided = rooted.join(members.select("node", F.lit(True).alias("member")), "node", "left").select("node", "sig", side.alias("side"))
    rare = settled("rare-pairs", rare_pairs, members, rows, s)
    rest = _close(cold_pairs(sided, s, hot, "side"), nodes, s).unionByName(rare).distinct()
    return components(first.unionByName(settled("links", _similar, rest, rows)), "node", "other")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.fromiter(map(xxhash.xxh64_intdigest, shingles(t)), np.dtype("<u8")).view(np.int64) for t in unpacked(b.column(3))]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(map(len, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "root", "sig", "size", "shingles"])


def rare_pairs(members: DataFrame, rows: DataFrame, s: Segments = NEAR, share: float = MIN_JACCARD) -> DataFrame:
    """Distinct (node, other), the larger first, of members (node, root, sig) of different roots within s.max_bits that may have a Jaccard similarity of `share`.

    Each member's shingles are put in order of their frequency among all members. Pairs meet at a shingle that is among the first size - share * size + 1 of both,
    if their sizes allow the similarity and so do the shingles that are left behind the shared one.
    """
    texts = members.join(rows.groupBy("node").agg(F.first("z").alias("z")), "node").select("node", "root", "sig", "z")
    held = written(texts.mapInArrow(_hashes, "node long, root long, sig array<long>, size long, shingles array<long>"), "shingles")
    each = held.select("node", "size", F.explode("shingles").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("n"))
    ranked = each.join(often, "h").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("by"))
    slack = 1e-6  # for pairs at exactly `share`, whose products are rounded
    length = (F.col("size") - F.ceil(F.col("size") * share - slack) + 1).cast("int")
    known = ranked.select("node", F.slice("by", F.lit(1), length).alias("by")).join(held.select("node", "root", "sig", "size"), "node")
    rare = written(known.select("node", "root", "sig", "size", F.posexplode("by").alias("at", "s")).where("s.n > 1").select("node", "root", "sig", "size", "at", F.col("s.h").alias("h")), "rare")
    other = rare.select("h", *(F.col(c).alias(f"other_{c}") for c in ("node", "at", "root", "sig", "size")))
    left = F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at"))
    fits = (F.least("size", "other_size") >= share * F.greatest("size", "other_size") - slack) & (left * (1 + share) >= share * (F.col("size") + F.col("other_size")) - slack)
    apart = (F.col("node") > F.col("other_node")) & (F.col("root") != F.col("other_root"))
    return rare.join(other, "h").where(apart & fits & _may_match("sig", "other_sig", s, share)).select("node", F.col("other_node").alias("other")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Segments = NEAR, limit: int | None = None) -> DataFrame:
    """Of each group of near copies, joined over links, the row with the smallest id (then text hash).

    Null text is empty. A row without id stays. Rows with one id and different texts are judged apart; of equal ones the
    least row stays. Texts with one set of shingles are copies, however long. An empty table gives an empty result. The
    columns are those of docs, whatever their names.
    """
    small_batches(docs.sparkSession)
    key = free_name(docs, "text_hash")
    named = docs.where(F.col(id_col).isNotNull()).withColumn(key, F.xxhash64(text_col))

    def first_rows() -> DataFrame:
        rows = written(named.select(F.col(id_col).cast("long"), text_col, key).mapInArrow(_near_rows, "doc_id long, node long, sig array<long>, z binary, row_key long"), "near")
        comp = near_links(rows, s, limit)
        firsts = rows.groupBy("node").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
        kept = firsts.join(comp, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
        return kept.select(F.col("first.doc_id").alias(id_col), F.col("first.row_key").alias(key)).distinct()

    kept = settled("kept", first_rows)
    one = named.join(kept, [id_col, key], "left_semi").groupBy(id_col, key).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return one.select("row.*").unionAll(docs.where(F.col(id_col).isNull()))

"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n_s of N documents and target weight w_s repeats at the rate w_s * N / n_s. A document's number of
copies is the inverse of the Poisson distribution with that mean at a uniform number seeded by a hash of the document,
so that the expected size of each source is its weight and every run gives the same copies.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name

SEED = "mix-1"
ALPHA = 0.5  # target weights: each source's share to this power, normed
DRAW_BITS = 52
TAIL = 40  # terms of the distribution beyond twice its mean: what lies beyond is under 2 ** -53 for any mean, less than the draw's last bit
MAX_MEAN = 500
MAX_BROADCAST = 50_000  # sources; with more, the rates are joined by a shuffle


def uniform(*key: Column | str) -> Column:
    """In [0, 1): the first 52 bits of the MD5 of the key's parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, DRAW_BITS // 4), 16, 10).cast("double") / float(1 << DRAW_BITS)


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest k with P(X <= k) > u for X ~ Poisson(mean), mean at most MAX_MEAN."""
    last = (2 * mean).cast("int") + F.lit(TAIL)
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.when(u < F.exp(-mean), 0).otherwise(-1).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        cdf = s["cdf"] + p
        return F.struct(p.alias("p"), cdf.alias("cdf"), F.when((s["k"] < 0) & (u < cdf), i).otherwise(s["k"]).alias("k"))

    found = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])
    return F.when(found < 0, last).otherwise(found)


def drawn_count(mean: Column, *key: Column | str) -> Column:
    """Poisson(mean) seeded by key. A mean over MAX_MEAN, where exp(-mean) would come near zero, is a sum of as many parts as it takes."""
    parts = F.ceil(mean / MAX_MEAN).cast("int")
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + poisson_inverse(uniform(*key, i.cast("string")), mean / parts))
    return F.when(mean <= MAX_MEAN, poisson_inverse(uniform(*key), mean)).otherwise(many)


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, source_col: str = "source") -> DataFrame:
    """(source, rate) over all rows. weights: target share by source (normed; unnamed sources get none); else shares to the power alpha."""
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "mix_source string, w double")
        weighed = sizes.join(given, sizes["mix_source"].eqNullSafe(given["mix_source"]), "left").select(sizes["mix_source"], "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    weighed = checkpointed(weighed)
    all_n, all_w = weighed.agg(F.sum("n"), F.sum("w")).first()
    return weighed.select("mix_source", (F.col("w") / F.lit(all_w or 1.0) * F.lit(all_n or 0) / F.col("n")).alias("mix_rate"))


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs, each row as often as drawn, with rate, copies, copy (from 1) and shuffle_key, in the global order of shuffle_key.

    These four replace columns of docs that have their names, in capitals or not. Null source: a source of its own. Null doc_id: drawn as the text 'null'. Rows with equal doc_id draw the same number.
    Empty or very long texts are rows like any other. An empty table gives an empty result.
    """
    taken = {"rate", "copies", "copy", "shuffle_key"}
    names = [c for c in docs.columns if c.lower() not in taken]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    of_source, rate = free_name(docs, "mix_source"), free_name(docs, "mix_rate")
    r = rates(docs, weights, alpha, source_col).toDF(of_source, rate)
    r = F.broadcast(r) if r.count() <= MAX_BROADCAST else r
    drawn = docs.select(*names).join(r, F.col(source_col).eqNullSafe(F.col(of_source))).withColumn("copies", drawn_count(F.col(rate), F.lit(seed), key))
    copies = drawn.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    shuffled = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), key, F.col("copy").cast("string"))))
    return shuffled.select(*names, F.col(rate).alias("rate"), "copies", "copy", "shuffle_key").orderBy("shuffle_key")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of replicate() with the columns of docs alone, whatever their names. Nulls, ties and empty tables as there."""
    row = free_name(docs, "row")
    whole = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("mixed_source"), F.struct(*docs.columns).alias(row))
    return replicate(whole, id_col="id", source_col="mixed_source", **options).select(f"{row}.*")


ORACLE = f"""
WITH s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {ALPHA}) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM s) * (SELECT sum(n) FROM s) / n AS rate FROM s),
u AS (SELECT d.*, r.rate, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, len(list_filter(range(0, 200), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-rate + i * ln(rate) - lgamma(i + 1)))) <= u)) AS copies FROM u),
c AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM k)
SELECT doc_id, text, lang, source, n_chars, copies::INT AS copies, copy::INT AS copy,
       md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy::VARCHAR) AS shuffle_key
FROM c
"""

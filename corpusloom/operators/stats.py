"""Statistics of feature frames: mean and variance normalisation, shapes, counts, error rates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..functions.text import edit_distance, fields
from ..plans.ordering import with_neighbours

STD_FLOOR = 1e-20


def cmvn_stats(frames: DataFrame, key: str | None = None, x: str = "x") -> DataFrame:
    """(key, count, sum, sum_squares) of frames; key null: over all. A frame is an array of doubles.

    Each value is a row of (key, place) that is summed before the shuffle, so that a key of any size is a few rows a task.
    """
    k = F.lit(None).cast("string") if key is None else F.col(key)
    cells = frames.select(k.alias("key"), F.posexplode(F.col(x).cast("array<double>")).alias("i", "v"))
    sums = cells.groupBy("key", "i").agg(F.count("*").cast("double").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    return gathered(sums)


def gathered(sums: DataFrame) -> DataFrame:
    """Sums by (key, i) as arrays: one row a key."""
    rows = F.array_sort(F.collect_list(F.struct("i", "n", "s", "q")))  # as many as a frame has values
    return sums.groupBy("key").agg(rows.alias("r")).select("key", F.col("r")[0]["n"].alias("count"), F.transform("r", lambda r: r["s"]).alias("sum"), F.transform("r", lambda r: r["q"]).alias("sum_squares"))


def merged_stats(parts: Sequence[DataFrame]) -> DataFrame:
    """Statistics of parts as statistics of the whole."""
    cells = reduce(DataFrame.unionByName, parts).select("key", "count", F.posexplode(F.arrays_zip("sum", "sum_squares")).alias("i", "c"))
    return gathered(cells.groupBy("key", "i").agg(F.sum("count").alias("n"), F.sum("c.sum").alias("s"), F.sum("c.sum_squares").alias("q")))


def as_matrix(stats: DataFrame) -> DataFrame:
    """(key, matrix): the stored form, the count behind the sums and a zero behind the squares."""
    return stats.select("key", F.array(F.concat("sum", F.array("count")), F.concat("sum_squares", F.array(F.lit(0.0)))).alias("matrix"))


def from_matrix(stored: DataFrame) -> DataFrame:
    m, q = F.col("matrix")[0], F.col("matrix")[1]
    size = F.size(m) - 1
    return stored.select("key", F.element_at(m, -1).alias("count"), F.slice(m, F.lit(1), size).alias("sum"), F.slice(q, F.lit(1), size).alias("sum_squares"))


def bias_and_scale(stats: DataFrame, floor: float = STD_FLOOR) -> DataFrame:
    """(key, bias, scale) for each place: minus the mean, and one over the standard deviation, which is `floor` at least."""
    n = F.col("count")
    mean = F.transform("sum", lambda s: s / n)
    std = F.zip_with("sum_squares", mean, lambda q, m: F.sqrt(F.greatest(q / n - m * m, F.lit(0.0))))
    return stats.select("key", F.transform(mean, lambda m: -m).alias("bias"), F.transform(std, lambda s: F.lit(1.0) / F.greatest(s, F.lit(floor))).alias("scale"))


def normalised(x: Column, bias: Column, scale: Column, means: bool = True, variances: bool = False, reverse: bool = False) -> Column:
    """A frame plus bias, then times scale; reversed, over scale, then minus bias."""
    out = x
    if reverse:
        out = F.zip_with(out, scale, lambda v, s: v / s) if variances else out
        return F.zip_with(out, bias, lambda v, b: v - b) if means else out
    out = F.zip_with(out, bias, lambda v, b: v + b) if means else out
    return F.zip_with(out, scale, lambda v, s: v * s) if variances else out


def apply_cmvn(frames: DataFrame, stats: DataFrame, key: str | None = None, means: bool = True, variances: bool = False, reverse: bool = False, floor: float = STD_FLOOR) -> DataFrame:
    """frames with x normalised by the statistics of their key (or by the one row of statistics over all)."""
    table = bias_and_scale(stats, floor)
    both = frames.crossJoin(F.broadcast(table.drop("key").limit(1))) if key is None else frames.join(table.withColumnRenamed("key", "_key"), F.col(key).cast("string") == F.col("_key").cast("string")).drop("_key")
    return both.withColumn("x", normalised(F.col("x"), F.col("bias"), F.col("scale"), means, variances, reverse)).drop("bias", "scale")


def utterance_normalised(x: Column, means: bool = True, variances: bool = False, floor: float = STD_FLOOR) -> Column:
    """A matrix (frames of values) normalised by its own statistics."""

    def sums(m: Column, of: Callable[[Column], Column]) -> Column:
        zero = F.transform(m[0], lambda _: F.lit(0.0))
        return F.aggregate(m, zero, lambda a, f: F.zip_with(a, f, lambda p, q: p + of(q)))

    def own(m: Column, s: Column) -> Column:
        n = F.size(m).cast("double")
        bias = F.transform(s["total"], lambda v: -v / n)
        scale = F.zip_with(s["squares"], s["total"], lambda q, v: F.lit(1.0) / F.greatest(F.sqrt(F.greatest(q / n - (v / n) * (v / n), F.lit(0.0))), F.lit(floor)))
        return F.struct(bias.alias("bias"), scale.alias("scale"))

    def whole(m: Column) -> Column:
        summed = F.struct(sums(m, lambda q: q).alias("total"), sums(m, lambda q: q * q).alias("squares"))
        return bound(bound(summed, lambda s: own(m, s)), lambda o: F.transform(m, lambda f: normalised(f, o["bias"], o["scale"], means, variances)))

    return bound(x, whole)


def delta_rows(frames: DataFrame, key: str = "key", t: str = "t", window: int = 2, block: int = 4096) -> DataFrame:
    """(key, t, i, v, delta) of frames: the first delta of each value over its neighbours in time; the ends repeat.

    For frames stored one a row. Times are cut into blocks that borrow `window` frames from each other, so that a key of any length is many tasks:
    where a block has no frame so far before or after one, the key begins or ends in it.
    """
    rows = with_neighbours(frames.select(key, t, "x"), [key, t], window, block)
    w = Window.partitionBy("_block", key).orderBy("_rn")
    first, last = F.first("x").over(w), F.last("x").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sides = [(float(k), F.coalesce(F.lead("x", k).over(w), last), F.coalesce(F.lag("x", k).over(w), first)) for k in range(1, window + 1)]
    beside = rows.select(key, t, "x", "_own", *(c.alias(f"_{side}{int(k)}") for k, up, down in sides for side, c in (("up", up), ("down", down)))).where("_own")
    parts = [_times(k, f"_up{k}", f"_down{k}") for k in range(1, window + 1)]
    total = reduce(lambda a, b: F.zip_with(a, b, lambda p, q: p + q), parts)
    delta = F.transform(total, lambda d: d / (2.0 * sum(k * k for k in range(1, window + 1))))
    cells = beside.select(key, t, F.posexplode(F.arrays_zip(F.col("x").alias("v"), delta.alias("delta"))).alias("i", "c"))
    return cells.select(key, t, "i", "c.v", "c.delta")


def _times(k: int, up: str, down: str) -> Column:
    return F.zip_with(up, down, lambda a, b: F.lit(float(k)) * (a - b))


def shape(x: Column) -> Column:
    """d0,d1 of a matrix."""
    return F.concat_ws(",", F.size(x), F.size(x[0]))


def symbols(texts: DataFrame, text: str = "text", first_field: int = 1) -> DataFrame:
    """(token): the distinct fields from the first_field-th on."""
    return texts.select(F.explode(F.slice(fields(F.col(text)), first_field, 1 << 30)).alias("token")).distinct()


def nonlinguistic(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token): the distinct fields that hold <."""
    return symbols(texts, text).where(F.col("token").contains("<"))


def error_rate(pairs: DataFrame, predicted: str = "predicted", labels: str = "labels") -> DataFrame:
    """(edits, tokens, rate) over all pairs of id sequences."""
    d = edit_distance(F.col(predicted), F.col(labels))
    return pairs.agg(F.sum(d).alias("edits"), F.sum(F.size(labels)).alias("tokens")).withColumn("rate", F.col("edits") / F.col("tokens"))

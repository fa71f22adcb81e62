"""Row numbers and ranks of whole tables without a one-task window.

A table is sorted by range, so that each partition is a stretch of the order; each row's number is its place in its
partition plus the rows of the partitions before. Only one count a partition passes through the driver.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIFT = 33  # bits of a place in monotonically_increasing_id


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a single machine, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/corpusloom-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def reliable(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "rn") -> tuple[DataFrame, int]:
    """df with its row number (from 1) by a total order, and the number of rows. df should be narrow: it is checkpointed."""
    placed = reliable(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_place", _SHIFT).alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()  # one row a partition
    before, total = [], 0
    for r in counts:
        before.append((r["_part"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "_part long, _before long")
    out = placed.join(F.broadcast(offsets), F.shiftright("_place", _SHIFT) == F.col("_part"))
    within = F.col("_place").bitwiseAND((1 << _SHIFT) - 1)
    return out.withColumn(name, F.col("_before") + within + 1).drop("_place", "_part", "_before"), total


def top_ranked(df: DataFrame, order: Sequence[Column | str], size: int | None = None) -> tuple[DataFrame, int]:
    """numbered() of the first `size` rows: with a size, only those are sorted and kept."""
    return numbered(df if size is None else df.orderBy(*order).limit(size), order)


def with_neighbours(df: DataFrame, order: Sequence[Column | str], reach: int, block: int = 4096) -> DataFrame:
    """df in blocks of its order, each with the `reach` rows before and after it: columns _rn, _block and _own (false for borrowed rows).

    A window over a few neighbours can then be partitioned by _block and a key: however many rows a key has, they are many tasks. Rows are
    borrowed at the edges of blocks alone, so that about 2 * reach / block of them are there twice. df is sorted by range and checkpointed.
    """
    block = max(block, reach)
    rows, _ = numbered(df, order, "_rn")
    own, at = F.floor((F.col("_rn") - 1) / block), (F.col("_rn") - 1) % block
    blocks = F.array_compact(F.array(own, F.when((at < reach) & (own > 0), own - 1), F.when(at >= block - reach, own + 1)))
    return rows.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == own)


def running_total(df: DataFrame, row: str, value: str, name: str, block: int = 50_000) -> DataFrame:
    """df with the sum of `value` over the rows up to this one, by a row number. Blocks are summed first; one task sees a row a block."""
    blocked = df.withColumn("_block", F.floor((F.col(row) - 1) / block))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocked.groupBy("_block").agg(F.sum(value).alias("_sum")).select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_block").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return blocked.join(base, "_block").withColumn(name, F.col("_base") + F.sum(value).over(within)).drop("_block", "_base")


def tile(row: Column, total: int, parts: int) -> Column:
    """The part (from 0) of a row number (from 1) if parts are contiguous and the first ones get what is left over."""
    size, extra = divmod(total, parts)
    zero = row - 1
    cut = extra * (size + 1)
    return F.when(zero < cut, F.floor(zero / (size + 1))).otherwise(extra + F.floor((zero - cut) / max(size, 1))).cast("int")


def hashed(seed: int | str, *columns: str) -> Column:
    """A seeded order that any engine can repeat: MD5 of seed and columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))



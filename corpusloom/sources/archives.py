"""Archives of signals and features: Parquet tables by dataset and split, sound files, archives of matrices."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import archive_files
from ..operators.tables import registered
from . import archive_source, matrix_format, sound_format

NOT_LOADED = ("orig", "no_short")


def parsed_specs(specs: str | Sequence[str]) -> dict[str, list[str]]:
    """dataset -> splits, both sorted, of `<dataset>/<split>` names."""
    out: dict[str, set[str]] = {}
    for s in [specs] if isinstance(specs, str) else specs:
        parts = s.split("/")
        if len(parts) != 2 or not all(parts):
            raise ValueError(f"{s} is not <dataset>/<split>")
        if parts[1] in NOT_LOADED or parts[1].endswith(tuple(f"_{x}" for x in NOT_LOADED)):
            raise ValueError(f"{s} is not for loading")
        out.setdefault(parts[0], set()).add(parts[1])
    return {d: sorted(out[d]) for d in sorted(out)}


def write_archive(df: DataFrame, path: str, order: Sequence[str], hours: float = 5.0, jobs: int | None = None, rate: str = "rate") -> DataFrame:
    """Writes (dataset, split, uttid, x, rate, …) by dataset, split and archive; returns the index (uttid, path, loc), whose paths are the folders written.

    The numbers of job and file come from lengths alone; rows of one archive are written together.
    """
    seconds = F.size("x") / F.col(rate)
    lengths = df.select("dataset", "split", "uttid", *[c for c in order if c != "uttid"], seconds.alias("seconds"))
    files = archive_files(lengths, order, "seconds", 3600.0 * hours, jobs)
    name = F.format_string("feats.%d.%d", "job", "file_idx")
    placed = files.select("dataset", "split", "uttid", name.alias("archive"))
    out = df.join(placed.select("uttid", "archive"), "uttid")
    out.repartition("dataset", "split", "archive").sortWithinPartitions("archive", *order).write.partitionBy("dataset", "split", "archive").mode("append").parquet(path)
    return placed.select("uttid", archive_path(path).alias("path"), F.col("uttid").alias("loc"))


def archive_path(path: str) -> Column:
    """The folder of a row's archive under `path`."""
    return F.concat_ws("/", F.lit(path.rstrip("/")), *(F.concat(F.lit(f"{c}="), F.col(c)) for c in ("dataset", "split", "archive")))


def datasets(spark: SparkSession, path: str, specs: str | Sequence[str]) -> DataFrame:
    """The rows of some dataset/split pairs: Parquet partitions that are not asked for are not read."""
    wanted = parsed_specs(specs)
    cond = F.lit(False)
    for d, splits in wanted.items():
        cond = cond | ((F.col("dataset") == d) & F.col("split").isin(*splits))
    rows = spark.read.parquet(path)
    there = {(r.dataset, r.split) for r in rows.select("dataset", "split").distinct().where(cond).collect()}  # as many as are asked for
    missing = [f"{d}/{s}" for d, splits in wanted.items() for s in splits if (d, s) not in there]
    if missing:
        raise ValueError(f"not written: {', '.join(missing)}")
    return rows.where(cond)


def combination(spark: SparkSession, path: str, registry: DataFrame, specs: Sequence[str]) -> DataFrame:
    """The rows of a registered combination's own archive if it is written, else of its datasets."""
    found = registered(registry, specs).first()
    if found is not None:
        try:
            return datasets(spark, path, f"combine/{found.combo_idx}")
        except ValueError:
            pass
    return datasets(spark, path, specs)


def looked_up(index: DataFrame, archive: DataFrame, permissive: bool = False) -> DataFrame:
    """The archive's rows that an index names, by path and location, under the index's uttid. archive: uttid (its location), path, and what it holds; see archive_path()."""
    rows = archive.withColumnsRenamed({"uttid": "_loc", "path": "_path"})
    return index.join(rows, (F.col("path") == F.col("_path")) & (F.col("loc") == F.col("_loc")), "left" if permissive else "inner").drop("_loc", "_path")


def read_sounds(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, rate, error) of wave, FLAC and SPHERE files, as 16-bit numbers. x has a row a sample, with its channels; a file that can't be read has an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rate, x, error = None, None, None
                try:
                    rate, samples = sound_format.decode(content.as_py())
                    x = samples.tolist()
                except Exception as e:  # noqa: BLE001  one bad file is reported, not fatal
                    error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([x], pa.list_(pa.list_(pa.int32()))), pa.array([rate], pa.float64()), pa.array([error], pa.string())], ["path", "x", "rate", "error"])

    return files.select("path", "content").mapInArrow(decode, "path string, x array<array<int>>, rate double, error string")


read_waves = read_sounds


def matrix_archive(items: Sequence[tuple[str, np.ndarray]]) -> bytes:
    """The binary archive of float matrices."""
    return b"".join(matrix_format.entry_bytes(k, m)[0] for k, m in items)


def read_matrices(spark: SparkSession, path: str, rate_row: bool = True) -> DataFrame:
    """(uttid, path, loc, x, rate) of binary archives; with rate_row, the first row of each matrix holds the rate (zero: none)."""
    files = spark.read.format("binaryFile").load(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = matrix_format.entries(io.BytesIO(content.as_py()))
                yield from archive_source.batched((key, name, str(at), *(archive_source.without_rate(m) if rate_row else (m, None))) for key, at, m in values)

    return files.select("path", "content").mapInArrow(decode, archive_source.SCHEMA)


def by_specifier(spark: SparkSession, rspecifier: str, **options: str | int | bool) -> DataFrame:
    """The rows (uttid, path, loc, x, rate) that scp:<index> or ark:<archive> names; see archive_source."""
    archive_source.register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(archive_source.FORMAT).option("pushdown", pushdown).options(**options).load(rspecifier)


def write_indexed(df: DataFrame, path: str, **options: str | int | bool) -> DataFrame:
    """Writes (uttid, x, rate) as an archive, or as sound files, with an index for each task; returns the rows as the indexes name them."""
    archive_source.register(df.sparkSession)
    cells = F.transform("x", lambda row: row.cast("array<float>"))
    df.select("uttid", cells.alias("x"), F.col("rate").cast("double").alias("rate")).write.format(archive_source.FORMAT).options(**options).mode("append").save(path)
    return by_specifier(df.sparkSession, f"scp:{path}", **{k: v for k, v in options.items() if k in ("filetype", "rate_row")})

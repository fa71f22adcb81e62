"""What the operators of this subpackage share: scratch tables, checkpoints and batch sizes."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..plans.ordering import reliable, shared_dir

#: Scratch paths taken in the settled() that is running.
_taken: ContextVar[list[str] | None] = ContextVar("taken", default=None)
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends, or with the settled() it is taken in."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    if (taken := _taken.get()) is not None:
        taken.append(path)
    return path


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the frames that are made and executed within go when their execution ends, not when the driver collects its garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """The small tables of iterative jobs."""
    with freed_shuffles(df.sparkSession):
        return reliable(df.select("*"))


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder; a lost executor costs nothing that is written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(name: str, make: Callable[..., DataFrame], *args, **options) -> DataFrame:
    """make(...), written; the scratch tables that were written on the way to it go at once.

    What else make() hands out must not be read from these.
    """
    taken: list[str] = []
    outer = _taken.set(taken)
    try:
        df = make(*args, **options)
    finally:
        _taken.reset(outer)
    out = written(df, name)
    for path in taken:
        fs, at = _at(df.sparkSession, path)
        fs.delete(at, True)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, so that Python workers hold a few MB of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have: name, or name with underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def per_row(make: Callable[[], Callable[..., dict | None]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one of rows. make() runs once a task and returns row -> result (or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            cols = [texts_of(c) if pa.types.is_string(c.type) else c.to_pylist() for c in batch.columns]
            out = [y for x in zip(*cols, strict=True) if (y := row(*x)) is not None]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def packed(df: DataFrame, column: str) -> DataFrame:
    """df with a text column as zstd-compressed bytes, for joins that move whole texts; unpacked() gives the UTF-8 bytes back."""
    names = df.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            small = pa.array([None if x is None else z.compress(x) for x in b.column(at).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([small if i == at else c for i, c in enumerate(b.columns)], names)

    return df.mapInArrow(run, StructType([StructField(f.name, BinaryType()) if f.name == column else f for f in df.schema.fields]))


def unpacked(column: pa.Array) -> list[bytes | None]:
    z = zstandard.ZstdDecompressor()
    return [None if x is None else z.decompress(x) for x in column.to_pylist()]


def fold(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

"""The training loader: an epoch's batches of one replica, and the stream of archive files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.arrays import length_mask, padded
from ..operators.ordered import dynamic_batches, epoch_order, equal_parts, fixed_batches, parts_of_batches
from ..plans.ordering import reliable
from ..plans.pipeline import Pipeline


def collated(batches: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("part", "batch", "padded")) -> DataFrame:
    """One row a batch: items is its utterances in order. A batch has a set size, so a row is small."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", *columns))), lambda s: F.struct(*(s[c].alias(c) for c in columns)))
    return batches.groupBy(*keys).agg(items.alias("items"))


def padded_batches(batches: DataFrame, x: str = "x", keys: Sequence[str] = ("part", "batch")) -> DataFrame:
    """batches with x of each utterance padded to the longest of its batch, and the mask of what is its own."""
    longest = batches.groupBy(*keys).agg(F.max(F.size(x)).alias("_longest"))
    zero = F.lit(0).cast(batches.schema[x].dataType.elementType)
    return batches.join(longest, list(keys)).withColumn("mask", length_mask(F.size(x), F.col("_longest"))).withColumn(x, padded(F.col(x), F.col("_longest"), zero)).drop("_longest")


class Loader:
    """Batches of utterances for one of several replicas.

    index: (uttid, archive, length, ord …), narrow; its order, batches and parts are planned for each epoch from these columns
    alone, and payload (uttid, x, rate …) is joined for this replica's utterances only. The epoch is a parameter of a plan, so
    that setting it costs nothing until batches are read.
    """

    def __init__(self, index: DataFrame, payload: DataFrame, transform_conf: Sequence[dict] | None = None, precomputed: str | None = None, batch_size: int = 1, max_len: float | None = None, train: bool = False, shuffle: bool = False, num_replicas: int = 1, rank: int = 0, ensure_equal_parts: bool = True, labels: DataFrame | None = None):
        if rank >= num_replicas:
            raise ValueError(f"rank {rank} is not under {num_replicas}")
        self.pipeline = Pipeline(transform_conf, precomputed)
        self.index, self.payload, self.labels = index.withColumn("length", F.col("length") * self.pipeline.length_ratio()), payload, labels
        self.batch_size, self.max_len, self.train, self.shuffle = batch_size, max_len, train, shuffle
        self.num_replicas, self.rank, self.equal = num_replicas, rank, ensure_equal_parts
        self.epoch, self.current_position = 0, 0
        self._planned: DataFrame | None = None
        self._iterator: Iterator[list[Row]] | None = None

    def plan(self) -> DataFrame:
        """(uttid, part, batch, pos, padded) of the epoch, for all replicas."""
        if self._planned is None:
            rows = epoch_order(self.index, self.epoch).withColumnRenamed("pos", "_order") if self.shuffle else self.index.withColumnRenamed("ord", "_order")
            batches = fixed_batches(rows, ["_order"], self.batch_size) if self.max_len is None else dynamic_batches(rows, ["_order"], "length", self.batch_size, self.max_len)
            parted = equal_parts(batches, self.num_replicas) if self.equal else parts_of_batches(batches, self.num_replicas).withColumn("padded", F.lit(False))
            self._planned = reliable(parted.select("uttid", "part", "batch", "pos", "padded"))
        return self._planned

    def own(self) -> DataFrame:
        return self.plan().where(F.col("part") == self.rank)

    def batches(self) -> DataFrame:
        """(part, batch, padded, items) of this replica, x transformed."""
        rows = self.own().join(self.payload, "uttid")
        rows = self.pipeline.apply(rows, self.train, self.epoch).drop("rate")
        if self.labels is not None:
            rows = rows.join(self.labels, "uttid", "left")
        return collated(rows, [c for c in rows.columns if c not in ("part", "batch", "pos", "padded")])

    def __len__(self) -> int:
        return self.own().select("batch", "padded").distinct().count()

    @property
    def num_utts(self) -> int:
        return self.own().count()

    def set_epoch(self, epoch: int) -> None:
        self.epoch, self.current_position, self._planned, self._iterator = epoch, 0, None, None

    def __iter__(self) -> Iterator[list[Row]]:
        for r in self.batches().orderBy("padded", "batch").toLocalIterator(prefetchPartitions=True):
            yield r["items"]

    def next(self) -> list[Row]:
        """The next batch; after an epoch's last one the next epoch begins."""
        if self._iterator is None:
            self._iterator = iter(self)
        try:
            out = next(self._iterator)
        except StopIteration:
            self.set_epoch(self.epoch + 1)
            return self.next()
        self.current_position += 1
        return out

    def close(self) -> None:
        self._iterator = self._planned = None

    def __enter__(self) -> Loader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def archive_stream(spark: SparkSession, path: str, schema: StructType | str, files: int | None = 1, max_bytes: str | None = None, glob: str | None = None) -> DataFrame:
    """Archives as a stream that takes so many files, or about so many bytes, at a time. A folder that is one archive (dataset.parquet/) is read as a whole."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", glob is None)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(f"{path}/{glob}" if glob else path)

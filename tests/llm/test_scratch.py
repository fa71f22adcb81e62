import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, simhash, substring_dedup
from corpusloom.llm.connected import components

SF = "/root/testdata/sf0.001"


def shared(spark):
    return {p.name for p in Path(common.shared_dir(spark).removeprefix("file://")).iterdir()}


def shuffles(spark):
    """How many shuffle files this session has."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return files.count("/shuffle_")


@pytest.mark.parametrize("stage, left", [(simhash.keep_one, "kept"), (substring_dedup.remove_repeats, "ranges")])
def test_a_stage_leaves_one_small_table(spark, stage, left):
    docs = common.documents(spark, SF)
    before = shared(spark)
    out = stage(docs)
    assert {n[:-33] for n in shared(spark) - before if n[-33:-32] == "-"} == {left}
    assert 0 < out.count() <= docs.count()  # what has gone is not read


def test_written_tables_and_checkpoints_leave_no_shuffle_files(spark):
    docs = common.documents(spark, SF)
    spark._jvm.System.gc()
    before = shuffles(spark)
    grouped = docs.groupBy("source").agg(F.count("*").alias("n"))
    again = common.written(grouped.join(docs.groupBy("source").agg(F.max("doc_id").alias("last")), "source").repartition(3, "n"), "sums")
    edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") % 20).alias("b"))
    roots = components(edges, "a", "b")
    end = time.time() + 20
    while shuffles(spark) > before and time.time() < end:
        time.sleep(0.2)
    assert shuffles(spark) <= before
    assert again.count() == grouped.count() and sorted(map(tuple, roots.collect())) == [(i, i % 20) for i in range(20, 400)]
    assert spark.conf.get(common._FREED) == "false"  # the session's own setting


def test_settled_keeps_the_outer_tables(spark):
    def inner():
        return common.written(spark.range(5).toDF("x"), "inner")

    def outer():
        a = common.written(spark.range(3).toDF("x"), "first")
        b = common.settled("second", inner)
        return a.unionByName(b)

    before = shared(spark)
    got = common.settled("third", outer)
    assert sorted(r.x for r in got.collect()) == [0, 0, 1, 1, 2, 2, 3, 4]
    assert {n[:-33] for n in shared(spark) - before} == {"third"}

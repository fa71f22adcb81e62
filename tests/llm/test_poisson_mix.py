import math

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import poisson_mix, queries

SF = "/root/testdata/sf0.001"


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(poisson_mix.ORACLE)
    got = queries.op4_poisson_mix(spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    key = got.columns
    rows = [tuple(r) for r in got.collect()]
    assert [r[key.index("shuffle_key")] for r in rows] == sorted(r[key.index("shuffle_key")] for r in rows)
    assert sorted(rows) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in key]).fetchall())


def test_inverse_against_a_loop(spark):
    us = [i / 1000 for i in range(1000)] + [1 - 2**-52]
    df = spark.createDataFrame([(u, m) for u in us for m in (0.0, 0.3, 1.0, 7.5, 120.0)], "u double, m double")

    def loop(u, m):
        k, p = 0, math.exp(-m)
        cdf = p
        while u >= cdf and k < int(2 * m) + 40:
            k += 1
            p *= m / k
            cdf += p
        return k

    got = df.withColumn("k", poisson_mix.poisson_inverse(F.col("u"), F.col("m"))).collect()
    assert [r for r in got if r.u < 0.9999 and r.k != loop(r.u, r.m)] == []
    assert all(loop(0.999, r.m) <= r.k <= 2 * r.m + 40 for r in got if r.u > 0.9999)


def test_weights_and_edge_rows(spark):
    rows = [(i, "a" if i % 3 else None, "x" if i % 5 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy int")
    got = {r.source: r.n for r in poisson_mix.replicate(df, {"a": 1.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert None not in got and got["a"] == pytest.approx(3000, rel=0.1)
    even = {r.source: r.n for r in poisson_mix.replicate(df, alpha=0.0).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert even[None] == pytest.approx(1500, rel=0.12) and even["a"] == pytest.approx(1500, rel=0.12)
    many = spark.createDataFrame([(0, "r")] + [(i, "s") for i in range(1, 1500)], "doc_id long, source string")
    assert poisson_mix.replicate(many, {"r": 1.0}).count() == pytest.approx(1500, rel=0.1)
    assert poisson_mix.replicate(df.limit(0)).count() == 0
    twice = df.where("doc_id = 7").unionAll(df.where("doc_id = 7"))
    assert poisson_mix.replicate(twice).count() % 2 == 0
    none = spark.createDataFrame([(None, "a", None)], "doc_id long, source string, text string")
    assert poisson_mix.replicate(none).count() >= 0


def test_columns_of_any_name_stay(spark):
    rows = [(i, "a", f"t{i}", 0.5, 9, "k", 3) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, rate double, copies int, shuffle_key string, `row` int")
    got = poisson_mix.mixed(df)
    assert got.columns == df.columns
    times = {r.doc_id: r.copies for r in poisson_mix.replicate(df).select("doc_id", "copies").collect()}
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows for _ in range(times.get(r[0], 0)))


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", 1, 2, 3, "k") for i in range(60)], "doc_id long, source string, mix_source int, Copies int, MIX_RATE int, n string")
    got = poisson_mix.replicate(df)
    assert got.columns == ["doc_id", "source", "mix_source", "MIX_RATE", "n", "rate", "copies", "copy", "shuffle_key"]
    plain = poisson_mix.replicate(df.select("doc_id", "source"))
    assert [(r.doc_id, r.copies, r.copy, r.mix_source, r.MIX_RATE) for r in got.collect()] == [(r.doc_id, r.copies, r.copy, 1, 3) for r in plain.collect()]

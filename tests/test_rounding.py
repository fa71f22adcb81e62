"""Queries that round, on tables full of ties and of values next to zero; negative zeros count."""

import os
import random

import duckdb
import pytest

from corpusloom import queries
from corpusloom.functions import arrays

SF = "/root/testdata/sf0.001"


@pytest.fixture
def altered(tmp_path):
    """alter(table, sql): the tables with one of them replaced by a query of it."""

    def alter(table, sql):
        for f in os.listdir(SF):
            if f != f"{table}.parquet":
                os.symlink(f"{SF}/{f}", tmp_path / f)
        duckdb.sql(f"COPY (WITH t AS (SELECT * FROM '{SF}/{table}.parquet') {sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return alter


def both(spark, name, path):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(path):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}/{f}'")
    got, want = queries.QUERIES[name](spark, path), con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    return sorted(repr(tuple(r)) for r in got.select(*columns).collect()), sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_rounded_as_duckdb(spark):
    rng = random.Random(3)
    values = [rng.randrange(1, 50) - rng.randrange(640) / 640 - 5 for _ in range(3000)] + [k / 2e6 * s for k in range(200) for s in (1, -1)] + [0.0, -0.0, -1e-9, 1e-9, float("inf"), None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", arrays.rounded("v", 6).alias("r")).collect()
    con = duckdb.connect()
    con.sql("CREATE TABLE t (i INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(r.v for r in got)))
    assert [repr(r.r) for r in got] == [repr(r[0]) for r in con.sql("SELECT round(v, 6) FROM t ORDER BY i").fetchall()]


def test_ties_of_means(spark, altered):
    """Lengths of 640 words less their mean end in a tie of the seventh place."""
    word = "repeat('x', 1 + (('0x' || substr(md5(doc_id || '-' || i), 1, 6))::INT % 15))"
    path = altered("documents", f"SELECT * REPLACE (array_to_string(list_transform(range(640), lambda i: {word}), ' ') AS text) FROM t")
    got, want = both(spark, "loader_batches", path)
    assert got == want


def test_negative_zeros(spark, altered):
    path = altered("embeddings", "SELECT * REPLACE (list_transform(embedding, lambda v: (v / 1e5)::FLOAT) AS embedding) FROM t")
    got, want = both(spark, "noise_store", path)
    assert any("-0.0" in r for r in want) and got == want

import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import queries, substring_dedup

SF = "/root/testdata/sf0.001"


def brute(rows, window=50):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_query_against_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = [tuple(r) for r in queries.op9_substring_dedup(spark, SF).collect()]
    assert order(got) == order(brute(rows)) and sum(r[2] for r in got)


def test_planted_passages(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(9000)}"
    passage = [word() for _ in range(70)]
    rows = []
    for d in range(60):
        body = [word() for _ in range(rng.choice((10, 60, 200)))]
        cut = rng.randrange(len(body))
        part = passage[rng.randrange(0, 25) :][: rng.choice((45, 50, 51, 70))]
        rows.append((d, " ".join(body[:cut] + part * rng.choice((1, 1, 2)) + body[cut:])))
    near = rows[3][1].split()
    for d in range(60, 90):
        copy = list(near)
        copy[rng.randrange(len(copy))] = word()
        rows.append((d, "\n".join(copy)))
    rows += [(90, "a " * 3000), (91, "a " * 2000 + "b " * 49), (92, None), (93, ""), (94, rows[3][1]), (94, rows[3][1]), (94, "b " + rows[4][1]), (None, rows[3][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, text_key string, ranges int")
    for batches in (1, 3):
        got = [tuple(r) for r in substring_dedup.removal_digests(df, batches=batches).collect()]
        assert order(got) == order(brute(rows))
    out = substring_dedup.remove_repeats(df)
    assert out.columns == df.columns
    left = {d: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for d, t, x, one in map(tuple, out.collect()) if (x, one) == ("x", 1)}
    want = {d: sha for d, n, gone, sha in brute(rows) if d != 94 and (gone < n or not n)}
    assert want.items() <= left.items() and left.keys() <= {*want, 94}
    assert substring_dedup.removal_digests(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=8, max_size=60))
def test_spans_cover_all_windows_and_name_their_words(words):
    w = substring_dedup.Words(" ".join(words).encode(), window=8, gram=3)
    m, a, b = w.spans()
    assert a[0] == 0 and b[-1] == len(words) - 8 and all(a[1:] == b[:-1] + 1)
    import numpy as np

    starts = np.arange(len(words) - 7)
    h = w.hashes(substring_dedup._B1, starts, 8)
    for i in starts:
        for j in starts:
            assert (h[i] == h[j]) == (words[i : i + 8] == words[j : j + 8])


def test_index_over_batches_that_arrive(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    rows = [(d, " ".join(words[d * 7 : d * 7 + 120])) for d in range(40)]
    spans = substring_dedup._spans(50, 12)
    seen, parts = set(), (rows[:10], rows[10:15], rows[15:16], rows[16:30], rows[30:])
    for n, part in enumerate(parts, 1):
        index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", fan_in=2)  # each job opens the folder anew
        df = spark.createDataFrame([(d, d, t) for d, t in part], "doc_id long, text_key long, text string")
        repeats, doubtful = index.add(df.mapInArrow(spans, substring_dedup.RUN))
        first = {r.doc_id for r in repeats.collect()} | {r.doc_id for r in doubtful.collect()}
        assert {d for d, _ in part if d} <= first  # each shares windows with the one before it
        seen |= {d for d, _ in part}
        run = index.history().toPandas()
        assert not run.duplicated(["m", "h1", "h2"]).any() and set(run.doc_id) <= seen
        assert sorted(level for _, level in index.runs()) == [b for b in range(4) if n >> b & 1]  # levels of sizes 1, 2, 4: no batch rewrites all
    with pytest.raises(ValueError, match="up to 39"):
        index.add(df.mapInArrow(spans, substring_dedup.RUN))


def test_two_jobs_on_one_index_are_like_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cut = sorted(r.doc_id for r in docs.select("doc_id").collect())[120]
    old, new = docs.where(f"doc_id <= {cut}"), docs.where(f"doc_id > {cut}")
    folder = f"file://{tmp_path}/index"
    got = [tuple(r) for r in substring_dedup.removal_digests(old, batches=2, index=substring_dedup.FingerprintIndex(spark, folder)).collect()]
    with pytest.raises(ValueError, match="earlier"):
        substring_dedup.removal_digests(new, index=substring_dedup.FingerprintIndex(spark, folder))
    got += [tuple(r) for r in substring_dedup.removal_digests(new, batches=1, index=substring_dedup.FingerprintIndex(spark, folder), earlier=old).collect()]
    assert order(got) == order(brute([tuple(r) for r in docs.collect()]))

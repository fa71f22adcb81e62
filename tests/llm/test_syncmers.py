import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import queries, syncmers

SF = "/root/testdata/sf0.001"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abé\U0001f600", min_size=24, max_size=200))
def test_places_against_a_loop(text):
    c = np.array([ord(x) for x in text])
    h = syncmers._mers(c.astype(np.uint64), syncmers.S)
    inner = syncmers.K - syncmers.S
    want = [i for i in range(len(c) - syncmers.K + 1) if min(h[i : i + inner + 1]) in (h[i], h[i + inner])]
    at, _ = syncmers.syncmers(c)
    assert at.tolist() == want
    assert all((h[i] == h[j]) == (text[i : i + syncmers.S] == text[j : j + syncmers.S]) for i in range(len(h)) for j in range(len(h)))


def test_anchors_do_not_depend_on_context():
    rng = np.random.default_rng(3)
    a, b, c = (rng.integers(97, 123, n) for n in (500, 300, 400))
    own = {int(x) for x in syncmers.syncmers(b)[1]}
    assert own <= {int(x) for x in syncmers.syncmers(np.concatenate([a, b, c]))[1]}
    long = rng.integers(97, 123, syncmers._CHUNK * 2 + 77)
    at, h = syncmers.syncmers(long)
    assert len(at) == len({*at.tolist()}) and (np.diff(at) > 0).all()
    middle, _ = syncmers.syncmers(long[syncmers._CHUNK - 500 : syncmers._CHUNK + 500])
    assert {*(middle + syncmers._CHUNK - 500).tolist()} == {x for x in at.tolist() if syncmers._CHUNK - 500 <= x <= syncmers._CHUNK + 500 - syncmers.K}


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        mine, new, nxt = (syncmers.sketch(syncmers._code_points(x.encode())) for x in (t, edited, after))
        out[d] = (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), syncmers.written_out(mine), syncmers.written_out(new), syncmers.likeness(mine, new), syncmers.likeness(mine, nxt))
    return out


def test_query_against_a_loop(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op7_syncmers(spark, SF).collect()]
    want = plain(rows)
    assert {r[0]: r for r in got} == want and len(got) == len(rows)
    far = [r for r in got if r[1] >= 300]
    assert sum(r[5] for r in far) / len(far) > 0.4 and sum(r[6] for r in far) / len(far) < 0.05


def test_edge_rows(spark):
    rows = [(i, f"text {i} " * (i % 90)) for i in range(300)] + [(500, None), (501, ""), (502, "long " * 50_000), (503, "é"), (None, "none")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bucket int")
    for size in (40, 10_000):
        pairs = syncmers.with_next(df, size).mapInArrow(syncmers._compared, syncmers.RESULT)
        assert {r[0]: tuple(r) for r in pairs.collect()} == plain(rows)
    one = syncmers.fingerprint_pairs(df.where("doc_id = 5")).first()
    assert one.near_next == 1.0 and one.near_edited < 1
    twice = df.where("doc_id in (5, 6)").unionAll(df.where("doc_id in (5, 6)"))
    assert sorted(r.doc_id for r in syncmers.fingerprint_pairs(twice).collect()) == [5, 5, 6, 6]
    assert syncmers.fingerprint_pairs(df.limit(0)).count() == 0


def test_hot_ids_have_several_buckets(spark):
    """Most rows have one id, or none: in order of their text's hash, over many buckets."""
    rows = [(d, f"text {i} of {d} " * 5) for i in range(150) for d in (7, None)] + [(d, f"only {d} " * 9) for d in range(60)] + [(7, "the same") for _ in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = syncmers.with_next(df, 20)
    sizes = {r.bucket: r["count"] for r in dealt.where("lent = 0").groupBy("bucket").count().collect()}
    assert len(sizes) > 15 and max(sizes.values()) < 60
    got = sorted((r.doc_id is None, r.doc_id or 0, r.edited_sha256) for r in syncmers.fingerprint_pairs(df, bucket_rows=20).collect())
    keyed = [(r.doc_id, r.text, r.h) for r in df.selectExpr("*", "xxhash64(text) as h").collect()]
    order = sorted(keyed, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    want = []
    for (d, t, _), (_, after, _) in zip(order, [*order[1:], order[0]], strict=True):
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        want.append((d is None, d or 0, hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want)


def test_likeness_by_few_anchors_is_near_that_by_all(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 3000").select("text").limit(60).collect()]
    off = []
    for t, after in zip(texts, texts[1:], strict=False):
        for share in (3, 6, 20):
            cut = len(t) // share
            a, b = (syncmers._code_points(x.encode()) for x in (t, t[: len(t) - cut] + after[:cut]))
            off.append(syncmers.likeness(syncmers.sketch(a), syncmers.sketch(b)) - syncmers.likeness(syncmers.sketch(a, None), syncmers.sketch(b, None), None))
    assert np.std(off) < 0.06 and abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 0.2

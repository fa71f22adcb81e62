import itertools
import random

import duckdb
import pytest
import xxhash

from corpusloom.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fp = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, f"{fp[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def test_query_against_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = sorted(map(tuple, queries.op1_simhash(spark, SF).collect()))
    assert got == brute(rows)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "One two", "x"), (5, "one  TWO", "x"), (5, "one  TWO", "x"), (6, long, "x"), (7, long + " end", "x"), (9, "ÀÉ \x85 a b c", None), (None, "one two", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (6, 6), (7, 6)} <= got
    assert simhash.near_duplicates(df).count() == 10
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 9]


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def joined(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def clusters(rng, n):
    """Fingerprints around a few centres, of which many share their first or second half."""
    half = rng.getrandbits(32)
    centres = [half, half | rng.getrandbits(32) << 32, rng.getrandbits(64), 1 << 63, 0]
    out = set()
    while len(out) < n:
        f = rng.choice(centres)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 2, 3, 5])):
            f ^= 1 << b
        out.add(signed(f))
    return sorted(out)


@pytest.mark.parametrize("limit", [2, 5, 200])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_against_all_pairs(spark, limit, bits):
    fps = clusters(random.Random(limit + bits), 150)
    nodes = spark.createDataFrame([(f, f) for f in fps], "fp long, node long")
    got = [tuple(r) for r in simhash.links(nodes, bits, limit).collect()]
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= bits for a, b in got)
    assert joined(got, fps) == joined(near, fps)
    if limit == 200:
        assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in near} and len(got) == len(near)


def test_verification_rejects(spark):
    """Values that meet in a segment are not links yet: the complete distance turns some away."""
    fps = clusters(random.Random(3), 150)
    nodes = spark.createDataFrame([(f, [f]) for f in fps], "node long, sig array<long>")
    s = simhash.TWO_BITS
    met = simhash.asked(nodes, s).join(simhash._other(simhash.table(nodes, s)), "key").where("node > other").select("node", "other").distinct().count()
    assert met > simhash.cold_pairs(nodes, s, simhash.hot_values(nodes, s, 200)).count() > 0


def test_one_id_with_different_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "q r s t u v w"), (3, "q r s t u v w"), (None, "x y z x y z x")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, None), (1, 1), (2, 1), (2, 2), (3, 2)]

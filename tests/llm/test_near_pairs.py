import itertools
import random

import duckdb

from corpusloom.llm import simhash

SF = "/root/testdata/sf0.001"


def near(x, y):
    x, y = ({*zip(*(t.lower().split()[i:] for i in range(5)), strict=False)} or {tuple(t.lower().split())} for t in (x or "", y or ""))
    return len(x & y) >= 0.8 * len(x | y)


def brute(rows):
    """The ids that stay, by all pairs."""
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if near(x, y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted(d for d in root if root[d] == d)


def kept(spark, rows):
    return sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_edited_copies_go(spark):
    rng = random.Random(7)
    rows = []
    for d, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' where length(text) > 600 order by doc_id limit 60").fetchall():
        words = t.split()
        for i in rng.sample(range(len(words)), max(1, len(words) // 100)):
            words[i] = f"edit{i}"
        rows += [(d, t), (d + 1_000_000, " ".join(words))]
    copies = [(a, b) for a, b in zip(rows[::2], rows[1::2], strict=True) if near(a[1], b[1])]
    assert len(copies) > 50
    left = kept(spark, rows)
    assert not {b[0] for _, b in copies} & {*left}


def test_table_against_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert kept(spark, rows) == brute(rows)


def test_large_group(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(200)]
    assert kept(spark, [*rows, (1000, "one two three four five six")]) == [0, 1000]


def test_one_id_with_different_texts(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "u v w x y z u v w"), (2, "u v w x y z u v w"), (3, "k l m n o p q")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [rows[0], rows[2], rows[4]]


def test_hot_values(spark):
    """With a small limit every value of the group is hot: pivots, then group against group, find what the join finds."""
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(300)]
        for c in range(12):
            words = list(base)
            for i in rng.sample(range(300), 3):
                words[i] = f"e{g}x{c}x{i}"
            rows.append((100 * g + c, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df, limit=3).collect()) == sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [100 * g for g in range(6)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, "k"), (2, "a b c d e f", 8, "l")], "doc_id long, text string, text_hash long, node string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns and list(map(tuple, got.collect())) == [(1, "a b c d e f", 7, "k")]


def test_a_common_passage_brings_no_pairs(spark):
    """Texts that share 300 of 430 words are no duplicates: what they are compared with grows with their number, not its square. Among them all true pairs are found."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(300)]
    counts = {}
    for n in (150, 300):
        rows = []
        for d in range(n):
            own = [f"d{d}w{i}" for i in range(130)]
            rows.append((d, " ".join(own[:60] + common + own[60:])))
            if d % 10 == 0:
                words = rows[-1][1].split()
                for i in rng.sample(range(430), 4):
                    words[i] = f"edit{d}x{i}"
                rows.append((10_000 + d, " ".join(words)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        near_rows = df.selectExpr("doc_id", "text", "doc_id AS k").mapInArrow(simhash._near_rows, "doc_id long, node long, sig array<long>, z binary, row_key long").cache()
        members = near_rows.selectExpr("node", "node AS root", "sig")
        pairs = simhash.rare_pairs(members, near_rows).collect()
        doc = {r.node: r.doc_id for r in near_rows.collect()}
        found = {tuple(sorted((doc[r.node], doc[r.other]))) for r in pairs}
        want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if a + 10_000 == b and near(x, y)}
        assert want and want <= found
        counts[n] = len(found)
    assert counts[300] <= 2.5 * counts[150] and counts[300] < 300


def test_rare_shingles_lose_no_pair(spark):
    """Of sets of every size and similarity, all pairs at 0.8 or more meet."""
    rng = random.Random(11)
    rows = []
    for g in range(25):
        base = [f"g{g % 5}w{i}" for i in range(rng.choice([1, 3, 5, 6, 8, 20, 80]))]
        for c in range(4):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words.insert(rng.randrange(len(words) + 1), f"x{g}c{c}")
            rows.append((len(rows), " ".join(words)))
    for k in (7, 14, 23, 28):  # exactly 0.8
        rows += [(len(rows), " ".join(f"t{k}w{i}" for i in range(4 * k + 4))), (len(rows) + 1, " ".join(f"t{k}w{i}" for i in range(5 * k + 4)))]
    near_rows = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id AS k").mapInArrow(simhash._near_rows, "doc_id long, node long, sig array<long>, z binary, row_key long").cache()
    text = {r.node: rows[r.doc_id][1] for r in near_rows.collect()}
    got = {frozenset((r.node, r.other)) for r in simhash.rare_pairs(near_rows.dropDuplicates(["node"]).selectExpr("node", "node AS root", "sig"), near_rows, simhash.Segments(4, 20, (1,) * 12, 256)).collect()}
    assert {frozenset((a, b)) for a, b in itertools.combinations(text, 2) if near(text[a], text[b])} <= got


def test_texts_under_the_bound_bring_few_pairs(spark):
    """Texts of Jaccard 0.71 have like fingerprints and share rare shingles: parities turn them away, so that what is compared follows their number. The true pairs stay."""
    rng = random.Random(13)
    base = [f"c{i}" for i in range(300)]
    rows = []
    for d in range(80):
        words = list(base)
        for i in rng.sample(range(2, 298), 5):
            words[i] = f"d{d}x{i}"
        rows.append((d, " ".join(words)))
        if d % 10 == 0:
            rows.append((1000 + d, " ".join([*words[:150], f"edit{d}", *words[151:]])))
    near_rows = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id AS k").mapInArrow(simhash._near_rows, "doc_id long, node long, sig array<long>, z binary, row_key long").cache()
    doc = {r.node: r.doc_id for r in near_rows.collect()}
    found = {tuple(sorted((doc[r.node], doc[r.other]))) for r in simhash.rare_pairs(near_rows.selectExpr("node", "node AS root", "sig"), near_rows).collect()}
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if near(x, y)}
    assert len(want) >= 8 and want <= found
    assert len(found) < 3 * len(rows)


def test_parities_differ_in_no_more_bits_than_sets_in_shingles():
    rng = random.Random(17)
    for n in (1, 4, 5, 30, 300, 3000):
        one = [f"w{rng.randrange(n)}" for _ in range(n)]
        two = [w if rng.random() < 0.97 else "other" for w in one]
        x, y = (" ".join(t).encode() for t in (one, two))
        (_, a), (_, b) = simhash.near_signature(x), simhash.near_signature(y)
        first = simhash.NEAR.words + 1
        bits = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(a[first:], b[first:], strict=True))
        assert bits <= len(simhash.shingles(x) ^ simhash.shingles(y))
        assert (a[first - 1], b[first - 1]) == (len(simhash.shingles(x)), len(simhash.shingles(y)))

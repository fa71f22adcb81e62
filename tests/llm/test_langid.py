import math
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_query_on_held_out_rows(spark):
    got = queries.op8_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_edge_rows(spark):
    rows = [(i, f"the cat number {i} and the dog" if i % 2 else f"der hund nummer {i} und die katze", "en" if i % 2 else "de", 0.5) for i in range(120)]
    rows += [(200, None, "en", 1.0), (201, "", "en", 1.0), (202, "12 34 !!", None, 1.0), (203, "the dog and the cat", None, 1.0), (None, "der hund und die katze", "de", 1.0), (204, "the " * 60_000, "en", 1.0), (3, "the cat number 3 and the dog", "en", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and got[200].score == 0
    assert got[203].lang_pred == "en" and got[None].lang_pred == "de" and got[204].lang_pred == "en"
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 0)).where("lang is null")).collect()} == {"und"}


def test_texts_without_a_letter_are_und():
    model = langid.Model(["en"], np.ones(langid.BUCKETS), np.zeros((langid.BUCKETS + 1, 1)))
    for text in ("½ ²", "Ⅷ ③", "12 _ !", "́"):
        assert model.predict(text.encode()) == ("und", 0.0)
    for text in ("ª", "é", "日", "x½"):
        assert model.predict(text.encode())[0] == "en"


def test_own_columns_stay_and_rare_languages_are_learned(spark):
    rows = [(i, f"the cat number {i} and the dog", "en", "mine", 7.0) for i in range(900)] + [(2000 + i, f"der hund nummer {i} und die katze", "de", "mine", 7.0) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, SCORE double")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {(r.lang_pred, r.SCORE) for r in kept.collect()} == {("mine", 7.0)}
    model = langid.train(df, fit_rows=20)
    assert model.languages == ["de", "en"] and model.predict(b"die katze und der hund")[0] == "de"


def test_training_against_loops():
    """TF-IDF, FTRL-proximal with both penalties and the temperature, by dictionaries and loops."""
    rng = np.random.default_rng(6)
    idf = 1.0 + rng.random(langid.BUCKETS)
    rows = []
    for i in range(40):
        at = np.sort(rng.choice(60, 8, replace=False))
        rows.append((int(at[0] > 6), at, rng.integers(1, 5, 8).astype(float)))
    model = langid.Model(["a", "b"], idf, np.zeros((langid.BUCKETS + 1, 2)))
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.01
    langid._ftrl(model, rows, 2, alpha, beta, l1, l2)
    z, n = Counter(), Counter()

    def weight(j, k):
        v = z[j, k]
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n[j, k])) / alpha + l2)

    def features(at, val):
        x = {int(j): math.log1p(v) * idf[j] for j, v in zip(at, val, strict=True)}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {j: v / norm for j, v in x.items()}

    for _ in range(2):
        for y, at, val in rows:
            x = {**features(at, val), langid.BUCKETS: 1.0}
            s = [sum(v * weight(j, k) for j, v in x.items()) for k in range(2)]
            p = [math.exp(v) / sum(map(math.exp, s)) for v in s]
            old = {(j, k): weight(j, k) for j in x for k in range(2)}
            for j, v in x.items():
                for k in range(2):
                    g = v * (p[k] - (k == y))
                    z[j, k] += g - (math.sqrt(n[j, k] + g * g) - math.sqrt(n[j, k])) / alpha * old[j, k]
                    n[j, k] += g * g
    want = np.zeros_like(model.weights)
    for j, k in z:
        want[j, k] = weight(j, k)
    assert np.allclose(model.weights, want) and (want != 0).sum() < len(z)

    def loss(t):
        out = 0.0
        for y, at, val in rows:
            s = [sum(v * want[j, k] for j, v in features(at, val).items()) + want[-1, k] for k in range(2)]
            out -= s[y] / t - math.log(sum(math.exp(v / t) for v in s))
        return out

    assert langid._temperature(model, rows) == pytest.approx(min(np.geomspace(0.05, 5.0, 60), key=loss))


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: 14], ids=["null", "one id", "another id"])
def test_rows_without_an_id_of_their_own(spark, ids):
    """All ids null, or one: both languages are learned, and the sample stays within its bound."""
    rows = [(ids(i), f"the cat number {i} and the dog", "en") for i in range(3000)] + [(ids(i), f"der hund nummer {i} und die katze", "de") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes, fitted = [], langid._ftrl

    def counted(model, data, *rest):
        sizes.append(len(data))
        fitted(model, data, *rest)

    langid._ftrl = counted
    try:
        model = langid.train(df, fit_rows=300, language_rows=50)
    finally:
        langid._ftrl = fitted
    assert model.languages == ["de", "en"] and 150 < sizes[0] < 500
    assert model.predict(b"die katze und der hund")[0] == "de" and model.predict(b"the dog and the cat")[0] == "en"


def test_many_copies_count_once(spark):
    rows = [(1, "the cat and the dog", "en")] * 2000 + [(2, "der hund und die katze", "de")] + [(3 + i, f"le chat numero {i} et le chien", "fr") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").where("doc_id % 3 >= 0")
    learned = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert langid.train(df, fit_rows=20, language_rows=5).languages == sorted(learned)

import random
import re
import time

from corpusloom.llm import license_scan, queries

SF = "/root/testdata/sf0.001"


def plain(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    hits = []
    for phrase, label in license_scan.BASE.items():
        p = phrase.encode().split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_query_against_plain_search(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op6_license_scan(spark, SF).collect()}
    assert got.keys() == {r.doc_id for r in rows}
    for r in rows:
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == plain(r.text)
        assert {*filter(None, g.base_labels.split(","))} <= {*filter(None, g.labels.split(","))} and (g.score > 0) == bool(g.labels)
    assert sum(r.n_base for r in got.values())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_notices():
    s = license_scan.scanner()
    cases = {"some words Released undr the MlT licence. more": "mit", "Licensed under the Apachee Licence, Versoin 2.0": "apache-2", "Creative Commons Atribution-NonComercial": "cc-by-nc", "licensed under the GNU Genral Public Licence, version 3": "gpl-3"}
    for text, label in cases.items():
        joined, starts = license_scan.joined(license_scan.normalised(text.encode()))
        found = s.fuzzy(joined, starts)
        assert label in {h.label for h in found}
        for h in found:
            notice, most = next((n, e) for n, e, x in license_scan.NOTICES if x == h.label and abs((1 - h.score) * len(n) - h.edits) < 1e-6)
            assert distance(joined[h.start : h.end], notice) == h.edits <= most
    for text in ("a plain text about nothing at all", "the public was licensed to play", "under the sea the general version"):
        assert s.fuzzy(*license_scan.joined(text.encode().split())) == []


def test_the_closest_of_like_notices_stays():
    s = license_scan.scanner()
    for text, labels in [("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}), ("licensed under cc by sa 4 0", {"cc-by-sa"}), ("licensed under the GNU General Public License, version 3", {"gpl-3"}), ("Released under the MIT License. All rights reserved", {"mit", "all-rights-reserved"})]:
        assert {h.label for h in s.scan(license_scan.normalised(text.encode()))} == labels


def test_edge_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "CC BY-NC cc by nc ccé by nc", 0), (4, "word " * 50_000 + "under the mit license", 0), (None, "under the mit license", 0), (3, "CC BY-NC cc by nc ccé by nc", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = [tuple(r) for r in license_scan.labelled(df).collect()]
    assert sorted((r[0] or 0, *r[1:6]) for r in got) == sorted((d or 0, *plain(t)) for d, t, _ in rows)
    assert license_scan.labelled(df.limit(0)).count() == 0


def test_adjacent_notices_are_all_found():
    text = b"licensed under the mit licence licensed under the mit license licensed under the mit licence"
    found = sorted((h.start, h.end, h.edits) for h in license_scan.Scanner().fuzzy(*license_scan.joined(text.split())) if h.label == "mit" and h.end - h.start == 30)
    assert [(a, b) for a, b, _ in found][:1] == [(0, 30)] and {(31, 61, 0), (62, 92, 1)} <= {*found}


def test_all_places_against_edit_distances():
    """Each notice with up to its errors, at random places: the hits are those a search of all spans finds, the closest first."""
    notices = [("released under the mit license", 3, "mit"), ("all rights reserved", 1, "rights")]
    s, rng = license_scan.Scanner({}, notices), random.Random(4)
    for _ in range(40):
        text = []
        for _ in range(rng.randrange(1, 5)):
            n = list(rng.choice(notices)[0])
            for _ in range(rng.choice([0, 0, 1, 2])):
                n[rng.randrange(len(n))] = rng.choice("qxz")
            text += ["".join(n), *rng.sample(["foo", "some words", "other", "bar"], rng.randrange(3))]
        words = " ".join(text).split()
        want = []
        for notice, most, label in notices:
            spans, size = [], len(notice.split())
            for a in range(len(words)):
                for b in range(a + 1, min(len(words), a + size + most) + 1):
                    span = " ".join(words[a:b])
                    if abs(len(span) - len(notice)) <= most and (e := distance(span, notice)) <= most:
                        spans.append((e, a, b))
            taken = []
            for e, a, b in sorted(spans):
                if all(b <= x or y <= a for x, y in taken):
                    taken.append((a, b))
                    want.append((label, a, b - a, e))
        got = [(h.label, h.first_word, h.n_words, h.edits) for h in s.scan([w.encode() for w in words])]
        assert sorted(got) == sorted(want)


def test_many_places_cost_no_more_each():
    words = license_scan.normalised(b"licensed under cc by nc 4 0 " * 20_000)
    began = time.monotonic()
    hits = license_scan.scanner().scan(words)
    assert len(hits) == 40_000 and time.monotonic() - began < 20


def test_own_notices(spark):
    df = spark.createDataFrame([(1, "Proprietary and confidental, of ACME")], "doc_id long, text string")
    (row,) = license_scan.scan(df, {"of acme": "acme"}, [("proprietary and confidential", 2, "secret")]).collect()
    assert [(h.label, h.first_word, h.n_words, h.edits) for h in row.hits] == [("secret", 0, 3, 1), ("acme", 3, 2, 0)]

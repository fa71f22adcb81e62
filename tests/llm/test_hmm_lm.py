import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import hmm_lm, queries

SF = "/root/testdata/sf0.001"


def small(k=2, classes=5, seed=0):
    rng = np.random.default_rng(seed)
    emit = np.zeros((hmm_lm.CLASSES, k))
    emit[[*range(classes - 1), hmm_lm.END]] = rng.dirichlet(np.ones(classes), k).T
    return rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), emit


def paths(model, seq):
    start, move, emit = model
    for p in itertools.product(range(len(start)), repeat=len(seq)):
        yield p, start[p[0]] * math.prod(move[a, b] for a, b in itertools.pairwise(p)) * math.prod(emit[c, s] for c, s in zip(seq, p, strict=True))


def test_recursions_against_all_paths():
    model = small()
    seqs = [np.array(x) for x in ([0, 1, 2, 3, hmm_lm.END], [hmm_lm.END], [2, 2, 1, hmm_lm.END], [3, 0, 3, 0, 1, hmm_lm.END])]
    r = hmm_lm.Recursions(*model)
    totals = tuple(np.zeros_like(x) for x in model)
    want = [np.zeros_like(x) for x in model]
    for at, n, x in r.groups(seqs):
        log = r.likelihoods(n, x)
        assert r.expected(n, x, totals) == pytest.approx(log.sum())
        for i, got in zip(at, log, strict=True):
            whole = sum(p for _, p in paths(model, seqs[i]))
            assert got == pytest.approx(math.log(whole))
            for p, prob in paths(model, seqs[i]):
                want[0][p[0]] += prob / whole
                for a, b in itertools.pairwise(p):
                    want[1][a, b] += prob / whole
                for c, s in zip(seqs[i], p, strict=True):
                    want[2][c, s] += prob / whole
    for a, b in zip(totals, want, strict=True):
        assert np.allclose(a, b)


def test_baum_welch_climbs(spark):
    rng = np.random.default_rng(4)
    seqs = [(bytes(np.append(rng.integers(0, 9, 30) + 9 * (i % 2), hmm_lm.END).astype("<u2").tobytes()),) for i in range(60)]
    df = spark.createDataFrame([(bytearray(s[0]),) for s in seqs], "seq binary").repartition(3)
    model, logs = hmm_lm.baum_welch(df, rounds=6, states=3)
    assert all(b > a for a, b in itertools.pairwise(logs))
    assert np.allclose(model[1].sum(axis=1), 1) and np.allclose(model[2].sum(axis=0), 1)


def base(rows):
    tokens = {d: [*(t or "").encode().lower().split(), None] for d, t in rows}
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens.items()}


@pytest.mark.parametrize("head", [hmm_lm.HEAD, 50])
def test_query_base_against_a_loop(spark, head):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = (queries.op3_hmm_lm(spark, SF) if head == hmm_lm.HEAD else hmm_lm.score(docs, rounds=1, head=head)).collect()
    want = base(rows)
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4], rel=1e-9)
    if head == hmm_lm.HEAD:
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edge_rows(spark):
    rows = [(i, "the cat sat on the mat " * (1 + i % 3)) for i in range(40)] + [(100, None), (101, ""), (102, "the cat " * 20_000), (None, "no id")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    got = {r.doc_id: r for r in hmm_lm.score(df).collect()}
    want = base(rows)
    assert all((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[d][:4] and math.isfinite(r.score) and r.score < 0 for d, r in got.items()) and got.keys() == want.keys()
    assert hmm_lm.score(df.limit(0)).count() == 0
    twice = df.where("doc_id = 3").unionAll(df.where("doc_id = 3"))
    assert len({tuple(r) for r in hmm_lm.score(twice).collect()}) == 1


def test_blocks_of_times_give_what_whole_sequences_give():
    rng = np.random.default_rng(8)
    model = hmm_lm.first_guess(3)
    r = hmm_lm.Recursions(*model)
    seqs = [np.append(rng.integers(0, hmm_lm.END, n), hmm_lm.END) for n in (700, 500, 499, 30, 0)]
    ((_, n, x),) = r.groups(seqs)
    whole, cut = (tuple(np.zeros_like(t) for t in model) for _ in range(2))
    logs = r.expected(n, x, whole), r.expected(n, x, cut, cells=5 * 40)
    assert logs[0] == pytest.approx(logs[1]) == pytest.approx(r.likelihoods(n, x).sum())
    assert all(np.allclose(a, b) for a, b in zip(whole, cut, strict=True))


def test_score_against_a_loop(spark):
    """The whole model again, by plain loops: word counts, classes, Baum-Welch with its smoothing, scaled forward recursion."""
    rng = np.random.default_rng(2)
    words = ["runs", "walks", "talked", "walked", "cat", "cats", "été", "ἀρετή"]
    rows = [(d, " ".join(rng.choice(words, rng.integers(0, 9)))) for d in range(30)] + [(40, "unseen WORDS talked")]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    tokens = {d: t.encode().lower().split() for d, t in rows}
    of = hmm_lm._Classes()
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n_class, v_class = Counter(), Counter()
    for w, n in counts.items():
        n_class[of[w]] += n
        v_class[of[w]] += 1
    k, rounds = 2, 2
    start, move, emit = hmm_lm.first_guess(k)
    seqs = {d: [*(of[w] for w in ws), hmm_lm.END] for d, ws in tokens.items()}

    def forward(seq):
        rows, scales = [], []
        for t, c in enumerate(seq):
            a = [(start[s] if t == 0 else sum(rows[-1][q] * move[q, s] for q in range(k))) * emit[c, s] for s in range(k)]
            scales.append(sum(a))
            rows.append([v / scales[-1] for v in a])
        return rows, scales

    for _ in range(rounds):
        new = np.full(k, hmm_lm.SMOOTH), np.full((k, k), hmm_lm.SMOOTH), np.full((hmm_lm.CLASSES, k), hmm_lm.SMOOTH)
        for d, seq in seqs.items():
            if held[d]:
                continue
            a, scales = forward(seq)
            b = [[1.0] * k for _ in seq]
            for t in range(len(seq) - 2, -1, -1):
                b[t] = [sum(move[s, q] * emit[seq[t + 1], q] * b[t + 1][q] for q in range(k)) / scales[t + 1] for s in range(k)]
            for t, c in enumerate(seq):
                for s in range(k):
                    new[2][c, s] += a[t][s] * b[t][s]
                    if t == 0:
                        new[0][s] += a[t][s] * b[t][s]
                    for q in range(k):
                        if t + 1 < len(seq):
                            new[1][s, q] += a[t][s] * move[s, q] * emit[seq[t + 1], q] * b[t + 1][q] / scales[t + 1]
        start, move, emit = new[0] / new[0].sum(), new[1] / new[1].sum(axis=1, keepdims=True), new[2] / new[2].sum(axis=0)
    want = {d: sum(map(math.log10, forward(seqs[d])[1])) + sum(math.log10((counts[w] + 1) / (n_class[of[w]] + v_class[of[w]] + 1)) for w in ws) for d, ws in tokens.items()}
    got = hmm_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=rounds, states=k, head=3).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, rel=1e-9)
    assert of["ἀρετή".encode()] == of["ρετή".encode()] != of["ετά".encode()]

"""Alignment against loops over token lists that the libraries give."""

import hashlib
from collections import Counter
from itertools import accumulate

import duckdb
import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpusloom.llm import queries, token_alignment

SF = "/root/testdata/sf0.001"


def loops(rows):
    """The contract by loops: rows of (doc_id, text)."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs, counts = [], Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        a_ids, b_ids = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        a = [token_bytes(t, i) for i in a_ids]
        b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not text or b"".join(a) != whole or b"".join(b) != whole:
            docs.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = list(accumulate(map(len, a))), list(accumulate(map(len, b)))
        group, cuts = 0, set(ends_a) & set(ends_b)
        group_of = {0: 0}
        for e in range(1, len(whole) + 1):
            group_of[e] = group
            group += e in cuts
        groups = [([], []) for _ in range(group)]
        for side, (ids, ends) in enumerate(((a_ids, ends_a), (b_ids, ends_b))):
            for i, e in zip(ids, ends, strict=True):
                groups[group_of[e]][side].append(i)
        ending = {}
        for j, f in zip(b_ids, ends_b, strict=True):
            ending.setdefault(f, []).append(j)
        links = [(i, j) for i, e in zip(a_ids, ends_a, strict=True) for j in ending.get(e, [])]
        counts.update(links)
        docs.append((doc, a_ids, b_ids, groups, links))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for doc, a_ids, b_ids, groups, links in docs:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc, len(a_ids), len(b_ids), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


def token_bytes(t, i, known={}):  # noqa: B006
    if i not in known:
        known[i] = bytes(BYTE_OF[c] for c in t.id_to_token(i))
    return known[i]


#: The byte of each printable stand-in: bytes below 33, 127 to 160 and 173 have the characters from U+0100 on, in order.
BYTE_OF = {chr(b): b for b in range(256) if not (b < 33 or 127 <= b <= 160 or b == 173)}
BYTE_OF |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b < 33 or 127 <= b <= 160 or b == 173)}


def key(r):
    return tuple((x is not None, x) if not isinstance(x, str) else x for x in r)


def test_rows_of_every_kind(spark):
    texts = ["", None, "a", " ", "  two  spaces ", "tab\tand\nline\r\n", "É é ü ß 日本語 한국어 🙂🙃 🏳️‍🌈", "<s> </s> <unk> <|endoftext|> <0x41>", "▁under", "x\x00y", "naïve café", "1234567890 3.14", "I'll can't don't", "ｆｕｌｌ", "é", " nbsp", "a" * 3000, "word " * 2000, "﻿bom", "<0xE2>"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "again"), (3, "again"), (3, None)]
    df = spark.createDataFrame([("z", t, d, 1) for d, t in rows], "groups string, text string, doc_id long, links int").repartition(3)
    got = token_alignment.alignment_digests(df)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = loops(rows)
    assert sum(w[1] == 0 for w in want) >= 4  # what a tokenizer changes has no tokens
    assert sorted((tuple(r)[:8] for r in got.collect()), key=key) == sorted(want, key=key)
    whole = {r.doc_id: r for r in token_alignment.alignment(df.where("doc_id = 10")).collect()}
    assert hashlib.sha256(whole[10].groups.encode()).hexdigest() == next(w[-1] for w in want if w[0] == 10)
    assert token_alignment.alignment(df.limit(0)).collect() == []


def test_query_against_loops(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = queries.QUERIES["op13_token_alignment"](spark, SF)
    assert sorted(tuple(r)[:8] for r in got.collect()) == sorted(loops(rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=60), st.data())
def test_intervals(cut, data):
    """Overlaps, groups and products of any two ways to cut a line."""
    n = len(cut) + 1
    other = data.draw(st.lists(st.booleans(), min_size=n - 1, max_size=n - 1))
    a, b = ([i + 1 for i, c in enumerate(x) if c] + [n] for x in (cut, other))
    line = token_alignment.Alignment(np.array(a), np.array(b))
    spans = [[(s, e) for s, e in zip([0, *x[:-1]], x, strict=True)] for x in (a, b)]
    meet = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if max(s, u) < min(e, v)]
    assert list(zip(*map(np.ndarray.tolist, line.overlaps), strict=True)) == meet
    group = [sum(x < e for x in sorted(set(a) & set(b))) for e in range(n + 1)]
    assert list(zip(*map(np.ndarray.tolist, line.products()), strict=True)) == [(i, j) for g in range(group[-1] + 1) for i, e in enumerate(a) if group[e] == g for j, f in enumerate(b) if group[f] == g]

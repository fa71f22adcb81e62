"""Token files against the tokenizers library, and the coder's round trip."""

import json
import re
import struct
import sys
import time
import uuid
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import context_coder, queries, token_files

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 40))
def test_coder_round_trip(ids, lanes):
    assert context_coder.decode(context_coder.encode(np.array(ids, np.uint32), lanes)).tolist() == ids


def test_coder_on_other_shapes():
    rnd = np.random.RandomState(2)
    for ids in ([], [0], [(1 << 19) - 1, 0, 5], np.zeros(70_000), np.arange(5000) % 7, rnd.zipf(1.3, 60_000) % 50_000, rnd.randint(0, 50_000, 9000), rnd.randint(0, 1 << 19, 40_000), rnd.zipf(1.1, 3_000_000) % 200_000):
        ids = np.array(ids, np.uint32)
        assert (context_coder.decode(context_coder.encode(ids)) == ids).all()
    assert len(context_coder.encode(np.zeros(200_000, np.uint32), 16)) < 3000
    repeats = np.tile(rnd.randint(0, 50_000, 400), 300).astype(np.uint32)
    assert len(context_coder.encode(repeats)) < repeats.nbytes / 20  # orders 1 and 2 foresee what was seen before
    with pytest.raises(ValueError):
        context_coder.encode(np.array([1 << 19]))


def test_ends_of_intervals_are_found():
    """Every id by the first and last point of its interval, whichever ids the orders name."""
    rnd = np.random.RandomState(5)
    model = context_coder.Model(9, 400)
    for _ in range(60):
        model.predict(400)
        for i in range(9):
            low, wide = model.interval(np.full(400, i))
            for at in (low, low + wide - 1):
                assert (model.find(at[wide > 0]) == i).all()
        came = np.minimum(rnd.geometric(0.4, 400) - 1, 8)
        model.interval(came)
        model.learn(came)


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def want(rows):
    """(doc_id, start, n_tokens, crc32) for rows in the order of the files."""
    out, start = [], 0
    for (doc, _), ids in zip(rows, ids_of([t for _, t in rows]), strict=True):
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_query_against_loop(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    got = queries.QUERIES["op11_context_coder"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want(rows)


def folder(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"


def test_rows_of_every_kind(spark):
    """Nulls, empty and long texts, equal rows, one doc_id for many rows, clashing names; small blocks, so that documents span them."""
    rows = [(5, "five <|endoftext|> é 日本 \x00"), (None, "no id"), (None, None), (3, ""), (3, None), (9, "long text " * 20_000), (-4, "minus")]
    rows += [(7, "same")] * 50 + [(8, f"other {i}") for i in range(40)]
    df = spark.createDataFrame([(t, d, "x", 1, b"z") for d, t in rows], "text string, doc_id long, start string, n_tokens int, ids binary").repartition(5)
    at = folder(spark)
    got = sorted(map(tuple, token_files.stored(df, at, block_ids=1000).collect()), key=lambda r: r[1])
    ids = {r: i for r, i in zip(rows, ids_of([t for _, t in rows]), strict=True)}
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert sorted((repr(d), b) for d, _, _, b in got) == sorted((repr(d), struct.pack(f"<{len(ids[d, t])}I", *ids[d, t])) for d, t in rows)
    start = 0
    for _, s, n, b in got:
        assert (s, 4 * n) == (start, len(b))
        start += n
    assert got == sorted(map(tuple, token_files.opened(spark, at).collect()), key=lambda r: r[1])
    assert token_files.stored(df.limit(0), folder(spark)).collect() == []


def test_words_are_looked_at_once():
    tok = token_files.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a", " a", "a ", "a b a b", "a  b", "a\nb c\n d", "tab\ta b", "don't 'll  x", " lead", "<|endoftext|> a b", "日本 é é", "x\u00a0y z", "\u2003 a", "1 22 333 a1b2", ". , ! ?", "a\x1fb c", "a\x85 b", "end\n", "🙂 🙂 a🙂"] * 2
    for got, text in zip(token_files.batch_ids(tok, texts), texts, strict=True):
        assert got.tolist() == tok.file.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\tab'sé1.\u00a0\u3000\x1c"), max_size=12), max_size=6))
def test_words_of_any_white_space(texts):
    tok = token_files.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert [x.tolist() for x in token_files.batch_ids(tok, texts)] == [tok.file.encode(t, add_special_tokens=False).ids for t in texts]


def test_white_space_is_that_of_python():
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    got = pc.match_substring_regex(pa.array(every, pa.large_string()), token_files._ODD_SPACE).to_pylist()
    assert [c for c, odd in zip(every, got, strict=True) if odd] == [c for c in every if re.match(r"\s", c)]
    texts = ["a\n\u2003b", "a\x1c b", "a\u3000", "a\x0b\x0b", "a\n", "a\nb c", "\na", "", "\x00 \x00"]
    assert pc.match_substring_regex(pa.array(texts), token_files._ODD_SPACE).to_pylist() == [True] * 5 + [False] * 4


def test_words_cost_less_than_texts():
    """No look at each character for an added token, no Python string a word: at most four fifths of the time that whole texts take by encode_ordinary()."""
    tok = token_files.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert tok.encoding.special_tokens_set == tok.plain.special_tokens_set == set(tok.added)
    for text in ("a <|endoftext|> b", "<|endoftext|>"):
        assert tok.numbers(text).tolist() == tok.plain.encode_ordinary(text)
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id LIMIT 1000").fetchall()]

    def seconds(f):
        def once():
            began = time.process_time()
            f()
            return time.process_time() - began

        return min(once() for _ in range(5))

    assert seconds(lambda: token_files.batch_ids(tok, texts)) < 0.8 * seconds(lambda: [np.array(tok.plain.encode_ordinary(t), np.uint32) for t in texts])


def test_damage_is_seen_and_blocks_stand_alone(spark):
    at = folder(spark)
    token_files.stored(spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(1), at, block_ids=700).count()
    root = Path(at.removeprefix("file://"))
    listed = [x for x in json.loads((root / token_files.LIST).read_text()) if x["docs"]]
    raw = (root / listed[0]["name"]).read_bytes()
    starts, i = [], 0
    while i < len(raw):
        starts.append(i)
        _, _, a, b, _, _ = token_files.HEAD.unpack_from(raw, i)
        i += token_files.HEAD.size + a + b
    assert len(starts) > 5

    def block(raw, at):
        import io

        return token_files.read_block(io.BytesIO(raw[at:]))

    _, ids = block(raw, starts[3])
    assert len(ids) == 700
    broken = bytearray(raw)
    broken[starts[2] + token_files.HEAD.size + 40] ^= 1
    with pytest.raises(ValueError):
        block(bytes(broken), starts[2])
    assert (block(bytes(broken), starts[3])[1] == ids).all()

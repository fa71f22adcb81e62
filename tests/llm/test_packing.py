import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpusloom.llm import packing, queries

SF = "/root/testdata/sf0.001"


def whole(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for d, x in rows}


def check(pieces, ids, window=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert by_doc.keys() == ids.keys()
    for d, ps in by_doc.items():
        ps.sort(key=lambda p: p.start)
        assert [p.start for p in ps] == list(np.cumsum([0, *(p.length for p in ps)])[:-1]) and sum(p.length for p in ps) == len(ids[d])
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == list(np.cumsum([0, *(p.length for p in ps)])[:-1]) and sum(p.length for p in ps) <= window
    return by_seq


def test_query_round_trip(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = whole([(r.doc_id, r.text) for r in rows])
    seqs = check(queries.op10_bm25_packing(spark, SF).collect(), ids)
    assert len(seqs) == -(-sum(map(len, ids.values())) // 2048)


def test_edge_rows_and_tokens(spark):
    rows = [(1, None), (2, ""), (3, " \n\n  it's the dog's 1½ ²Ⅷ\t x_y __ 'ſ don't 'll   é日本語 \U0001f600 " * 3), (4, "lorem ipsum " * 30_000), (5, "'s 's's ''ve 're  \r\n \x1c\x85 a"), (None, "no id")]
    df = spark.createDataFrame([(d, t, 3, "s") for d, t in rows], "doc_id long, text string, n int, shard string")
    check(packing.pack(df, shard_tokens=9000).collect(), whole(rows))
    twice = df.where("doc_id = 3").unionAll(df.where("doc_id = 3"))
    assert sum(p.length for p in packing.pack(twice).collect()) == 2 * len(whole(rows)[3])
    assert packing.pack(df.limit(0)).count() == 0


def test_neighbours_are_ranked_by_bm25():
    idf = np.ones(20, np.float32)
    docs = [np.array(x) for x in ([5, 6, 7, 1], [5, 6, 9, 1], [5, 8, 9, 1], [3, 4, 2, 1])]
    assert list(packing.Shard(docs, idf, 4.0).neighbours(0)) == [0, 1, 2]
    order = [d for d, *_ in packing.fill([4, 4, 4, 4], packing.Shard(docs, idf, 4.0).neighbours, 12)]
    assert order == [0, 1, 2, 3]


def test_added_tokens_have_one_id(spark):
    rows = [(1, "first part <|endoftext|> second part"), (2, "<|endoftext|><|endoftext|>"), (3, "<|endoftext| >")]
    assert whole(rows)[1].tolist().count(50256) == 1
    check(packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), whole(rows))


def brute_scores(docs, seed, idf, mean):
    terms = set(docs[seed][:-1].tolist())
    out = []
    for x in docs:
        t, c = np.unique(x[:-1], return_counts=True)
        out.append(sum(float(idf[i]) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(x) / mean)) for i, n in zip(t.tolist(), c.tolist(), strict=True) if i in terms))
    return np.array(out)


def table_ids(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    docs = [np.array(x) for x in whole([tuple(r) for r in rows]).values()]
    df = np.zeros(1 << 16)
    for x in docs:
        df[np.unique(x)] += 1
    return docs, np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32), sum(map(len, docs)) / len(docs)


def test_recall_against_all_terms(spark):
    docs, idf, mean = table_ids(spark)
    shard, found, seeds = packing.Shard(docs, idf, mean), 0, [i for i in range(0, len(docs), 5) if len(docs[i]) > 50]
    for i in seeds:
        best = [d for d in np.argsort(-brute_scores(docs, i, idf, mean), kind="stable") if d != i][:10]
        found += len({*best} & {*[d for d in shard.neighbours(i) if d != i][:10]})
    assert found >= 0.99 * 10 * len(seeds)


def test_documents_of_a_topic_meet(spark):
    rng = np.random.RandomState(5)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60)] for _ in range(40)]
    rows = [(d, " ".join(rng.choice(words[d % 40], 50))) for d in range(800)] + [(800 + i, "the same words again " * 30) for i in range(300)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=256, shard_tokens=15_000).collect()
    check(pieces, whole(rows), 256)
    shard = {p.doc_id: p.sequence_id >> 32 for p in pieces}
    size = defaultdict(int)
    for p in pieces:
        size[p.sequence_id >> 32] += p.length
    assert len(size) > 8 and max(size.values()) < 3 * 15_000
    met = [shard[a] == shard[b] for t in range(40) for a in range(t, 800, 40) for b in range(a + 40, 800, 40)]
    assert np.mean(met) > 0.8


def test_copies_share_no_window_and_no_shard_is_theirs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    twice = docs.unionAll(docs)
    pieces = packing.pack(twice, shard_tokens=20_000).collect()
    rows = defaultdict(list)
    for p in pieces:
        rows[p.doc_id, p.start].append(p.sequence_id)
    both = sum(len({*s}) < len(s) for s in rows.values())
    assert both <= 0.05 * len(rows)  # where a shard of ten windows has nothing else left
    # a third of all rows is one text: its rows are dealt to several shards
    hot = docs.limit(100).unionAll(spark.range(200).selectExpr("7L as doc_id", "repeat('all the same words ', 60) as text"))
    sizes = defaultdict(int)
    for p in packing.pack(hot, shard_tokens=10_000).collect():
        sizes[p.sequence_id >> 32] += p.length * (p.doc_id == 7)
    assert sum(n > 0 for n in sizes.values()) >= 4 and max(sizes.values()) < 30_000


def test_fill_passes_over_copies():
    names = ["a", "a", "a", "b", "c", "b"]
    windows = defaultdict(list)
    for d, _, _, seq, _ in packing.fill([4] * 6, lambda d: [i for i in range(6) if names[i] == names[d]], 8, names):
        windows[seq].append(names[d])
    assert sorted(map(sorted, windows.values())) == [["a", "b"], ["a", "b"], ["a", "c"]]
    assert sum(n for _, _, n, _, _ in packing.fill([4] * 5, lambda d: range(5), 8, ["a"] * 5)) == 20


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 5, 6, 7, 8)], "doc_id long, text string, row_key int, `row` int, ids int, shard int")
    check(packing.pack(df).collect(), whole([(1, "a b c")]))


def test_texts_without_runs_of_white_space_have_the_same_ids():
    tok = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    alphabet, rng = ["a", "B", "é", "日", "1", "½", "'s", "'ll", "'", "_", "?!", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\U0001f600", "\u200b", "e\u0301"], np.random.RandomState(4)
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.randint(0, 12, 4000)]
    assert 500 < sum(packing._SPACE_RUN(t) is None for t in texts) < 3500
    assert tok.plain is not tok.encoding
    assert [tok.ids(t).tolist() for t in texts] == [tok.file.encode(t, add_special_tokens=False).ids for t in texts]

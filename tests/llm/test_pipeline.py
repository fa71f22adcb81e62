import test_near_pairs
import test_packing
import test_substring_dedup

import corpus_pipeline
from corpusloom.llm import common, langid, poisson_mix

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "poisson_mix", "bm25_packing"]
    docs = common.documents(spark, SF)
    before = [tuple(r) for r in docs.collect()]
    columns = docs.columns
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), name)
        frames.append([tuple(r) for r in docs.collect()])
        assert name == "bm25_packing" or docs.columns == columns
    identified, single, cut, mixed, packed = frames
    assert {r for r in before if langid.LETTER.search(r[1])} == {*identified}
    stay = {*test_near_pairs.brute([r[:2] for r in identified])}
    assert sorted(single) == sorted(r for r in identified if r[0] in stay)
    gone = {d: (n, sha) for d, _, n, sha in test_substring_dedup.brute([r[:2] for r in single])}
    kept = {r[0]: r for r in cut}
    for r in single:
        n, _ = gone[r[0]]
        assert (kept[r[0]] == r) if n == 0 else n == len(r[1].split()) or kept[r[0]][1] != r[1] and kept[r[0]][4] == len(kept[r[0]][1])
    times = {r.doc_id: r.copies for r in poisson_mix.replicate(spark.createDataFrame(cut, docs_schema(spark))).select("doc_id", "copies").distinct().collect()}
    assert sorted(r[0] for r in mixed) == sorted(d for d, n in times.items() for _ in range(n))
    ids = test_packing.whole([r[:2] for r in mixed])
    assert sum(r[2] for r in packed) == sum(len(ids[r[0]]) for r in mixed) and {r[0] for r in packed} == {*ids}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(packed)


def docs_schema(spark):
    return common.documents(spark, SF).schema

"""Expected outputs that the operators' definitions give, and properties."""

import struct
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import arrays, signal, text, tokenizers
from corpusloom.operators import ordered, quality, side_signals, stats, tables
from corpusloom.plans import dump
from corpusloom.plans.ordering import running_total, with_neighbours
from corpusloom.plans.pipeline import Pipeline, Transform
from corpusloom.schema import DataDir
from corpusloom.sources import archives, corpora, sound_format, text_tables
from corpusloom.streaming.loader import Loader


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("a1", "A", 0.0, 1.0), ("a2", "A", 3.0, 4.0), ("b1", "B", 0.0, 1.0), ("b2", "B", 2.0, 3.0)], {"a1": (0, 2), "a2": (2, 5), "b1": (0, 1.5), "b2": (1.5, 4)}),
        ([("a1", "A", 0.0, 2.0), ("a2", "A", 1.0, 3.0)], {"a1": (0, 2), "a2": (1, 4)}),
        ([("a1", "A", 0.0, 2.0), ("a2", "A", 5.0, 6.0), ("a3", "A", 3.0, 4.0)], {"a1": (0, 2.5), "a2": (4.5, 7), "a3": (2.5, 4.5)}),
    ],
)
def test_extended_segments(spark, rows, want):
    df = spark.createDataFrame(rows, "uttid string, reco string, start double, end double")
    assert {r.uttid: (r.start, r.end) for r in ordered.extended_segments(df, 1.0).collect()} == want


def test_filters_and_maps(spark):
    df = spark.createDataFrame([("foo", "1"), ("bar", "2")], "a string, b string")
    ids = spark.createDataFrame([("foo",)], "id string")
    assert [r.a for r in tables.keep_ids(df, ids, "a", "id").collect()] == ["foo"]
    assert [r.a for r in tables.keep_ids(df, ids, "a", "id", exclude=True).collect()] == ["bar"]
    m = F.create_map(F.lit("A"), F.lit("a1 a2"), F.lit("B"), F.lit("b"))
    assert one(spark, tables.apply_map(F.lit("A B"), m)) == "a1 a2 b"
    assert one(spark, tables.apply_map(F.lit("A C B"), m, first=2, permissive=True)) == "A C b"
    with pytest.raises(Exception, match="undefined key C"):
        one(spark, tables.apply_map(F.lit("C"), m))
    ints = F.create_map(F.lit("x"), F.lit(3), F.lit("<unk>"), F.lit(1))
    assert one(spark, tables.symbols_to_integers(F.lit("u x y"), ints, "<unk>", first=2)) == "u 3 1"
    with pytest.raises(Exception, match="undefined symbol y"):
        one(spark, tables.symbols_to_integers(F.lit("y"), ints))


@pytest.mark.parametrize("word, want", [("[LAUGHTER-STORY]", "STORY"), ("{YUPPIEDOM}", "YUPPIEDOM"), ("THEM_1", "THEM"), ("-[AN]Y", "-Y"), ("AB[SOLUTE]-", "AB-"), ("[IT'N/ISN'T]", "IT'N"), ("[LAUGHTER-[AN]Y-]", "-Y-"), ("AMMU[N]IT-", "AMMU-IT-"), ("plain", "plain")])
def test_telephone_words(spark, word, want):
    assert one(spark, text.telephone_word(F.lit(word))) == want


@pytest.mark.parametrize("line, want", [("IT *IS* %PERCENT .POINT [<door_slam] [loud_breath] ~ . <and> --DASH", "it is percent point <noise> and -dash"), ("a! :colon b:c !EXCLAMATION-POINT [x/] [/x]", "a :colon bc !exclamation-point")])
def test_news(spark, line, want):
    assert one(spark, text.news_transcript(F.lit(line))) == want


def test_other_normalisers(spark):
    assert one(spark, text.prompt_sentence(F.lit("It's 'quoted' words, ÉCOLE!"))) == "it's quoted words École"
    assert one(spark, text.telephone_line(F.lit("[SILENCE] so [laughter] <b_aside>"))) == " so <noise> "
    assert one(spark, text.evaluation_line(F.lit("utt A (%UH) B (c) <X> d"))).strip() == "utt a d"
    assert one(spark, text.conversation_line(F.lit("[laugh] so [[skip]] [pause]x"))) == "<noise> so  x"
    assert one(spark, text.conversation_line(F.lit("a (( b ))"))) is None
    m = F.create_map(*(F.lit(x) for x in ("I", "i.", "B", "b.", "M", "m.", "IBM", "i._b._m.")))
    noi = F.create_map(*(F.lit(x) for x in ("B", "b.", "BBC", "b._b._c.")))
    assert one(spark, text.acronyms(F.lit("U1 I B M and I saw BBC B"), noi, m)) == "U1 i. b. m. and i saw b._b._c. b."
    letters = F.create_map(*(F.lit(x) for x in ("I", "ay", "B", "b iy", "M", "eh m", "C", "s iy")))
    for word, phones, want in [("IBM", "ay b iy eh m", "i._b._m."), ("BBCs", "b iy b iy s iy z", "b._b._c.s"), ("BBC's", "b iy b iy s iy z", "b._b._c.'s"), ("BIM", "b ih m", None)]:
        assert one(spark, text.acronym_entry(F.lit(word), F.lit(phones), letters)) == want


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=8), st.lists(st.integers(0, 5000), max_size=8))
def test_edit_distance(spark, a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    lit = lambda v: F.array(*map(F.lit, v)).cast("array<int>")
    assert one(spark, text.edit_distance(lit(a), lit(b))) == row[-1]


def test_deltas(spark):
    x = F.array(*(F.array(F.lit(v)) for v in (1.0, 2.0, 4.0, 8.0)))
    assert [round(f[0], 6) for f in one(spark, arrays.deltas(x))] == [0.7, 1.7, 2.0, 1.6]
    assert [len(f) for f in one(spark, arrays.with_deltas(x))] == [3, 3, 3, 3]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=120), st.integers(1, 6), st.integers(2, 20))
def test_dynamic_batches(spark, lengths, size, most):
    df = spark.createDataFrame(list(enumerate(lengths)), "ord int, len int")
    got = ordered.dynamic_batches(df, ["ord"], "len", size, most, block=2 * size).orderBy("ord").collect()
    want, start, batch = [], 0, 0
    while start < len(lengths):
        fits = [i for i in range(1, min(size, len(lengths) - start) + 1) if sum(lengths[start : start + i]) <= most * size]
        n = max([1, *fits])
        want += [(batch, p) for p in range(n)]
        start, batch = start + n, batch + 1
    assert [(r.batch, r.pos) for r in got] == want


def test_chunks_by_speaker():
    assert ordered.balanced([1, 1, 1, 1], 2) == [0, 0, 1, 1]
    assert ordered.balanced([5, 1, 1, 1], 2) == [0, 1, 1, 1]
    assert ordered.balanced([1, 1, 1, 9, 1, 1], 3) == [0, 0, 0, 1, 2, 2]
    with pytest.raises(ValueError):
        ordered.balanced([3], 2)


def test_fixed_and_validated(spark):
    ids = spark.createDataFrame([("s1-a", "s1", 0), ("s1-b", "s1", 1), ("s2-a", "s2", 2), ("s2-a", "s9", 3), ("s3-a", "s3", 4)], "uttid string, speaker string, ord int")
    kv = lambda rows: spark.createDataFrame(rows, "key string, value string")
    segs = spark.createDataFrame([("s1-a", "r1", 0.0, 1.0), ("s1-b", "r1", 2.0, 1.0), ("s2-a", "r2", 0.0, -1.0), ("s3-a", "r9", 0.0, 1.0)], "uttid string, reco string, start double, end double")
    d = DataDir(ids, {"text": kv([("s1-a", "x"), ("s2-a", "y </s>"), ("s3-a", "z"), ("s4-a", "w")]), "utt2dur": kv([("s1-a", "1.5"), ("s1-b", "-1"), ("s2-a", "2"), ("s3-a", "x")]), "wav": kv([("r1", "a.wav"), ("r2", "~/b.wav"), ("r3", "c")]), "spk2gender": kv([("s1", "m"), ("s2", "q"), ("s3", "f")])}, segs)
    rules = {(r.rule, r.key) for r in quality.validated(d, order="ord").collect()}
    assert {("utt2spk: repeated key", "s2-a"), ("utt2spk: speaker is no prefix", "s2-a"), ("text: not in utt2spk", "s4-a"), ("text: missing", "s1-b"), ("text: illegal symbol", "s2-a"), ("utt2dur: not positive", "s1-b"), ("utt2dur: not positive", "s3-a"), ("spk2gender: not m or f", "s2"), ("spk2gender: missing", "s9"), ("segments: bad times", "s1-b"), ("wav: home path", "r2"), ("segments: no recording", "s3-a")} == rules
    out = quality.fixed(d)
    assert sorted(r.uttid for r in out.utt2spk.collect()) == ["s1-a", "s2-a"]
    assert sorted(r.key for r in out.tables["wav"].collect()) == ["r1", "r2"] and sorted(r.key for r in out.tables["spk2gender"].collect()) == ["s1", "s2"]
    again = quality.fixed(out)
    assert sorted(map(tuple, again.utt2spk.collect())) == sorted(map(tuple, out.utt2spk.collect()))
    backwards = spark.createDataFrame([(k, i) for i, k in enumerate("acbde")], "k string, ord int")
    assert [r.key for r in quality.out_of_order(backwards, "k", "ord", "t", block=2).collect()] == ["b"]
    spk = tables.spk2utt(ids.where("ord < 3"))
    assert quality.inverse(ids.where("ord < 3"), spk).count() == 0


def test_statistics_merge_and_invert(spark):
    rng = np.random.default_rng(1)
    rows = [(f"u{i % 3}", rng.normal(3, 2, 4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, x array<double>")
    whole = stats.cmvn_stats(df, "key")
    parts = stats.merged_stats([stats.cmvn_stats(spark.createDataFrame(rows[i::2], df.schema), "key") for i in (0, 1)])
    a, b = ({r.key: r for r in x.collect()} for x in (whole, parts))
    for k in a:
        m = np.array([x for key, x in rows if key == k])
        assert a[k]["count"] == b[k]["count"] == len(m)
        assert np.allclose(a[k]["sum"], m.sum(0)) and np.allclose(b[k]["sum_squares"], (m * m).sum(0))
    back = stats.from_matrix(stats.as_matrix(whole))
    assert {r.key: r for r in back.select(*whole.columns).collect()} == a
    out = stats.apply_cmvn(stats.apply_cmvn(df, whole, "key", variances=True), whole, "key", variances=True, reverse=True)
    assert np.allclose(np.sort(np.array([r.x for r in out.collect()]), axis=0), np.sort(np.array([x for _, x in rows]), axis=0))


def test_index_and_tables(spark, tmp_path):
    (tmp_path / "feats").write_text("u1 a.ark:12\nu2  b.ark:7 \n\nu3 a.ark\n")
    rows = {r.uttid: (r.path, r["loc"]) for r in text_tables.read_index(spark, str(tmp_path / "feats")).collect()}
    assert rows == {"u1": ("a.ark", "12"), "u2": ("b.ark", "7"), "u3": ("a.ark", None)}
    with pytest.raises(Exception, match="no location"):
        one(spark, text_tables.index_entry(F.lit("a.ark:")))
    (tmp_path / "tokens").write_text("<blank>\n<unk>\na\n")
    assert [(r.token, r.id) for r in text_tables.read_symbols(spark, str(tmp_path / "tokens")).orderBy("id").collect()] == [("<blank>", 0), ("<unk>", 1), ("a", 2)]
    (tmp_path / "registry").write_text("b/y a/x\na/x a/x c/z\n")
    reg = text_tables.read_registry(spark, str(tmp_path / "registry"))
    assert tables.registered(reg, ["c/z", "a/x"]).first().combo_idx == 2 and tables.registered(reg, ["q/q"]).first() is None
    assert tables.register(reg, ["q/q"]).count() == 3 and tables.register(reg, ["a/x", "b/y"]).count() == 2
    kv = spark.createDataFrame([("u2", "b c"), ("u1", ""), ("u3", "x")], "key string, value string")
    text_tables.write_keyed(kv, str(tmp_path / "out"))
    assert sorted(map(tuple, text_tables.read_keyed(spark, str(tmp_path / "out")).collect())) == [("u1", ""), ("u2", "b c"), ("u3", "x")]


def test_consolidation(spark):
    t = lambda rows, c: spark.createDataFrame(rows, f"uttid string, {c} string, ord int")
    index, words = t([("a", "p", 0), ("b", "q", 1), ("a", "r", 2)], "path"), t([("a", "x", 0), ("c", "y", 1)], "text")
    assert [(r.uttid, r.path, r.text) for r in tables.consolidated(index, words).collect()] == [("a", "r", "x")]
    with pytest.raises(Exception, match="not in all tables"):
        tables.consolidated(index, words, permissive=False).collect()


def test_speed_perturbed_directory(spark):
    ids = spark.createDataFrame([("u", "s")], "uttid string, speaker string")
    wav = spark.createDataFrame([("r1", "cat x.wav |"), ("r2", "a.ark:44"), ("r3", "y.wav")], "key string, value string")
    segs = spark.createDataFrame([("u", "r1", 0.9, 1.8), ("v", "r1", 1.0, 1.005)], "uttid string, reco string, start double, end double")
    d = tables.speed_perturbed(DataDir(ids, {"wav": wav}, segs), 0.9)
    assert [tuple(r) for r in d.segments.collect()] == [("sp0.9-u", "sp0.9-r1", 1.0, 2.0)]
    assert {r.key: r.value for r in d.tables["wav"].collect()} == {"sp0.9-r1": "cat x.wav | sox -t wav - -t wav - speed 0.9 |", "sp0.9-r2": "wav-copy a.ark:44 - | sox -t wav - -t wav - speed 0.9 |", "sp0.9-r3": "sox -t wav y.wav -t wav - speed 0.9 |"}
    assert [tuple(r) for r in d.tables["utt2uniq"].collect()] == [("sp0.9-u", "u")]


def test_corpus_formats(spark):
    lines = lambda rows: spark.createDataFrame([(r,) for r in rows], "value string")
    calls = spark.createDataFrame([("fe_03_00001", "1.5 2.25 A: hi [laugh]"), ("fe_03_00001", "# fe_03_00001.sph")], "call string, value string")
    assert [tuple(r) for r in corpora.conversation_rows(calls).collect()] == [("{fisher}00001-A-000150-000225", "{fisher}00001-A", "A", 1.5, 2.25, "hi <noise>")]
    stm = corpora.reference_segments(lines([";; x", "en_4156 A en_4156_A 357.64 359.64 <O,en,F,en-F>  HE IS"])).first()
    assert (stm.reco, stm.speaker, stm.text) == ("en_4156-A", "en_4156_A", "HE IS")
    assert [tuple(r) for r in corpora.call_sides(lines(["sw2001A-ms98-a-0001 0.00 1.505 hi [noise] there"])).select("uttid", "text").collect()] == [("{swbd}02001-A-000000-000151", "hi <noise> there")]
    disks = spark.createDataFrame([("13-16.1", "/d1")], "disk string, root string")
    assert [tuple(r) for r in corpora.news_files(lines(["; c", "13_16_1: wsj1/4k0c0301.wv1"]), disks).collect()] == [("4k0c0301", "/d1/wsj1/4k0c0301.wv1")]
    assert [tuple(r) for r in corpora.news_transcripts(lines(["HI *THERE* (4k0c0301)"])).collect()] == [("{wsj}4k0c0301", "hi there")]
    assert sorted(r.text for r in corpora.language_text(lines(["<S> a", "B c"]), "value").collect()) == ["b c"]
    assert ("yes", "y eh s") in {tuple(r) for r in corpora.lexicon(lines(["# c", "", "YES y eh s"])).collect()}


def test_archives(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "a.ark").write_bytes(archives.matrix_archive([("u1", m), ("u2", m + 1)]))
    got = {r.uttid: r for r in archives.read_matrices(spark, str(tmp_path / "a.ark")).collect()}
    assert got["u1"].rate is None and got["u2"].rate == 1.0 and np.allclose(got["u2"].x, (m + 1)[1:])
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(struct.pack("<8h", *range(8)))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    rows = {r.path.rsplit("/", 1)[1]: r for r in archives.read_waves(spark, str(tmp_path / "*.wav")).collect()}
    assert rows["s.wav"].x == [[0, 1], [2, 3], [4, 5], [6, 7]] and rows["s.wav"].rate == 8000 and rows["bad.wav"].x is None and rows["bad.wav"].error is not None
    df = spark.createDataFrame([("d", s, f"u{i}", [[0.0]] * (i + 1), 1.0) for i, s in enumerate(["tr", "tr", "tr", "dev"])], "dataset string, split string, uttid string, x array<array<double>>, rate double")
    index = archives.write_archive(df, str(tmp_path / "out"), ["uttid"], hours=4 / 3600)
    assert {r.uttid: r.path.rsplit("/", 1)[1] for r in index.collect()} == {"u0": "archive=feats.0.1", "u1": "archive=feats.0.1", "u2": "archive=feats.0.2", "u3": "archive=feats.0.3"}
    assert all((tmp_path / "out" / r.path.split("/out/")[1]).is_dir() for r in index.collect())
    two = spark.createDataFrame([("u1", "p", 1), ("u1", "q", 2)], "uttid string, path string, x int")
    assert [r.x for r in archives.looked_up(spark.createDataFrame([("a", "q", "u1")], "uttid string, path string, loc string"), two).collect()] == [2]
    assert sorted(r.uttid for r in archives.datasets(spark, str(tmp_path / "out"), ["d/tr"]).collect()) == ["u0", "u1", "u2"]
    for bad in ("d", "d/none", "d/orig"):
        with pytest.raises(ValueError):
            archives.datasets(spark, str(tmp_path / "out"), bad)


def test_signal_kernels():
    rng = np.random.default_rng(2)
    rate, tone = 16000.0, np.sin(2 * np.pi * 200 * np.arange(16000) / 16000) * 1000
    f = signal.fbank(tone, rate, 40)
    assert f.shape == (98, 40) and f.mean(0).argmax() == np.abs(np.linspace(signal.mel(20), signal.mel(8000), 42)[1:-1] - signal.mel(200)).argmin()
    w = signal.mel_weights(40, 512, rate)
    assert w.shape == (40, 256) and (w >= 0).all() and w.max() <= 1
    assert signal.log_spectrogram(tone, rate).shape == (98, 257)
    assert np.allclose(np.median(signal.pitch(tone, rate)[:, 0]), 1.0, atol=0.05)
    with pytest.raises(RuntimeError):
        signal.fbank(tone[:100], rate)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    assert signal.time_warp(x, "u", 40).shape == x.shape and (signal.time_warp(x[:80], "u", 40) == x[:80]).all()
    assert np.allclose(signal.cubic_rows(x, 300), x) and np.allclose(signal.cubic_rows(np.ones((50, 3)), 20), 1)
    down = signal.resample(tone, 16000, 8000)
    assert len(down) == 8000 and np.allclose(down[200:-200], np.sin(2 * np.pi * 200 * np.arange(8000) / 8000)[200:-200] * 1000, atol=20)
    for ratio in (0.9, 1.1):
        assert len(signal.speed(tone, "u", ratio=ratio)) == len(tone)
    noise = rng.normal(size=50)
    y = signal.noisy(tone, "u", noise) - tone
    db = 20 * np.log10(np.sqrt((y * y).mean()) / np.sqrt((tone * tone).mean()))
    assert -20.5 <= db <= -4.5
    assert np.allclose(signal.reverberant(tone, np.array([0.0, 1.0, 0.0])), tone)
    assert signal.reverberant(tone, np.ones((2, 3))).shape == (16000, 2)


class Doubled(Transform):
    def apply(self, df, row):
        return df.withColumn("x", F.transform("x", lambda v: v * 2))


def test_pipeline(spark):
    conf = [{"type": "fbank", "sample_frequency": 16000, "num_mel_bins": 4}, {"type": "cmvn", "norm_vars": True}, {"type": "spec_augment"}]
    p = Pipeline(conf)
    assert p.length_ratio() == 100 / 16000 and not p.is_null() and len(Pipeline(conf, "fbank").steps) == 2 and Pipeline([{"type": "identity"}]).is_null()
    with pytest.raises(TypeError, match="num_mel_bins"):
        Pipeline([{"type": "fbank", "sample_frequency": 1.0}])
    with pytest.raises(ValueError):
        Pipeline([{"type": "nothing"}])
    df = spark.createDataFrame([("u", [float(i % 7) for i in range(1600)], 16000.0)], "uttid string, x array<double>, rate double")
    out = np.array(p.apply(df).first().x)
    assert out.shape == (8, 4) and np.allclose(out.mean(0), 0, atol=1e-6)
    assert Pipeline([{"type": "test_golden:Doubled"}]).apply(df).first().x[:3] == [0.0, 2.0, 4.0]
    with pytest.raises(Exception, match="the rate must be 16000"):
        p.apply(df.withColumn("rate", F.lit(8000.0))).collect()
    loud = Pipeline([{"type": "volume_perturbation"}]).apply(df, train=True).first().x
    assert loud[1] == pytest.approx(loud[2] / 2) and Pipeline([{"type": "volume_perturbation"}]).apply(df).first().x[1] == 1.0


def test_loader(spark):
    rows = [(f"u{i:03}", f"a{i % 4}", float(1 + i % 9), i) for i in range(50)]
    index = spark.createDataFrame(rows, "uttid string, archive string, length double, ord long")
    payload = spark.createDataFrame([(r[0], [r[2]], 16000.0) for r in rows], "uttid string, x array<double>, rate double")
    loaders = [Loader(index, payload, batch_size=4, max_len=5, shuffle=True, num_replicas=3, rank=k) for k in range(3)]
    batches = [list(x) for x in loaders]
    assert len({len(b) for b in batches}) == 1 and len(loaders[0]) == len(batches[0])
    seen = [u.uttid for b in batches for items in b for u in items]
    assert {*seen} == {r[0] for r in rows}
    assert all(len(items) <= 4 and (len(items) == 1 or sum(u.x[0] for u in items) <= 20) for b in batches for items in b)
    with Loader(index, payload, batch_size=25) as l:
        first = [[u.uttid for u in l.next()] for _ in range(2)]
        assert first == [[r[0] for r in rows[:25]], [r[0] for r in rows[25:]]]
        l.next()
        assert l.epoch == 1
    with pytest.raises(ValueError):
        Loader(index, payload, num_replicas=2, rank=2)


def test_dump_skips_what_fails(spark):
    rows = [("u1", [float(i % 9) for i in range(3200)], 16000.0), ("u2", [0.0] * 10, 16000.0), ("u3", [float(i % 9) for i in range(1600)], 8000.0)]
    df = spark.createDataFrame(rows, "uttid string, x array<double>, rate double")
    done, failed = dump.dumped(df, Pipeline([{"type": "fbank", "sample_frequency": 16000, "num_mel_bins": 4}]), 16000.0)
    assert {r.uttid: (len(r.x), r.rate) for r in done.collect()} == {"u1": (18, 100.0), "u3": (18, 100.0)}
    assert [(r.uttid, "no frame" in r.error) for r in failed.collect()] == [("u2", True)]


def test_subword_tokens(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the cat sat", "", "naïve"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    t = tokenizers.Subwords(path)
    assert [r.x for r in df.select(t.ids(F.col("text")).alias("x")).collect()] == [model.encode(x) for x in texts]
    assert [r.x for r in df.select(t.text(t.ids(F.col("text"))).alias("x")).collect()] == texts
    listed = tokenizers.Subwords(path, ["<blank>", "<unk>", "\u2581the", "\u2581cat", "<sos/eos>"])
    assert [r.x for r in df.select(listed.ids(F.col("text")).alias("x")).collect()][0] == [2, 3, 1] and len(listed) == 5
    assert df.select(listed.text(F.expr("array(2L, 3L)")).alias("x")).first().x == "the cat"


def test_legacy_epoch_order_is_numpys(spark):
    rows = [(f"u{i:03}", f"a{i * i % 4}", i) for i in range(90)]
    lists = {}
    for u, a, _ in rows:
        lists.setdefault(a, []).append(u)
    rng = np.random.RandomState(5)
    names = list(lists)
    turn = rng.permutation(len(names))
    drawn = [[u[k] for k in rng.permutation(len(u))] for u in lists.values()]
    want = [u for i in turn for u in drawn[i]]
    df = spark.createDataFrame(rows, "uttid string, archive string, ord long")
    assert [r.uttid for r in ordered.legacy_epoch_order(df, 5).orderBy("pos").collect()] == want


def test_ids_beyond_the_characters_are_an_error(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 3]), ([60_000], [1])], "a array<int>, b array<int>")
    assert df.where("size(a) = 3").select(text.edit_distance(F.col("a"), F.col("b"))).first()[0] == 1
    with pytest.raises(Exception, match="under 55000"):
        df.select(text.edit_distance(F.col("a"), F.col("b"))).collect()


def test_neighbours_in_blocks(spark):
    """Blocks of ten rows give what one window gives: deltas, segments and speakers' subsets, with one key that has most rows."""
    rows = [("hot" if i % 10 else f"k{i // 30}", i, [float(i * i % 17), float(i % 5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, t int, x array<double>")
    whole = {(r.key, r.t, r.i): (r.v, r.delta) for r in stats.delta_rows(df, window=3, block=100_000).collect()}
    for key in {k for k, _, _ in rows}:
        x = [v for k, _, v in rows if k == key]
        for at, t in enumerate(t for k, t, _ in rows if k == key):
            for i in range(2):
                up = sum(k * (x[min(at + k, len(x) - 1)][i] - x[max(at - k, 0)][i]) for k in (1, 2, 3)) / 28
                assert whole[key, t, i] == (x[at][i], pytest.approx(up))
    assert {(r.key, r.t, r.i): (r.v, r.delta) for r in stats.delta_rows(df, window=3, block=10).collect()} == whole
    segs = spark.createDataFrame([(f"u{i:03d}", "hot" if i % 7 else f"r{i}", i * 1.5 % 400, i * 1.5 % 400 + 1 + i % 3 / 2, i) for i in range(200)], "uttid string, reco string, start double, end double, _block_of int")
    wide, narrow = (sorted(map(tuple, ordered.extended_segments(segs, 1.0, block=b).collect())) for b in (100_000, 10))
    assert wide == narrow and len(wide) == 200
    blocks = with_neighbours(df, ["key", "t"], 2, 10).groupBy("_block").count().collect()
    assert max(r["count"] for r in blocks) <= 14  # a task's rows are bounded whatever a key has
    utts = spark.createDataFrame([(f"u{i:04d}", "a" if i % 9 else f"s{i}") for i in range(500)], "uttid string, speaker string")
    got = sorted(r.uttid for r in ordered.per_speaker(utts, 5).where("speaker = 'a'").collect())
    mine = [f"u{i:04d}" for i in range(500) if i % 9]
    assert got == [mine[i * (len(mine) // 5)] for i in range(5)]


def test_speakers_are_split_as_in_one_list(spark):
    """The driver that asks for running totals near the edges ends where one that has all counts does."""
    import random

    rnd = random.Random(3)
    for n, speakers, around in ((2, 40, 1), (5, 60, 2), (7, 7, 50)):
        counts = [rnd.choice([1, 1, 2, 9, 30]) for _ in range(speakers)]
        df = spark.createDataFrame([(f"s{s:03d}-{u:03d}", f"s{s:03d}") for s, c in enumerate(counts) for u in range(c)], "uttid string, speaker string")
        got = {r.speaker: r.chunk for r in ordered.speaker_chunks(df, ["uttid"], n, around=around).collect()}
        assert [got[f"s{s:03d}"] for s in range(speakers)] == ordered.balanced(counts, n)
    with pytest.raises(ValueError):
        ordered.speaker_chunks(df, ["uttid"], 8)


def test_running_total(spark):
    df = spark.createDataFrame([(i + 1, i % 7) for i in range(100)], "rn int, v int")
    got = {r.rn: r.total for r in running_total(df, "rn", "v", "total", block=9).collect()}
    assert got == {i + 1: sum(j % 7 for j in range(i + 1)) for i in range(100)}


def test_noises_of_a_store(spark, tmp_path):
    store = side_signals.write_store(spark.createDataFrame([("a", [1.0, 2.0], 8000.0), ("b", [3.0], 8000.0), ("u1", [4.0], 8000.0)], "key string, x array<double>, rate double"), str(tmp_path / "store"))
    utts = spark.createDataFrame([(f"u{i}",) for i in range(60)], "uttid string")
    sources = side_signals.assigned(utts, store, 1)
    got = {r.uttid: r.source for r in sources.collect()}
    assert got["u1"] == "u1" and set(got.values()) == {"a", "b", "u1"} and len(got) == 60
    assert got == {r.uttid: r.source for r in side_signals.assigned(utts.repartition(3), store, 1).collect()}
    assert got != {r.uttid: r.source for r in side_signals.assigned(utts, store, 2).collect()}
    held = {r.key: list(r.x) for r in store.collect()}
    side_signals.PER_COPY, old = 7, side_signals.PER_COPY  # so that a noise has several copies
    try:
        for limit in (0, 1000):
            assert {r.uttid: list(r.noise) for r in side_signals.with_side_signal(utts, store, sources, broadcast_numbers=limit).collect()} == {u: held[s] for u, s in got.items()}
    finally:
        side_signals.PER_COPY = old
    assert {r.source for r in side_signals.assigned(utts, store.limit(0), 1).collect()} == {None}
    (tmp_path / "n.wav").write_bytes(sound_format.wave_bytes(np.array([[5, 6], [7, 8]]), 8000))
    files = spark.createDataFrame([("n", str(tmp_path / "n.wav"))], "key string, path string")
    assert [(r.key, r.x, r.rate) for r in side_signals.listed_store(spark, files, str(tmp_path / "*.wav")).collect()] == [("n", [5.0, 7.0], 8000.0)]
    with pytest.raises(Exception, match="not there"):
        side_signals.listed_store(spark, files.withColumn("path", F.lit("/nowhere.wav")), str(tmp_path / "*.wav")).collect()


def test_rules_of_files_and_directories(spark, tmp_path):
    for name, raw in {"good": b"a b\nc\n", "cut": b"a\nb", "broken": b"a\xe9 b\nc\xc2\xa0\n", "spaced": "a b\nc\rd\ne\n".encode(), "empty": b"", "both": b"\xff"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {(r.rule, r.key.rsplit("/", 1)[1], r.detail) for r in quality.file_faults(spark, str(tmp_path)).collect()}
    assert got == {("file: no final newline", "cut", "1"), ("file: no final newline", "both", "1"), ("file: not UTF-8", "broken", "1"), ("file: not UTF-8", "both", "1"), ("file: illegal white space", "spaced", "2")}
    kv = lambda rows: spark.createDataFrame(rows, "key string, value string")
    ids = spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "r")], "uttid string, speaker string")
    # without ord the first row is the least one, however the rows are spread
    for parts in (1, 5):
        assert sorted(map(tuple, quality.fixed(DataDir(ids.repartition(parts))).utt2spk.collect())) == [("a", "s"), ("b", "r")]
    shifted = DataDir(ids, {"feats": kv([("a", "x")])}, frame_shift=0.01)
    assert tables.combined([shifted, shifted, DataDir(ids)]).frame_shift == 0.01
    with pytest.raises(ValueError, match="frame shifts"):
        tables.combined([shifted, shifted.replace(frame_shift=0.02)])
    assert one(spark, text.evaluation_line(F.lit("(%HESITATION) Yes no"))) == "yes no"
    assert one(spark, text.evaluation_line(F.lit("<B_ASIDE> Yes (no)"))) == "yes no"
    assert one(spark, text.evaluation_line(F.lit("<X> a (%uh) b (%ah)"))) == "a"
    lines = spark.createDataFrame([("YES Y EH S",)], "value string")
    letters = spark.createDataFrame([("W D AH B AX L Y UW",)], "value string")
    got = {tuple(r) for r in corpora.lexicon(lines, letters=letters).collect()}
    assert got == {("yes", "y eh s"), ("w.", "d ah b ax l y uw"), ("i", "ay"), ("!sil", "sil"), ("<noise>", "nsn"), ("<unk>", "spn")}

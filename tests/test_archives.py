"""Formats of matrices and sounds, and the archive source."""

import io
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.sources import archive_source, archives, matrix_format, sound_format

RND = np.random.RandomState(4)


def one(raw):
    ((key, at, value),) = matrix_format.entries(io.BytesIO(raw))
    return key, at, value


@pytest.mark.parametrize("shape", [(20, 5), (3, 4), (1, 1), (0, 0), (200, 40), (7,), (0,)])
def test_plain_values(shape):
    x = RND.randn(*shape).astype(np.float32)
    raw, at = matrix_format.entry_bytes("key", x)
    assert one(raw)[:2] == ("key", at) and (one(raw)[2] == x).all() and one(raw)[2].shape == x.shape


def test_other_kinds_of_values():
    raw = b"d \0BDM " + struct.pack("<bibi", 4, 1, 4, 2) + struct.pack("<2d", 0.1, 0.2) + b"v \0BDV " + struct.pack("<bi", 4, 1) + struct.pack("<d", 3.5)
    raw += b"t  [\n  1 2 3\n  4 5 6 ]\nw  [ 1.5 2 ]\ne  [ ]\n"
    got = {k: v.tolist() for k, _, v in matrix_format.entries(io.BytesIO(raw))}
    assert got == {"d": [[0.1, 0.2]], "v": [3.5], "t": [[1, 2, 3], [4, 5, 6]], "w": [1.5, 2], "e": []}
    for bad in (b"k", b"k \0BFM \4\1\0\0\0\4\1\0\0\0", b"k \0BXX ", b"k word"):
        with pytest.raises(ValueError):
            list(matrix_format.entries(io.BytesIO(bad)))
    with pytest.raises(ValueError):
        matrix_format.entry_bytes("two words", np.zeros((1, 1)))


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 4, 5, 8, 9, 500])
def test_compressed_in_quantiles(rows):
    """Each value is within half a level of its column, whose levels lie between the quartiles."""
    x = (RND.randn(rows, 6) * [1, 10, 100, 0, 3, 1e-3]).astype(np.float32)
    raw, _ = matrix_format.entry_bytes("k", x, 2)
    got = one(raw)[2]
    assert got.shape == x.shape and len(raw) == 2 + 2 + 3 + 16 + 6 * 8 + x.size
    if rows < 5:
        return
    step = (x.max() - x.min()) / 65535
    for c in range(6):
        edges = np.percentile(x[:, c], [0, 25, 50, 75, 100])
        assert np.abs(got[:, c] - x[:, c]).max() <= (edges[-1] - edges[0]) / 63 / 2 + 4 * step


@pytest.mark.parametrize("method,low,width,levels", [(3, None, None, 65535), (4, -32768, 65535, 65535), (5, None, None, 255), (6, 0, 255, 255), (7, 0, 1, 255)])
def test_compressed_evenly(method, low, width, levels):
    x = (RND.rand(30, 7) * (width or 5) + (low or 0)).astype(np.float32)
    got = one(matrix_format.entry_bytes("k", x, method)[0])[2]
    assert np.abs(got - x).max() <= (width or x.max() - x.min()) / levels / 2 * 1.001 + 1e-6
    assert (one(matrix_format.entry_bytes("k", np.full((3, 3), 2.0), method)[0])[2] == pytest.approx(min(2.0, (width or 9) + (low or 0)), abs=5e-3)) or method in (5, 6, 7)
    assert one(matrix_format.entry_bytes("k", x[:8], 1)[0])[2].shape == (8, 7)


#: The first example of the format's public specification: one sample of two channels.
EXAMPLE = bytes.fromhex("664c6143800000221000100000000f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0ffff869180000bf0358fd03128baa9a")


def test_flac_of_the_specification():
    assert [x.tolist() for x in sound_format.decode(EXAMPLE)[1:]] == [[[25588, 10416]]]
    for i in range(42, len(EXAMPLE)):
        broken = bytearray(EXAMPLE)
        broken[i] ^= 4
        with pytest.raises((ValueError, IndexError, KeyError)):
            sound_format.decode(bytes(broken))


def signals():
    t = np.arange(20_000)
    yield "tone", 8000 * np.sin(t / 20) + RND.randn(len(t)) * 50
    yield "noise", RND.randint(-32768, 32768, 9000)
    yield "silence", np.zeros(5000)
    yield "one value", np.full(4097, -7)
    yield "ramp", t % 5
    yield "walk", np.cumsum(RND.randn(10_000) * 30)
    yield "extremes", np.concatenate([np.zeros(4096), [32767, -32768] * 2048])
    yield "rare", np.where(t % 3000 == 2999, 30_000, 0)
    yield "short", [1, 2]
    yield "empty", []


@pytest.mark.parametrize("name,x", list(signals()), ids=[n for n, _ in signals()])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_sounds_come_back(name, x, channels):
    x = np.clip(np.rint(np.asarray(x, float)), -32768, 32767).astype(np.int16)
    x = np.stack([x, x // 2, -(x // 3)][:channels], axis=1)
    for write in (sound_format.flac_bytes, sound_format.wave_bytes):
        rate, got = sound_format.decode(write(x, 16_000))
        assert rate == 16_000 and got.shape == x.shape and (got == x).all()
    if name == "tone":
        assert len(sound_format.flac_bytes(x, 16_000)) < 0.7 * x.nbytes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-32768, 32767), max_size=300), st.integers(1, 48_000))
def test_any_sound_comes_back(x, rate):
    got = sound_format.decode(sound_format.flac_bytes(np.array(x, np.int16), rate))
    assert got[0] == rate and got[1][:, 0].tolist() == x


def test_other_widths_of_sound():
    def wav(kind, bits, body, channels=1):
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, kind, channels, 8000, 0, 0, bits, b"data", len(body)) + body

    def samples(raw):
        return sound_format.decode(raw)[1][:, 0].tolist()

    assert samples(wav(1, 8, bytes([0, 128, 255]))) == [-32768, 0, 32512]
    assert samples(wav(1, 24, b"\x00\x01\x80\xff\xff\x7f\xff\xff\xff")) == [-32767, 32767, -1]
    assert samples(wav(1, 32, struct.pack("<2i", 1 << 30, -65536))) == [1 << 14, -1]
    assert samples(wav(3, 32, struct.pack("<3f", 2.4, -7.6, 1e9))) == [2, -8, 32767]
    assert samples(wav(7, 8, bytes([0x00, 0x80, 0xFF, 0x7F]))) == [-32124, 32124, 0, 0]
    assert samples(wav(6, 8, bytes([0xD5, 0x55, 0x2A, 0xAA]))) == [8, -8, -32256, 32256]
    head = b"NIST_1A\n   1024\nsample_count -i 2\nchannel_count -i 2\nsample_rate -i 16000\nsample_n_bytes -i 2\nsample_byte_format -s2 10\nsample_coding -s3 pcm\nend_head\n"
    rate, x = sound_format.decode(head.ljust(1024) + struct.pack(">4h", 1, -2, 3, -4))
    assert rate == 16_000 and x.tolist() == [[1, -2], [3, -4]]
    assert samples(head.replace(b"-s3 pcm", b"-s4 ulaw").replace(b"channel_count -i 2", b"channel_count -i 1").ljust(1024) + b"\x00\x80") == [-32124, 32124]
    for bad in (b"what", head.replace(b"-s3 pcm", b"-s26 pcm,embedded-shorten-v2.00").ljust(1024), wav(2, 4, b"")):
        with pytest.raises(ValueError):
            sound_format.decode(bad)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """200 matrices in four archives, and what they hold."""
    path = tmp_path_factory.mktemp("archive")
    rows = [(f"u{i:03d}", RND.randn(i % 7 + 1, 3).astype(np.float32).tolist(), None if i % 5 == 0 else 100.0) for i in range(200)]
    df = spark.createDataFrame(rows, "uttid string, x array<array<float>>, rate double").repartition(4)
    archives.write_indexed(df, str(path))
    return path, {u: (x, r) for u, x, r in rows}


def held(df):
    return {r.uttid: ([list(f) for f in r.x], r.rate) for r in df.collect()}


def test_read_by_index_and_whole(spark, written):
    path, want = written
    assert held(archives.by_specifier(spark, f"scp:{path}")) == want
    assert held(archives.by_specifier(spark, f"scp:{path}", index_bytes=100)) == want  # every line in one stretch alone
    assert held(archives.by_specifier(spark, f"ark:{path}")) == want
    assert held(archives.read_matrices(spark, f"{path}/*.ark")) == want
    one_index = sorted(path.glob("*.scp"))[0]
    some = held(archives.by_specifier(spark, f"scp:{one_index}"))
    assert some and set(some) == {line.split()[0] for line in one_index.read_text().splitlines()}
    places = {r.uttid: (r.path, int(r.loc)) for r in archives.by_specifier(spark, f"scp:{one_index}").collect()}
    for uttid, (file, at) in places.items():
        with open(file, "rb") as f:
            f.seek(at)
            assert matrix_format.read_value(f)[1:].tolist() == want[uttid][0]


def test_only_what_is_named_is_read(spark, written, tmp_path):
    """A filter reaches the reader: lines whose archive is not there do no harm unless they are asked for."""
    path, want = written
    lines = [x for f in sorted(path.glob("*.scp")) for x in f.read_text().splitlines()]
    (tmp_path / "all.scp").write_text("\n".join([f"gone{i} {tmp_path}/none.ark:5" for i in range(50)] + [f"{x.split()[0]} {path}/{x.split()[1]}" for x in lines]))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = archives.by_specifier(spark, f"scp:{tmp_path}/all.scp")
        assert held(df.where("uttid = 'u007'")) == {"u007": want["u007"]}
        assert set(held(df.where("uttid IN ('u001', 'u150') AND rate IS NOT NULL"))) == {"u001"}
        assert len(held(df.where(f"path <> '{tmp_path}/none.ark' AND uttid IN ('u001', 'u002')"))) == 2
        with pytest.raises(Exception, match="none.ark"):
            df.where("uttid = 'gone3'").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_specifiers():
    assert archive_source.dispatched("scp:/a/b.scp", {"shuffle": "true"}) == ("scp", "/a/b.scp")
    assert archive_source.dispatched("ark:file:///a", {"shuffle": "false"}) == ("ark", "file:///a")
    for bad, options in (("/a/b", {}), ("mat:/a", {}), ("scp:", {}), ("ark:-", {}), ("ark:/a", {"shuffle": "true"}), ("ark:/a", {"max_len": "300"}), ("ark:/a", {"prefetch": "true"}), ("ark:/a", {"filetype": "sound"})):
        with pytest.raises(ValueError):
            archive_source.dispatched(bad, options)


def test_sound_archives(spark, tmp_path):
    rows = [(f"a/{i} b".replace(" ", ""), RND.randint(-3000, 3000, (50 + i, 2)).tolist(), 8000.0) for i in range(12)]
    df = spark.createDataFrame(rows, "uttid string, x array<array<int>>, rate double")
    for kind in ("flac", "wav"):
        got = archives.write_indexed(df, str(tmp_path / kind), filetype="sound", pcm_format=kind)
        assert {u: ([list(map(int, f)) for f in x], r) for u, (x, r) in held(got).items()} == {u: (x, r) for u, x, r in rows}
        assert len(list((tmp_path / kind).glob(f"*.{kind}"))) == 12
    empty = archives.write_indexed(df.limit(0), str(tmp_path / "empty"))
    assert empty.collect() == [] and empty.columns == ["uttid", "path", "loc", "x", "rate"]
    with pytest.raises(Exception, match="mp3"):
        archives.write_indexed(df, str(tmp_path / "x"), filetype="sound", pcm_format="mp3")


def test_short_frames_as_long_ones():
    """Few samples are coded to the same bytes by plain integers as by arrays, and read alike; cut files are errors."""
    for n in range(1, sound_format.SHORT):
        for low, high in ((-32768, 32768), (-3, 3), (5, 6)):
            x = np.stack([RND.randint(low, high, n), np.cumsum(RND.randint(-9, 9, n))], axis=1).astype(np.int64)
            raw = sound_format.flac_bytes(x, 8000)
            assignment, coded = sound_format._long_channels(x)
            assert (assignment, coded) == sound_format._short_channels(x)
            assert (sound_format.flac_samples(raw)[1] == x).all()
            bits = sound_format._Bits(coded)
            widths = [16 + (i == {8: 1, 9: 0, 10: 1}.get(assignment)) for i in range(2)]
            wanted = [sound_format._subframe(bits, n, w)["x"].tolist() for w in widths]
            at, got = sound_format._short_subframes(coded, n, widths)
            assert [s["x"].tolist() for s in got] == wanted and at == bits.at
            with pytest.raises(ValueError):
                sound_format._short_subframes(coded[:-1], n, widths)


def test_sounds_within_archives(spark, tmp_path, monkeypatch):
    """The files do not grow with the sounds; read by index and without."""
    rows = [(f"a/{i}", RND.randint(-3000, 3000, (i % 40, 2)).tolist(), 8000.0) for i in range(300)]
    df = spark.createDataFrame(rows, "uttid string, x array<array<int>>, rate double").repartition(3)
    for kind in ("flac", "wav"):
        path = tmp_path / kind
        got = archives.write_indexed(df, str(path), filetype="sounds", pcm_format=kind)
        whole = archives.by_specifier(spark, f"ark:{path}", filetype="sounds")
        for back in (got, whole):
            assert {u: ([list(map(int, f)) for f in x], r) for u, (x, r) in held(back).items()} == {u: (x, r) for u, x, r in rows}
        assert len([p for p in path.iterdir() if not p.name.startswith(".")]) == 6
    with pytest.raises(Exception, match="filetype"):
        archives.by_specifier(spark, f"ark:{tmp_path}/wav", filetype="sonds").collect()


def test_archives_of_sounds_roll_over(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(archive_source, "ARCHIVE_BYTES", 500)
    batch = pa.RecordBatch.from_pylist([{"uttid": f"u{i}", "x": [[float(i)]] * 50, "rate": 8000.0} for i in range(20)], pa.schema([("uttid", pa.string()), ("x", pa.list_(pa.list_(pa.float32()))), ("rate", pa.float64())]))
    files, root = archive_source.place(str(tmp_path))
    made = list(archive_source._Writer(str(tmp_path), {"filetype": "sounds"})._packed(files, f"{root}/part", iter([batch.slice(0, 7), batch.slice(7)])))
    assert [u for u, _, _ in made] == [f"u{i}" for i in range(20)] and len({p for _, _, p in made}) > 3
    for i, (_, line, path) in enumerate(made):
        with open(path, "rb") as f:
            f.seek(int(line.rsplit(":", 1)[1]))
            rate, x = sound_format.decode(matrix_format.read_file(f))
            assert rate == 8000 and x.tolist() == [[i]] * 50

import hashlib
import random
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import gif_media, queries

SF = "/root/testdata/sf0.001"


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([b"", b"\0" * 9000, b"ab" * 7000]))
def test_lzw_round_trip(data, more):
    assert gif_media.lzw_decode(gif_media.lzw_encode(data + more), 8) == data + more


def test_lzw_refills_its_table():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(60_000)) + bytes(rng.choice(b"abcd") for _ in range(90_000))
    assert gif_media.lzw_decode(gif_media.lzw_encode(data), 8) == data


def plain_decode(stream, bits):
    """Bit by bit, by the published algorithm; the table stays full until a clear code."""
    clear, end, out, at = 1 << bits, (1 << bits) + 1, b"", 0
    table, width, prev = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
    value, total = int.from_bytes(stream, "little"), 8 * len(stream)
    while at + width <= total:
        code = value >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, width, prev = table[: end + 1], bits + 1, None
        elif code == end:
            break
        else:
            entry = table[code] if code < len(table) else prev + prev[:1]
            out += entry
            if prev is not None and len(table) < 4096:
                table.append(prev + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
            prev = entry
    return out


def test_lzw_against_the_published_algorithm():
    rng = random.Random(2)
    data = bytes(rng.choice(b"abcdefgh ") for _ in range(12_000))
    stream = gif_media.lzw_encode(data)
    assert plain_decode(stream, 8) == data
    # a writer that leaves its table full: codes of 12 bits go on without a clear code
    codes = [256] + [rng.randrange(256) for _ in range(6000)] + [257]
    bits, size, width = "", 258, 9
    for i, c in enumerate(codes):
        bits = format(c, f"0{width}b") + bits
        if i >= 2 and size < 4096:
            size += 1
            width = min(12, width + (size == 1 << width))
    stream = int(bits, 2).to_bytes(-(-len(bits) // 8), "little")
    assert gif_media.lzw_decode(stream, 8) == plain_decode(stream, 8) == bytes(codes[1:-1])


def block(index, box, disposal=0, clear=None, delay=5, colours=None, interlaced=False):
    data = gif_media.lzw_encode(bytes(index), 2)
    control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
    flags = (0x80 | 1 if colours else 0) | (0x40 if interlaced else 0)
    return control + b"\x2c" + struct.pack("<HHHHB", *box, flags) + bytes(v for c in colours or [] for v in c) + b"\x02" + gif_media._sub_blocks(data)


RED, GREEN, BLUE, GREY = (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128)


def test_palettes_disposal_transparency_and_interlace():
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 8, 0x81, 0, 0) + bytes(v for c in (RED, GREEN, BLUE, GREY) for v in c)
    rows = [i % 4 for i in range(8) for _ in range(2)]
    shown = [rows[2 * i : 2 * i + 2] for i in (0, 4, 2, 6, 1, 3, 5, 7)]
    media = head + b"\x21\xfe\x02hi\0"
    media += block([x for r in shown for x in r], (0, 0, 2, 8), disposal=1, interlaced=True)
    media += block([3, 0, 0, 3], (0, 0, 2, 2), disposal=3, clear=0, delay=7, colours=[BLUE, RED, RED, GREEN])
    media += block([2] * 2, (0, 6, 2, 1), disposal=2)
    media += block([1], (1, 7, 1, 1)) + b"\x3b"
    f = list(gif_media.decode_gif(media))
    colour = lambda c: tuple(int(v) for v in c[:3])
    assert [x.start_cs for x in f] == [0, 5, 12, 17] and [x.delay_cs for x in f] == [5, 7, 5, 5]
    assert [colour(f[0].canvas[i, 0]) for i in range(8)] == [RED, GREEN, BLUE, GREY] * 2
    assert colour(f[1].canvas[0, 0]) == GREEN and colour(f[1].canvas[0, 1]) == RED and colour(f[1].canvas[1, 1]) == GREEN
    assert colour(f[2].canvas[0, 0]) == RED and colour(f[2].canvas[6, 0]) == BLUE
    assert f[3].canvas[6, 0, 3] == 0 and colour(f[3].canvas[7, 1]) == GREEN
    h = gif_media.histogram(f[3].canvas)
    assert h.sum() == 14 and h[gif_media.BINS**2 * 3] == (f[3].canvas[..., :3] == RED).all(axis=2).sum()
    assert list(gif_media.decode_gif(b"no gif")) == []


def test_query_against_plain_values(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op5_gif_media(spark, SF).collect()}
    assert got.keys() == {r.doc_id for r in rows}
    for r in rows:
        raw = r.text.encode()
        want = raw + b"\0" * (-len(raw) % 64)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        media = gif_media.encode_gif(want)
        assert (g.media_bytes, g.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        levels = np.bincount(np.frombuffer(want, np.uint8) >> 6, minlength=4)
        assert g.feature.endswith("hist=" + ",".join(f"{i * 21}:{n}" for i, n in enumerate(levels) if n))


def test_edge_rows(spark):
    rows = [(1, None, "m"), (2, "", "m"), (3, "x" * 64, "m"), (4, "é\U0001f600" * 60_000, "m"), (None, "a", "m"), (1, None, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = gif_media.store_texts(df).collect()
    assert sorted(r.payload_bytes for r in got) == [64, 64, 64, 64, 64, 360_000]
    assert gif_media.store_texts(df.limit(0)).count() == 0
    f = gif_media.frames(gif_media.encoded(df)).where("doc_id = 4").orderBy("frame").collect()
    assert [x.start_ms for x in f] == [0, 40, 80, 120, 160, 200] and b"".join(x.indices for x in f) == ("é\U0001f600" * 60_000).encode() and all(sum(x.histogram) == 65536 for x in f[:5])

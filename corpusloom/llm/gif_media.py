"""GIF media columns: payloads stored as animations, and animations decoded to timed frames with colour histograms.

`encode_gif` writes 8-bit samples as palette indices of one frame for every ROWS rows of WIDTH samples; `decode_gif`
reads any GIF: LZW code streams of variable width, local and global palettes, interlace, transparency and the disposal
of each frame, and gives the composed canvas of each frame with its time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of

WIDTH, ROWS = 64, 1024  # samples a row; rows a frame
DELAY_CS = 4  # hundredths of a second a frame
BINS = 4  # histogram bins of each colour channel
MAX_CODE = 4096


def padded(payload: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return payload + b"\0" * ((-len(payload)) % WIDTH if payload else WIDTH)


@lru_cache(maxsize=16)
def _widths(bits: int, full: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bits of the i-th code after a clear code, where each begins). Each code but the first adds an entry; the width grows when the table has filled it, to 12 bits."""
    size = (1 << bits) + 2 + np.maximum(np.arange(MAX_CODE) - 1, 0)
    w = np.full(MAX_CODE, 12, np.int64) if full else np.clip(np.floor(np.log2(size)).astype(np.int64) + 1, bits + 1, 12)
    return w, np.cumsum(w) - w


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """GIF's LZW; a clear code starts the stream and each refill of the table."""
    clear, end = 1 << bits, (1 << bits) + 1
    blocks: list[list[int]] = []
    table: dict[int, int] = {}
    codes, free = [], end + 1
    get, add = table.get, codes.append
    rest = iter(data)
    prefix = next(rest, -1)
    for b in rest:
        key = prefix << 8 | b
        prefix = get(key)
        if prefix is None:
            add(key >> 8)
            table[key] = free
            free += 1
            prefix = b
            if free == MAX_CODE:  # the prefix at hand is still to come, as the first code after the clear code
                blocks.append(codes)
                codes, free = [], end + 1
                add = codes.append
                table.clear()
    if prefix >= 0:
        add(prefix)
    blocks.append(codes)
    widths, _ = _widths(bits)
    out_codes, out_bits = [np.array([clear])], [np.array([bits + 1])]
    for i, block in enumerate(blocks):
        last = end if i == len(blocks) - 1 else clear
        n = len(block)
        out_codes += [np.array([*block, last])]
        out_bits += [widths[: n + 1]]
    return _pack_bits(np.concatenate(out_codes), np.concatenate(out_bits))


def _pack_bits(codes: np.ndarray, bits: np.ndarray) -> bytes:
    at = np.concatenate([[0], np.cumsum(bits)])
    out = np.zeros((at[-1] + 7) // 8 + 3, np.uint8)
    value = codes.astype(np.uint32) << (at[:-1] % 8).astype(np.uint32)
    for k in range(3):  # a code spans at most three bytes; codes meet in a byte but share no bit
        np.add.at(out, at[:-1] // 8 + k, ((value >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8))
    return out[: (at[-1] + 7) // 8].tobytes()


def _strings(codes: np.ndarray, clear: int) -> tuple[bytes, bool]:
    """The indices that a run of codes after a clear code stands for, and whether it is sound up to its end.

    The j-th table entry is the string of the j-th code and the first index of the next one. So each code's string is a chain of
    entries that ends in a root; chains are followed for all codes at once.
    """
    at = np.arange(len(codes))
    parent = np.where(codes < clear, -1, codes - clear - 2)
    wrong = np.flatnonzero(parent >= at)
    if len(wrong):
        codes, at, parent = codes[: wrong[0]], at[: wrong[0]], parent[: wrong[0]]
    root, depth = np.where(parent < 0, at, parent), (parent >= 0).astype(np.int64)
    while (depth[root] > 0).any():
        depth += depth[root]
        root = root[root]
    first = codes[root]
    last = np.where(parent < 0, codes, first[np.minimum(parent + 1, max(0, len(at) - 1))])
    end = np.cumsum(depth + 1)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    now, place = at, end - 1
    while len(now):
        out[place] = last[now]
        now = parent[now]
        more = now >= 0
        now, place = now[more], place[more] - 1
    return out.tobytes(), not len(wrong)


def lzw_decode(stream: bytes, bits: int) -> bytes:
    """The indices of a code stream. A damaged or short stream gives what it holds up to there."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0" * 4, np.uint8).astype(np.uint32)
    total, at, out, run = 8 * len(stream), 0, [], []
    while at < total:
        # widths follow from the codes' number since the last clear code; a table that is full stays so, at 12 bits
        w, begin = _widths(bits, bool(run))
        n = int(np.searchsorted(begin, total - at - bits, side="left"))  # codes that begin before the end; the last may be cut
        n -= bool(n and at + begin[n - 1] + w[n - 1] > total)
        w, start = w[:n], at + begin[:n]
        byte = start >> 3
        codes = (((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (start & 7).astype(np.uint32)) & ((1 << w) - 1).astype(np.uint32)).astype(np.int64)
        special = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(special[0]) if len(special) else n
        run.append(codes[:upto])
        if not len(special) and n == MAX_CODE:
            at = int(start[-1] + w[-1])
            continue
        part, sound = _strings(np.concatenate(run), clear)
        out.append(part)
        if not sound or not len(special) or codes[upto] == end:
            return b"".join(out)
        run, at = [], int(start[upto] + w[upto])
    if run:
        out.append(_strings(np.concatenate(run), clear)[0])
    return b"".join(out)


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p := data[i : i + 255])]) + p for i in range(0, len(data), 255)) + b"\0"


_GREYS = bytes(v for g in range(256) for v in (g, g, g))


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF of 256 greys whose frames hold the payload, a positive multiple of `width` bytes."""
    height = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(height, rows), 0xF7, 0, 0), _GREYS]
    for top in range(0, height, rows):
        part = payload[top * width : (top + rows) * width]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay_cs, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _sub_blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    start_cs: int
    delay_cs: int
    disposal: int
    box: tuple[int, int, int, int]  # left, top, width, height
    indices: bytes  # of the box, in row order
    canvas: np.ndarray  # (height, width, 4) uint8 RGBA after this frame is drawn


def _deinterlaced(rows: np.ndarray) -> np.ndarray:
    h = len(rows)
    order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(rows)
    out[order] = rows
    return out


def decode_gif(media: bytes) -> Iterator[Frame]:
    """The frames of a GIF, composed. Bytes that are no GIF give none; a cut file gives its whole frames."""
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        return
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", media, 6)
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        p = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return p

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(media) and (n := media[at]):
            parts.append(media[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    shared = palette(flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    clock, delay, disposal, clear_index = 0, 0, 0, None
    while at < len(media):
        kind = media[at]
        at += 1
        if kind == 0x21:
            label = media[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                f, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = f >> 2 & 7, index if f & 1 else None
            continue
        if kind != 0x2C or at + 9 > len(media):
            return
        left, top, w, h, f = struct.unpack_from("<HHHHB", media, at)
        at += 9
        colours = palette(f)
        colours = shared if colours is None else colours
        bits = media[at]
        at += 1
        indices = lzw_decode(blocks(), bits)[: w * h]
        indices += b"\0" * (w * h - len(indices))
        grid = np.frombuffer(indices, np.uint8).reshape(h, w)
        if f & 0x40:
            grid = _deinterlaced(grid)
        before = canvas.copy() if disposal == 3 else None
        seen = grid[: max(0, height - top), : max(0, width - left)]
        area = canvas[top : top + h, left : left + w]
        if colours is not None:
            rgba = np.full((256, 4), 255, np.uint8)
            rgba[: len(colours), :3] = colours
            drawn = rgba[seen]
            area[...] = drawn if clear_index is None else np.where((seen == clear_index)[..., None], area, drawn)
        yield Frame(clock, delay, disposal, (left, top, w, h), grid.tobytes(), canvas.copy())
        clock += delay
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Pixels by colour in bins of equal width, red the slowest; pixels that nothing has painted are not counted."""
    step = (np.arange(256) * bins >> 8).astype(np.int16)
    at = (step * bins * bins)[canvas[..., 0]] + (step * bins)[canvas[..., 1]] + step[canvas[..., 2]]
    painted = canvas[..., 3] > 0
    return np.bincount(at.ravel() if painted.all() else at[painted], minlength=bins**3)


def encoded(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, null as empty, as a GIF."""
    small_batches(docs.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = texts_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, t), pa.int64()), pa.array([encode_gif(padded(x)) for x in t], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", text_col).mapInArrow(run, docs.select("doc_id").schema.add("n_bytes", "long").add("media", "binary"))


FRAMES = "frame int, start_ms long, delay_ms long, disposal int, width int, height int, indices binary, histogram array<long>"


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each frame of each GIF: when and how long it shows, how it goes, its indices and the histogram of its canvas. Null media or no GIF: no row."""
    small_batches(media.sparkSession, 200)
    names = [id_col, "frame", "start_ms", "delay_ms", "disposal", "width", "height", "indices", "histogram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(d, i, 10 * f.start_cs, 10 * f.delay_cs, f.disposal, f.box[2], f.box[3], f.indices, histogram(f.canvas)) for i, f in enumerate(decode_gif(m or b""))]
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], b.column(0).type), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.int32()), pa.array(c[6], pa.int32()), pa.array(c[7], pa.binary()), pa.array(c[8], pa.list_(pa.int64()))], names)

    return media.select(id_col, media_col).mapInArrow(run, f"{id_col} {media.schema[id_col].dataType.simpleString()}, {FRAMES}")


DIGESTS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def digests(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, of (doc_id, n_bytes, media): the payload is read from the composed canvases.

    feature: number of frames, total milliseconds, and the histogram of all canvases as bin:pixels.
    """
    small_batches(stored.sparkSession, 200)

    def row(d: int, n: int, media: bytes) -> tuple:
        sha, tail, size, count, ms, total = hashlib.sha256(), b"", 0, 0, 0, np.zeros(BINS**3, np.int64)
        for f in decode_gif(media):
            part = f.canvas[: f.box[3], : f.box[2], 0].tobytes()
            sha.update(part)
            tail, size, count, ms = (tail + part)[-64:], size + len(part), count + 1, ms + 10 * f.delay_cs
            total += histogram(f.canvas[: f.box[3]])
        feature = f"frames={count};ms={ms};hist=" + ",".join(f"{i}:{total[i]}" for i in np.flatnonzero(total))
        return d, n, size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = list(zip(*map(row, *(x.to_pylist() for x in b.columns)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], b.column(0).type), *(pa.array(x) for x in c[1:])], DIGESTS)

    schema = stored.select("doc_id").schema.add("n_bytes", "long").add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("feature", "string")
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """Digests of every whole text stored as a GIF and read back.

    Null text is empty: 64 zero bytes. A null doc_id stays null. Repeated rows and equal texts give equal values.
    A text of any length takes as many frames as it needs. An empty table gives an empty result. Other columns are not read.
    """
    return digests(encoded(docs.select(F.col("doc_id"), F.col("text"))))

"""Sound files as 16-bit samples: wave, FLAC and SPHERE, told apart by their first bytes; writers of wave and FLAC.

Samples of other widths are cut or widened to 16 bits, those of floating point are rounded as they are. FLAC's residuals are read with
one pass over the places of the unary codes of a frame and array operations for the rest; linear prediction runs over all frames of a
stretch side by side. Frames of a few samples, where array operations cost more than they do, are coded with plain integers. Fixed by the formats: marks, codes, polynomials and tables of codes.
"""

from __future__ import annotations

import hashlib
import struct
from functools import cache

import numpy as np

BLOCK = 4096  # samples in a frame that is written
STRETCH = 256  # frames decoded side by side
LPC_ORDER, LPC_BITS = 8, 14
SHORT = 4 * LPC_ORDER  # frames of fewer samples have no predictor of their own and are coded number by number
BLOCK_SIZES = {1: 192, **{i: 576 << i - 2 for i in range(2, 6)}, **{i: 256 << i - 8 for i in range(8, 16)}}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
RATE_BYTES = {12: 1, 13: 2, 14: 2}


def sixteen(x: np.ndarray, bits: int) -> np.ndarray:
    """Integers of a width as 16 bits."""
    return (x >> bits - 16 if bits > 16 else x << 16 - bits).astype(np.int16)


def decode(raw: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples of shape (n, channels))."""
    for mark, reader in ((b"RIFF", _wave), (b"fLaC", flac_samples), (b"NIST_1A", _sphere)):
        if raw.startswith(mark):
            return reader(raw)
    raise ValueError("not a wave, FLAC or SPHERE file")


@cache
def _law(name: str) -> np.ndarray:
    """The samples of the 256 bytes of a companding law."""
    i = np.arange(256)
    if name == "ulaw":
        code = ~i & 255
        size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
        return np.where(code & 128, -size, size)
    code = i ^ 0x55
    chord, step = code >> 4 & 7, code & 15
    size = np.where(chord, (step << 4) + 264 << np.maximum(chord - 1, 0), (step << 4) + 8)
    return np.where(code & 128, size, -size)


def _whole(raw: bytes, width: int, little: bool = True) -> np.ndarray:
    """Signed integers of `width` bytes."""
    parts = np.frombuffer(raw[: len(raw) // width * width], np.uint8).reshape(-1, width).astype(np.int64)
    parts = parts[:, ::-1] if little else parts
    x = sum(parts[:, i] << 8 * (width - 1 - i) for i in range(width))
    return np.where(x >> 8 * width - 1, x - (1 << 8 * width), x)


def _wave(raw: bytes) -> tuple[int, np.ndarray]:
    at, kind = 12, None
    if raw[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    while at + 8 <= len(raw):
        name, size = struct.unpack_from("<4sI", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            kind = struct.unpack_from("<H", body, 24)[0] if kind == 0xFFFE else kind
        elif name == b"data":
            if kind is None:
                break
            if kind == 1:
                x = (np.frombuffer(body, np.uint8).astype(np.int64) - 128) if bits <= 8 else _whole(body, -(-bits // 8))
                x = sixteen(x, -(-bits // 8) * 8)
            elif kind == 3:
                x = np.clip(np.rint(np.frombuffer(body, f"<f{bits // 8}")), -32768, 32767).astype(np.int16)
            elif kind in (6, 7):
                x = _law("ulaw" if kind == 7 else "alaw")[np.frombuffer(body, np.uint8)].astype(np.int16)
            else:
                raise ValueError(f"wave files of kind {kind} are not read")
            return rate, x[: len(x) // channels * channels].reshape(-1, channels)
        at += 8 + size + (size & 1)
    raise ValueError("a wave file without samples")


def _columns(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.int16)
    return x[:, None] if x.ndim == 1 else x


def wave_bytes(x: np.ndarray, rate: int) -> bytes:
    x = _columns(x)
    data, channels = x.astype("<i2").tobytes(), x.shape[1] or 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate, 2 * channels * rate, 2 * channels, 16, b"data", len(data)) + data


def _sphere(raw: bytes) -> tuple[int, np.ndarray]:
    size = int(raw[8:16])
    fields = {f[0]: f[2] for line in raw[16:size].decode("latin-1").split("\n") if len(f := line.split(None, 2)) == 3}
    coding, width, channels = fields.get("sample_coding", "pcm"), int(fields.get("sample_n_bytes", 2)), int(fields.get("channel_count", 1))
    body = raw[size:]
    if coding in ("ulaw", "mu-law", "alaw"):
        x = _law("alaw" if coding == "alaw" else "ulaw")[np.frombuffer(body, np.uint8)].astype(np.int16)
    elif coding == "pcm":
        x = sixteen(_whole(body, width, not fields.get("sample_byte_format", "01").startswith("1")), 8 * width)
    else:
        raise ValueError(f"SPHERE files coded as {coding} are not read")
    n = int(fields["sample_count"]) if "sample_count" in fields else len(x) // channels
    return int(float(fields["sample_rate"])), x[: n * channels].reshape(-1, channels)


# ---- FLAC


@cache
def _crc_table(width: int, polynomial: int) -> list[int]:
    """By the crc so far, xored with the next `width` bits: the crc after them."""
    crc = np.arange(1 << width, dtype=np.int64)
    for _ in range(width):
        crc = np.where(crc >> width - 1 & 1, crc << 1 ^ polynomial, crc << 1) & (1 << width) - 1
    return crc.tolist()


def _crc8(raw: bytes) -> int:
    crc, table = 0, _crc_table(8, 0x07)
    for b in raw:
        crc = table[crc ^ b]
    return crc


def _crc16(raw: bytes) -> int:
    crc, table = 0, _crc_table(16, 0x8005)
    for w in np.frombuffer(raw[: len(raw) & ~1], ">u2").tolist():
        crc = table[crc ^ w]
    if len(raw) & 1:
        crc ^= raw[-1] << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


class _Bits:
    """A stretch of bytes by bits."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        ones = np.where(self.bits, np.arange(len(self.bits)), len(self.bits))
        self.next_one = np.minimum.accumulate(ones[::-1])[::-1]

    def number(self, n: int) -> int:
        first, end = self.at >> 3, self.at + n + 7 >> 3
        if end > len(self.raw):
            raise ValueError("the file ends within a frame")
        self.at += n
        return int.from_bytes(self.raw[first:end], "big") >> -self.at % 8 & (1 << n) - 1

    def signed(self, n: int) -> int:
        x = self.number(n)
        return x - (1 << n) if n and x >> n - 1 else x

    def unary(self) -> int:
        at = int(self.next_one[self.at])
        n, self.at = at - self.at, at + 1
        return n

    def fields(self, places: np.ndarray, width: int) -> np.ndarray:
        """Numbers of `width` bits at some places."""
        x = np.zeros(len(places), np.int64)
        for i in range(width):
            x = x << 1 | self.bits[places + i]
        return x

    def numbers(self, count: int, width: int) -> np.ndarray:
        """Signed numbers in a row."""
        x = self.fields(self.at + width * np.arange(count), width)
        self.at += count * width
        return np.where(x >> width - 1 & 1, x - (1 << width), x) if width else x

    def rice(self, count: int, low_bits: int) -> np.ndarray:
        """Rice codes in a row: zeros, a one, and low bits. The walk from code to code is a list look-up each."""
        ends, after, at = [], low_bits + 1, self.at
        stop = min(len(self.bits), self.at + 64 * (count + 64))
        follow, base = self.next_one[at:stop].tolist(), at
        for _ in range(count):
            if at - base >= len(follow):  # codes of unusual length
                follow, base = self.next_one[at : at + 64 * (count + 64)].tolist(), at
            one = follow[at - base]
            ends.append(one)
            at = one + after
        if at > len(self.bits):
            raise ValueError("the file ends within a frame")
        ends = np.array(ends, np.int64)
        starts = np.concatenate([[self.at], ends[:-1] + after]) if count else ends
        self.at = at
        x = (ends - starts) << low_bits | self.fields(ends + 1, low_bits)
        return x >> 1 ^ -(x & 1)


def _residual(bits: _Bits, size: int, order: int) -> np.ndarray:
    wide, parts = 5 if bits.number(2) else 4, bits.number(4)
    out = []
    for i in range(1 << parts):
        n, k = (size >> parts) - (0 if i else order), bits.number(wide)
        out.append(bits.numbers(n, bits.number(5)) if k == (1 << wide) - 1 else bits.rice(n, k))
    return np.concatenate(out)


def _short_subframes(raw: bytes, size: int, widths: list[int]) -> tuple[int, list[dict]] | None:
    """(bits, subframes) of a frame of few samples; None if one of them has a predictor or wasted bits."""
    bits = bin(int.from_bytes(b"\1" + raw, "big"))[3:]
    at, out = 0, []

    def number(n: int) -> int:
        nonlocal at
        at += n
        if at > len(bits):
            raise ValueError("the file ends within a frame")
        return int(bits[at - n : at], 2) if n else 0

    def signed(n: int) -> int:
        x = number(n)
        return x - (1 << n) if n and x >> n - 1 else x

    for width in widths:
        kind, wasted = number(7), number(1)
        order = kind - 8
        if wasted or not (kind < 2 or 0 <= order <= 4):
            return None
        if kind < 2:
            x = [signed(width) for _ in range(size)] if kind else [signed(width)] * size
        else:
            x = [signed(width) for _ in range(order)]
            wide, parts = 5 if number(2) else 4, number(4)
            for i in range(1 << parts):
                n, k = (size >> parts) - (0 if i else order), number(wide)
                if k == (1 << wide) - 1:
                    k = number(5)
                    x += [signed(k) for _ in range(n)]
                    continue
                for _ in range(n):
                    one = bits.find("1", at)
                    if one < 0:
                        raise ValueError("the file ends within a frame")
                    zeros, at = one - at, one + 1
                    code = zeros << k | number(k)
                    x.append(code >> 1 ^ -(code & 1))
            before = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}[order]
            for t in range(order, len(x)):
                x[t] += sum(w * x[t - 1 - i] for i, w in enumerate(before))
        out.append({"wasted": 0, "size": size, "x": np.array(x, np.int64)})
    return at, out


def _subframe(bits: _Bits, size: int, width: int) -> dict:
    """A channel of a frame: samples, or first values, residual and predictor."""
    bits.number(1)
    kind, wasted = bits.number(6), 0
    if bits.number(1):
        wasted = bits.unary() + 1
        width -= wasted
    out = {"wasted": wasted, "size": size}
    if kind == 0:
        return out | {"x": np.full(size, bits.signed(width), np.int64)}
    if kind == 1:
        return out | {"x": bits.numbers(size, width)}
    if 8 <= kind <= 12:
        first = bits.numbers(kind - 8, width)
        x = np.concatenate([first, _residual(bits, size, kind - 8)])
        # each order is a sum over the order above, whose first value follows from the first samples
        for k in range(kind - 9, -1, -1):
            x[k:] = np.cumsum(np.concatenate([np.diff(first, k)[:1], x[k + 1 :]]))
        return out | {"x": x}
    if kind < 32:
        raise ValueError("a subframe of no known kind")
    order = kind - 31
    first = bits.numbers(order, width)
    precision, shift = bits.number(4) + 1, bits.signed(5)
    return out | {"first": first, "weights": bits.numbers(order, precision), "shift": shift, "residual": _residual(bits, size, order)}


def _predicted(subframes: list[dict]) -> None:
    """Samples of subframes with linear prediction, all of them side by side, a time after the other."""
    order, size = max(len(s["first"]) for s in subframes), max(s["size"] for s in subframes)
    x, weights = np.zeros((order + size, len(subframes)), np.int64), np.zeros((order, len(subframes)), np.int64)
    orders, shift = np.array([len(s["first"]) for s in subframes]), np.array([s["shift"] for s in subframes])
    for i, s in enumerate(subframes):
        n = len(s["first"])
        x[order : order + n, i], x[order + n : order + s["size"], i] = s["first"], s["residual"]
        weights[order - n :, i] = s["weights"][::-1]
    for t in range(int(orders.min()), size):
        said = (x[t : t + order] * weights).sum(axis=0)
        x[order + t] += np.where(t >= orders, np.where(shift >= 0, said >> np.maximum(shift, 0), said << np.maximum(-shift, 0)), 0)
    for i, s in enumerate(subframes):
        s["x"] = x[order : order + s["size"], i]


def _frame(raw: bytes, at: int, most: int, width: int) -> tuple[int, int, list[dict]]:
    """(end, channel assignment, subframes) of the frame at a place."""
    if raw[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise ValueError("no frame where one should be")
    size, rate, channels, depth = raw[at + 2] >> 4, raw[at + 2] & 15, raw[at + 3] >> 4, raw[at + 3] >> 1 & 7
    lead = raw[at + 4]
    head = at + 5 + (0 if lead < 128 else 6 if lead == 254 else 7 - (lead ^ 255).bit_length())
    if size in (6, 7):
        n = size - 5
        size = int.from_bytes(raw[head : head + n], "big") + 1
        head += n
    else:
        size = BLOCK_SIZES[size]
    head += RATE_BYTES.get(rate, 0)
    if _crc8(raw[at:head]) != raw[head]:
        raise ValueError("a frame's head is damaged")
    width = SAMPLE_BITS.get(depth, width)
    widths = [width + (i == {8: 1, 9: 0, 10: 1}.get(channels)) for i in range(channels + 1 if channels < 8 else 2)]
    short = _short_subframes(raw[head + 1 : at + most], size, widths) if size < SHORT else None
    if short is not None:
        used, subframes = short
    else:
        bits = _Bits(raw[head + 1 : at + most])
        subframes = [_subframe(bits, size, w) for w in widths]
        used = bits.at
    end = head + 1 + (used + 7 >> 3)
    if _crc16(raw[at:end]) != int.from_bytes(raw[end : end + 2], "big"):
        raise ValueError("a frame is damaged")
    return end + 2, channels, subframes


def _channels(assignment: int, x: list[np.ndarray]) -> list[np.ndarray]:
    if assignment == 8:
        return [x[0], x[0] - x[1]]
    if assignment == 9:
        return [x[0] + x[1], x[1]]
    if assignment == 10:
        double = x[0] << 1 | x[1] & 1
        return [double + x[1] >> 1, double - x[1] >> 1]
    return x


def flac_samples(raw: bytes, check: bool = True) -> tuple[int, np.ndarray]:
    """(rate, samples) of a FLAC file. With check, the samples must have the MD5 that the file names."""
    at, last = 4, False
    while not last:
        last, kind, size = raw[at] >> 7, raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        if kind == 0:
            info = raw[at + 4 : at + 4 + size]
        at += 4 + size
    most, packed = int.from_bytes(info[7:10], "big"), int.from_bytes(info[10:18], "big")
    rate, channels, width, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    most = (most or 2 * channels * int.from_bytes(info[2:4], "big") * (width + 7 >> 3) + 64) + 32
    done, held = [], []

    def finish() -> None:
        predicted = [s for _, subframes in held for s in subframes if "x" not in s]
        if predicted:
            _predicted(predicted)
        for assignment, subframes in held:
            done.append(np.stack(_channels(assignment, [s["x"] << s["wasted"] for s in subframes]), axis=1))
        held.clear()

    while at < len(raw) and (not total or sum(map(len, done)) + sum(s[1][0]["size"] for s in held) < total):
        at, assignment, subframes = _frame(raw, at, most, width)
        held.append((assignment, subframes))
        if len(held) == STRETCH:
            finish()
    finish()
    x = np.concatenate(done) if done else np.zeros((0, channels), np.int64)
    if total and len(x) != total:
        raise ValueError("the file ends before its samples do")
    if check and info[18:34] != bytes(16) and _md5(x, width) != info[18:34]:
        raise ValueError("the samples are not those that were written")
    return rate, sixteen(x, width)


def _md5(x: np.ndarray, width: int) -> bytes:
    size = width + 7 >> 3
    return hashlib.md5(x.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :size].tobytes()).digest()


def _of(number: int, n: int) -> np.ndarray:
    return np.array([number >> n - 1 - i & 1 for i in range(n)], np.uint8)


def _of_all(x: np.ndarray, n: int) -> np.ndarray:
    return (x[:, None] >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8).reshape(-1)


def _rice_coded(residual: np.ndarray, order: int) -> np.ndarray:
    """A residual in as many parts, and with as many low bits in each, as make it short."""
    size, code = len(residual) + order, np.where(residual < 0, -2 * residual - 1, 2 * residual)
    best = None
    for parts in range(7):
        if size % (1 << parts) or size >> parts <= order:
            break
        edges = np.concatenate([[0], (np.arange(1, 1 << parts) * (size >> parts)) - order, [len(code)]]).astype(np.int64)
        n = np.diff(edges)
        cost = np.stack([np.add.reduceat(np.append(code >> k, 0), edges[:-1]) * (n > 0) + n * (k + 1) for k in range(15)])
        low, bits = cost.argmin(axis=0), int(cost.min(axis=0).sum()) + 4 * len(n)
        if best is None or bits < best[0]:
            best = bits, parts, edges, low
    _, parts, edges, low = best
    out = [_of(0, 2), _of(parts, 4)]
    for first, end, k in zip(edges[:-1].tolist(), edges[1:].tolist(), low.tolist(), strict=True):
        c = code[first:end]
        ones = np.cumsum((c >> k) + 1 + k) - k - 1
        bits = np.zeros(int(ones[-1]) + 1 + k if len(c) else 0, np.uint8)
        bits[ones] = 1
        for i in range(k):
            bits[ones + 1 + i] = c >> k - 1 - i & 1
        out += [_of(k, 4), bits]
    return np.concatenate(out)


def _lpc(x: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Weights and shift of a linear predictor of samples, from their autocorrelation."""
    if len(x) < SHORT:
        return None
    w = x * np.hanning(len(x))
    r = np.array([w[: len(w) - i] @ w[i:] for i in range(LPC_ORDER + 1)])
    if r[0] <= 0:
        return None
    at = np.abs(np.subtract.outer(np.arange(LPC_ORDER), np.arange(LPC_ORDER)))
    weights = np.linalg.lstsq(r[at] + np.eye(LPC_ORDER) * r[0] * 1e-9, r[1:], rcond=None)[0]
    most = np.abs(weights).max()
    shift = int(np.clip(LPC_BITS - 2 - np.floor(np.log2(most)) if most > 0 else 0, 0, 15))
    limit = 1 << LPC_BITS - 1
    return np.clip(np.rint(weights * (1 << shift)), -limit, limit - 1).astype(np.int64), shift


def _subframe_bits(x: np.ndarray, width: int) -> np.ndarray:
    """The shortest of the ways to write a channel of a frame."""
    if (x == x[0]).all():
        return np.concatenate([_of(0, 8), _of_all(x[:1], width)])
    ways = [np.concatenate([_of(1 << 1, 8), _of_all(x, width)])]
    sums = [np.abs(np.diff(x, k)).sum() for k in range(min(5, len(x)))]
    order = int(np.argmin(sums))
    ways.append(np.concatenate([_of(8 + order << 1, 8), _of_all(x[:order], width), _rice_coded(np.diff(x, order), order)]))
    found = _lpc(x)
    if found is not None:
        weights, shift = found
        said = sum(w * x[LPC_ORDER - 1 - i : len(x) - 1 - i] for i, w in enumerate(weights.tolist())) >> shift
        residual = x[LPC_ORDER:] - said
        if np.abs(residual).max() < 1 << 30:
            ways.append(np.concatenate([_of(31 + LPC_ORDER << 1, 8), _of_all(x[:LPC_ORDER], width), _of(LPC_BITS - 1, 4), _of(shift, 5), _of_all(weights, LPC_BITS), _rice_coded(residual, LPC_ORDER)]))
    return min(ways, key=len)


def _short_rice(residual: list[int], order: int) -> tuple[int, int]:
    """_rice_coded() of few numbers, as (number, its bits)."""
    size, code = len(residual) + order, [-2 * r - 1 if r < 0 else 2 * r for r in residual]
    best = None
    for parts in range(7):
        step = size >> parts
        if size % (1 << parts) or step <= order:
            break
        groups, bits = [], 4 << parts
        for end in range(step - order, len(code) + 1, step):
            c = code[max(0, end - step) : end]
            costs = [sum([v >> k for v in c]) + len(c) * (k + 1) for k in range(15)]
            least = min(costs)
            bits += least
            groups.append((costs.index(least), c))
        if best is None or bits < best[0]:
            best = bits, parts, groups
    bits, out, groups = best[0], best[1], best[2]
    for k, c in groups:
        out = out << 4 | k
        for v in c:
            out = out << (v >> k) + 1 + k | 1 << k | v & (1 << k) - 1
    return out, bits + 6


def _short_subframe(x: list[int], width: int) -> tuple[int, int]:
    """_subframe_bits() of few samples, as (number, its bits)."""
    mask = (1 << width) - 1
    if x.count(x[0]) == len(x):
        return x[0] & mask, 8 + width
    rows = [x]
    while len(rows) < min(5, len(x)):
        last = rows[-1]
        rows.append([b - a for a, b in zip(last, last[1:], strict=False)])
    sums = [sum(map(abs, r)) for r in rows]
    order = sums.index(min(sums))
    coded, bits = _short_rice(rows[order], order)
    kind, held = (1, x) if 8 + width * len(x) <= 8 + width * order + bits else (8 + order, x[:order])
    out = kind << 1
    for v in held:
        out = out << width | v & mask
    return (out, 8 + width * len(x)) if kind == 1 else (out << bits | coded, 8 + width * order + bits)


def _short_channels(part: np.ndarray) -> tuple[int, bytes]:
    """(channel assignment, subframes) of a frame of few samples."""
    x = part.T.tolist()
    sides, assignment = [_short_subframe(c, 16) for c in x], len(x) - 1
    if len(x) == 2:
        side, mid = _short_subframe([a - b for a, b in zip(*x, strict=True)], 17), _short_subframe([a + b >> 1 for a, b in zip(*x, strict=True)], 16)
        pairs = {1: sides, 8: [sides[0], side], 9: [side, sides[1]], 10: [mid, side]}
        assignment = min(pairs, key=lambda k: pairs[k][0][1] + pairs[k][1][1])
        sides = pairs[assignment]
    out = size = 0
    for number, bits in sides:
        out, size = out << bits | number, size + bits
    return assignment, (out << -size % 8).to_bytes(size + 7 >> 3, "big")


def _long_channels(part: np.ndarray) -> tuple[int, bytes]:
    channels = part.shape[1]
    sides, assignment = [_subframe_bits(part[:, c], 16) for c in range(channels)], channels - 1
    if channels == 2:
        side, mid = _subframe_bits(part[:, 0] - part[:, 1], 17), _subframe_bits(part[:, 0] + part[:, 1] >> 1, 16)
        pairs = {1: sides, 8: [sides[0], side], 9: [side, sides[1]], 10: [mid, side]}
        assignment = min(pairs, key=lambda k: sum(map(len, pairs[k])))
        sides = pairs[assignment]
    return assignment, np.packbits(np.concatenate(sides)).tobytes()


def _coded_number(n: int) -> bytes:
    """A frame's number as UTF-8 would write it, to 36 bits."""
    if n < 128:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << 5 * k + 6)
    return bytes([0xFF & 0xFF << 6 - more | n >> 6 * more] + [0x80 | n >> 6 * i & 63 for i in range(more - 1, -1, -1)])


def flac_bytes(x: np.ndarray, rate: int) -> bytes:
    """16-bit samples, of shape (n,) or (n, channels of 1 to 8), as a FLAC file."""
    x = _columns(x).astype(np.int64)
    frames, channels = [], x.shape[1] or 1
    for number, first in enumerate(range(0, len(x), BLOCK)):
        part = x[first : first + BLOCK]
        assignment, coded = (_short_channels if len(part) < SHORT else _long_channels)(part)
        head = bytes([0xFF, 0xF8, 0x70, assignment << 4 | 8]) + _coded_number(number) + struct.pack(">H", len(part) - 1)
        body = head + bytes([_crc8(head)]) + coded
        frames.append(body + struct.pack(">H", _crc16(body)))
    sizes = [len(f) for f in frames] or [0]
    packed = rate << 44 | channels - 1 << 41 | 15 << 36 | len(x)
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + _md5(x, 16)
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(frames)

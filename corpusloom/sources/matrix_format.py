"""Matrices and vectors of binary and text archives: a key, a space, and a value; compressed matrices too.

A binary value begins with NUL B and a name of its kind: FM and DM are matrices of floats and doubles, FV and DV vectors, CM a
matrix in one byte a value with four quantiles for each column, CM2 and CM3 matrices in two bytes and one byte of their whole
range. Fixed by the format: the names, the heads, and how quantiles share out the byte (LEVELS).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

LEVELS = np.array([0, 64, 192, 255])  # the bytes that stand for a column's least value, its quartiles and its greatest value
TOP = 65_535
#: Ways to compress, by number: the kind, and the least value and range where they are fixed. 1 is 2 for more than 8 rows, else 3.
METHODS = {2: ("CM", None), 3: ("CM2", None), 4: ("CM2", (-32768.0, 65535.0)), 5: ("CM3", None), 6: ("CM3", (0.0, 255.0)), 7: ("CM3", (0.0, 1.0))}
_PLAIN = {b"FM": "<f4", b"DM": "<f8", b"FV": "<f4", b"DV": "<f8"}


def _take(stream: BinaryIO, size: int) -> bytes:
    got = stream.read(size)
    if len(got) != size:
        raise ValueError("the archive ends within a value")
    return got


def _word(stream: BinaryIO) -> bytes:
    """What stands before the next blank; empty at the end of the stream."""
    out = bytearray()
    while (c := stream.read(1)) not in (b"", b" "):
        out += c
    if c == b"" and out.strip():
        raise ValueError("the archive ends within a key")
    return bytes(out)


def _count(stream: BinaryIO) -> int:
    size, n = struct.unpack("<bi", _take(stream, 5))
    if size != 4 or n < 0:
        raise ValueError("not a size")
    return n


def read_value(stream: BinaryIO) -> np.ndarray:
    """The value at the stream's place."""
    mark = stream.read(2)
    if mark != b"\0B":
        return _read_text(mark, stream)
    kind = _word(stream)
    if kind in _PLAIN:
        n = _count(stream)
        shape = (n, _count(stream)) if kind.endswith(b"M") else (n,)
        kind = np.dtype(_PLAIN[kind])
        return np.frombuffer(_take(stream, int(np.prod(shape)) * kind.itemsize), kind).reshape(shape)
    if kind not in (b"CM", b"CM2", b"CM3"):
        raise ValueError(f"values of kind {kind!r} are not read")
    least, width, rows, cols = struct.unpack("<ffii", _take(stream, 16))
    if kind != b"CM":
        size = 2 if kind == b"CM2" else 1
        codes = np.frombuffer(_take(stream, rows * cols * size), f"<u{size}").reshape(rows, cols)
        return (least + codes * (width / (256**size - 1))).astype(np.float32)
    marks = least + np.frombuffer(_take(stream, 8 * cols), "<u2").reshape(cols, 4) * (width / TOP)
    codes = np.frombuffer(_take(stream, rows * cols), np.uint8).reshape(cols, rows)
    return np.array([np.interp(c, LEVELS, m) for c, m in zip(codes, marks, strict=True)], np.float32).reshape(cols, rows).T


def _read_text(begun: bytes, stream: BinaryIO) -> np.ndarray:
    """A vector or matrix in brackets: rows end with their lines."""
    raw = bytearray(begun)
    while not raw.rstrip(b" ").endswith(b"]"):
        c = stream.read(1)
        if c == b"":
            raise ValueError("the archive ends within a value")
        raw += c
    if stream.read(1) not in (b"\n", b""):
        raise ValueError("not the end of a value")
    inner = re.fullmatch(r"\s*\[(.*)\]", raw.decode().rstrip(" "), re.DOTALL)
    if inner is None:
        raise ValueError("not an archive of matrices")
    rows = [r.split() for r in inner[1].split("\n") if r.strip()]
    if "\n" not in inner[1]:
        return np.array(rows[0] if rows else [], np.float32)
    return np.array(rows, np.float32)


def entries(stream: BinaryIO) -> Iterator[tuple[str, int, np.ndarray]]:
    """(key, offset of the value, value) of an archive from its beginning, one at a time."""
    while (key := _word(stream).lstrip(b"\n")) != b"":
        at = stream.tell()
        yield key.decode(), at, read_value(stream)


def file_entry(key: str, raw: bytes) -> tuple[bytes, int]:
    """An archive's entry that holds a whole file under the kind SF, and where in it the value begins."""
    name = _key(key)
    return name + b"\0BSF " + struct.pack("<bi", 4, len(raw)) + raw, len(name)


def read_file(stream: BinaryIO) -> bytes:
    """The file at the stream's place."""
    if stream.read(5) != b"\0BSF ":
        raise ValueError("not a file of an archive")
    return _take(stream, _count(stream))


def file_entries(stream: BinaryIO) -> Iterator[tuple[str, int, bytes]]:
    """entries() of an archive of files."""
    while (key := _word(stream)) != b"":
        at = stream.tell()
        yield key.decode(), at, read_file(stream)


def _codes(x: np.ndarray, top: int) -> np.ndarray:
    return np.floor(np.clip(x, 0, 1) * top + 0.499).astype(np.int64)


def _compressed(x: np.ndarray, kind: str, fixed: tuple[float, float] | None) -> bytes:
    rows, cols = x.shape
    low, high = (float(x.min()), float(x.max())) if x.size else (0.0, 0.0)
    least, width = fixed or (low, high - low if high > low else 1.0 + abs(low))
    least, width = float(np.float32(least)), float(np.float32(width))
    head = b"\0B" + kind.encode() + b" " + struct.pack("<ffii", least, width, rows, cols)
    share = (x.astype(np.float64) - least) / width
    if kind != "CM":
        top = TOP if kind == "CM2" else 255
        return head + np.floor(np.clip(share, 0, 1) * top + 0.5).astype("<u2" if kind == "CM2" else np.uint8).tobytes()
    # quantiles of each column, made to ascend strictly and to leave room for those above
    placed = np.sort(_codes(share, TOP), axis=0)
    at = [0, rows // 4, 3 * (rows // 4), rows - 1] if rows >= 5 else [min(i, rows - 1) for i in range(4)]
    marks = placed[at] if rows else np.zeros((4, cols), np.int64)
    for i in range(4):
        marks[i] = np.minimum(np.maximum(marks[i], marks[i - 1] + 1 if i else 0), TOP - 3 + i)
    column = least + marks * (width / TOP)
    codes = [np.floor(np.interp(x[:, c], column[:, c], LEVELS) + 0.5) for c in range(cols)]
    return head + marks.T.astype("<u2").tobytes() + np.array(codes).astype(np.uint8).tobytes()


def value_bytes(x: np.ndarray, method: int | None = None) -> bytes:
    """A float vector or matrix as a binary value. method: 1 to 7 compresses a matrix (METHODS); a vector is never compressed."""
    x = np.asarray(x, np.float32)
    if x.ndim == 1:
        return b"\0BFV " + struct.pack("<bi", 4, len(x)) + x.astype("<f4").tobytes()
    if method is not None:
        return _compressed(x, *METHODS[(2 if len(x) > 8 else 3) if method == 1 else method])
    return b"\0BFM " + struct.pack("<bibi", 4, x.shape[0], 4, x.shape[1]) + x.astype("<f4").tobytes()


def _key(key: str) -> bytes:
    if not key or re.search(r"\s", key):
        raise ValueError(f"{key!r} can't be a key")
    return key.encode() + b" "


def entry_bytes(key: str, x: np.ndarray, method: int | None = None) -> tuple[bytes, int]:
    """An archive's entry, and where in it the value begins."""
    name = _key(key)
    return name + value_bytes(x, method), len(name)

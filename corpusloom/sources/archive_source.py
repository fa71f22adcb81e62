"""Archives of matrices and sound files as a data source "corpus_archive", read by an index or as they are, and written with one.

    spark.read.format("corpus_archive").load("scp:/data/feats.scp")              # what an index (or a folder of indexes) names
    spark.read.format("corpus_archive").load("ark:/data/feats.1.ark")            # all of an archive (or of a folder of them)
    df.write.format("corpus_archive").option("compression_method", 2).mode("append").save("/data/feats")

An index has a line for each utterance: its id, and an archive with the byte at which the value begins, or a sound file. It is cut
into stretches of bytes, a task each, that seek in the archives they name, so that neither the index nor an archive passes
through the driver whole. An archive without an index has no such places and is one task. Sounds are a file each (filetype sound),
or files within archives of at most about ARCHIVE_BYTES (filetype sounds), so that millions of short ones are not as many files. A test of uttid or path by = or IN is
pushed down with option pushdown, which needs spark.sql.python.filterPushdown.enabled: values that are not asked for are not read.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import matrix_format, sound_format

FORMAT = "corpus_archive"
SCHEMA = "uttid string, path string, loc string, x array<array<float>>, rate double"
INDEX_BYTES = 1 << 20  # of an index in a task
ARCHIVE_BYTES = 64 << 20  # of an archive of sound files, after which the next begins: read without an index, each is a task
FILETYPES = ("mat", "sound", "sounds")
BATCH_VALUES = 4 << 20  # numbers in an Arrow batch
#: What needs an index: an order, or a look ahead.
NEEDS_INDEX = ("shuffle", "prefetch", "max_len")


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, or of a path on a file system that all machines share."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith(("file:", "/")) else (fs.LocalFileSystem(), uri)


def dispatched(rspecifier: str, options: dict[str, str]) -> tuple[str, str]:
    """(scp or ark, path) of a specifier, with the options that fit it."""
    kind, sep, path = rspecifier.partition(":")
    if not sep or kind not in ("scp", "ark") or not path:
        raise ValueError(f"{rspecifier}: give scp:<index> or ark:<archive>")
    if path == "-":
        raise ValueError("a cluster has no standard input to read from")
    if kind == "ark":
        if options.get("filetype", "mat") == "sound":
            raise ValueError("sound files are read by an index")
        asked = [o for o in NEEDS_INDEX if options.get(o, "false").lower() not in ("false", "", "0")]
        if asked:
            raise ValueError(f"without an index there is no {', '.join(asked)}")
    return kind, path


def _kinds(options: dict[str, str]) -> tuple[bool, bool]:
    """Whether values are sound files, and whether they are sound files within archives."""
    kind = options.get("filetype", "mat")
    if kind not in FILETYPES:
        raise ValueError(f"filetype {kind} is none of {', '.join(FILETYPES)}")
    return kind == "sound", kind == "sounds"


def _listed(path: str, ending: str) -> list[fs.FileInfo]:
    files, root = place(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.Directory:
        return sorted((f for f in files.get_file_info(fs.FileSelector(root)) if f.is_file and f.path.endswith(ending)), key=lambda f: f.path)
    if not info.is_file:
        raise FileNotFoundError(path)
    return [info]


@dataclass
class _Stretch(InputPartition):
    path: str
    first: int
    end: int


def rows_batch(rows: list[tuple[str, str, str, np.ndarray, float | None]]) -> pa.RecordBatch:
    """Rows of SCHEMA. A vector has one number a row."""
    x = [np.asarray(r[3], np.float32) for r in rows]
    x = [m[:, None] if m.ndim == 1 else m for m in x]
    wide = np.concatenate([np.full(len(m), m.shape[1], np.int64) for m in x])
    cells = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(wide)), pa.int32()), pa.array(np.concatenate([m.reshape(-1) for m in x])))
    frames = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(m) for m in x])), pa.int32()), cells)
    names = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
    return pa.RecordBatch.from_arrays([*names, frames, pa.array([r[4] for r in rows], pa.float64())], ["uttid", "path", "loc", "x", "rate"])


def batched(rows: Iterator[tuple[str, str, str, np.ndarray, float | None]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += r[3].size
        if size >= BATCH_VALUES:
            yield rows_batch(held)
            held, size = [], 0
    if held:
        yield rows_batch(held)


def without_rate(value: np.ndarray) -> tuple[np.ndarray, float | None]:
    """The value after its first row, which holds the rate (zero: none)."""
    return value[1:], (float(value.reshape(-1)[0]) or None) if value.size else None


class _Reader(DataSourceReader):
    def __init__(self, rspecifier: str, options: dict[str, str]):
        self.kind, self.path = dispatched(rspecifier, options)
        self.sound, self.packed = _kinds(options)
        self.rate_row = options.get("rate_row", "true").lower() == "true"
        self.index_bytes = int(options.get("index_bytes", INDEX_BYTES))
        self.wanted: dict[str, set[str]] = {}

    def _asked(self, uttid: str, path: str) -> bool:
        return all(v in self.wanted[k] for k, v in (("uttid", uttid), ("path", path)) if k in self.wanted)

    def partitions(self) -> list[_Stretch]:
        if self.kind == "ark":
            return [_Stretch(f.path, 0, f.size) for f in _listed(self.path, ".ark")] or [_Stretch("", 0, 0)]
        return [_Stretch(f.path, at, min(f.size, at + self.index_bytes)) for f in _listed(self.path, ".scp") for at in range(0, f.size, self.index_bytes)] or [_Stretch("", 0, 0)]

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return iter(())
        return batched(self._archive(partition) if self.kind == "ark" else self._named(partition))

    def _archive(self, part: _Stretch) -> Iterator[tuple]:
        files, _ = place(self.path)
        with files.open_input_stream(part.path, buffer_size=1 << 20) as f:
            for key, at, value in matrix_format.file_entries(_Counted(f)) if self.packed else matrix_format.entries(_Counted(f)):
                if not self._asked(key, part.path):
                    continue
                if self.packed:
                    rate, samples = sound_format.decode(value)
                    yield key, part.path, str(at), samples, float(rate)
                else:
                    yield key, part.path, str(at), *(without_rate(value) if self.rate_row else (value, None))

    def _named(self, part: _Stretch) -> Iterator[tuple]:
        files, _ = place(self.path)
        folder, open_path, held = posixpath.dirname(part.path), None, None
        for line in _lines(files, part):
            uttid, _, spec = line.partition(" ")
            spec = spec.strip()
            path, loc = (spec, "") if self.sound else _split_spec(spec)
            path = path if "://" in path or path.startswith("/") else posixpath.join(folder, path)
            if not self._asked(uttid, path):
                continue
            if path != open_path:
                if held is not None:
                    held.close()
                at_files, at = place(path) if "://" in path else (files, path)
                held, open_path = at_files.open_input_file(at), path
            if self.sound:
                rate, value = sound_format.decode(held.read())
                open_path = None
                yield uttid, path, loc, value, float(rate)
            else:
                held.seek(int(loc or 0))
                if self.packed:
                    rate, value = sound_format.decode(matrix_format.read_file(held))
                    yield uttid, path, loc, value, float(rate)
                    continue
                value = matrix_format.read_value(held)
                yield uttid, path, loc, *(without_rate(value) if self.rate_row else (value, None))
        if held is not None:
            held.close()


class _FilteredReader(_Reader):
    """Spark refuses a reader that takes filters in a session without spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("uttid",), ("path",)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                (name,) = f.attribute
                self.wanted[name] = self.wanted.get(name, asked) & asked
            else:
                yield f


class _Counted:
    """A stream that knows how many bytes were read of it."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def read(self, n: int) -> bytes:
        got = self.stream.read(n)
        self.at += len(got)
        return got

    def tell(self) -> int:
        return self.at


def _split_spec(spec: str) -> tuple[str, str]:
    found = re.fullmatch(r"(.+):(\d+)", spec)
    return (found[1], found[2]) if found else (spec, "")


def _lines(files: fs.FileSystem, part: _Stretch) -> Iterator[str]:
    """The lines of an index that begin in a stretch of its bytes."""
    with files.open_input_file(part.path) as f:
        f.seek(max(0, part.first - 1))
        text = io.BufferedReader(_Raw(f), 1 << 16)
        at = part.first
        if part.first:
            at += len(text.readline()) - 1
        while at < part.end:
            line = text.readline()
            if not line:
                return
            at += len(line)
            if line.strip():
                yield line.decode().rstrip("\r\n")


class _Raw(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.stream.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


@dataclass
class _Written(WriterCommitMessage):
    index: str
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """A task writes one archive, or a sound file for each row, and an index that the commit gives its name."""

    def __init__(self, path: str, options: dict[str, str]):
        self.path = path.rstrip("/")
        self.sound, self.packed = _kinds(options)
        self.pcm = options.get("pcm_format", "wav")
        self.method = int(options["compression_method"]) if "compression_method" in options else None
        self.rate_row, self.absolute = options.get("rate_row", "true").lower() == "true", options.get("absolute", "false").lower() == "true"
        if self.pcm not in ("wav", "flac"):
            raise ValueError(f"sound files of kind {self.pcm} are not written")
        if self.method is not None and self.method != 1 and self.method not in matrix_format.METHODS:
            raise ValueError(f"there is no compression method {self.method}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = place(self.path)
        files.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        base, named, lines = (f"{root}/" if self.absolute else ""), [], files.open_output_stream(f"{root}/{name}.scp.tmp")
        with lines:
            made = self._sounds(files, root, iterator) if self.sound else self._packed(files, f"{root}/{name}", iterator) if self.packed else None
            for uttid, line, path in made or self._matrices(files, f"{root}/{name}.ark", iterator):
                lines.write(f"{uttid} {base}{line}\n".encode())
                if path not in named[-1:]:
                    named.append(path)
        return _Written(f"{root}/{name}.scp", named)

    def _matrices(self, files: fs.FileSystem, path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str]]:
        at = 0
        with files.open_output_stream(path) as out:
            for uttid, x, rate in _values(batches):
                if self.rate_row:
                    x = np.concatenate([np.full((1, *x.shape[1:]), rate or 0, np.float32), x])
                raw, begins = matrix_format.entry_bytes(uttid, x, self.method)
                out.write(raw)
                yield uttid, f"{posixpath.basename(path)}:{at + begins}", path
                at += len(raw)

    def _sounds(self, files: fs.FileSystem, root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str]]:
        write = sound_format.flac_bytes if self.pcm == "flac" else sound_format.wave_bytes
        for uttid, x, rate in _values(batches):
            name = f"{quote(uttid, safe='')}.{self.pcm}"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(write(x.astype(np.int16), int(rate)))
            yield uttid, name, f"{root}/{name}"

    def _packed(self, files: fs.FileSystem, base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str]]:
        write = sound_format.flac_bytes if self.pcm == "flac" else sound_format.wave_bytes
        out, number, at = None, 0, 0
        try:
            for uttid, x, rate in _values(batches):
                if out is None:
                    path, at, number = f"{base}-{number:05d}.ark", 0, number + 1
                    out = files.open_output_stream(path)
                raw, begins = matrix_format.file_entry(uttid, write(x.astype(np.int16), int(rate)))
                out.write(raw)
                yield uttid, f"{posixpath.basename(path)}:{at + begins}", path
                at += len(raw)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()

    def commit(self, messages: list[_Written | None]) -> None:
        files, _ = place(self.path)
        for m in messages:
            if m is not None:
                files.move(f"{m.index}.tmp", m.index)

    def abort(self, messages: list[_Written | None]) -> None:
        files, _ = place(self.path)
        for m in messages:
            for path in [] if m is None else [f"{m.index}.tmp", *m.files]:
                files.delete_file(path)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, float | None]]:
    """(uttid, x, rate) of batches; rows of unequal length are an error."""
    for batch in batches:
        names, rates, column = batch.column("uttid").to_pylist(), batch.column("rate").to_pylist(), batch.column("x")
        if column.null_count or column.values.null_count:
            raise ValueError("a matrix, or a row of it, is null")
        rows, inner = column.offsets.to_numpy(), column.values
        ends = inner.offsets.to_numpy()[rows].tolist()  # where the numbers of a matrix begin and end
        cells, counts = inner.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False), np.diff(rows).tolist()
        for uttid, rate, n, first, end in zip(names, rates, counts, ends, ends[1:], strict=False):
            yield uttid, cells[first:end].reshape(n, -1) if n else np.zeros((0, 0), np.float32), rate


class CorpusArchive(DataSource):
    """Options when reading: filetype (mat, sound or sounds), rate_row, index_bytes, pushdown; when writing: filetype, pcm_format (wav or flac), compression_method (1 to 7), rate_row, absolute (whole paths in the index)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _FilteredReader if self.options.get("pushdown", "false").lower() == "true" else _Reader
        return kind(self.options["path"], dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(CorpusArchive)

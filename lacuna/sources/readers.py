"""Data sources in Python for files that Spark's own readers take whole: prefixes of waveforms and digests, in buffers of a fixed size.

``register(spark)`` makes both formats known to a session:

* ``wave_prefix``: the first seconds of regularly sampled waveforms, ``MOST_WAVES`` files a partition. The first two samples give start and interval; reading stops at the end.
* ``file_digest``: path relative to a root, bytes and SHA-256 of every file below it, files dealt into partitions by size. Links that lead out of the root are left out.

Files are listed and read through ``pyarrow.fs``: local paths, file:// and the stores it knows by their URI.
"""

from __future__ import annotations

import hashlib
import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BUFFER = 64 << 10
DIGEST_BUFFER = 1 << 20
#: Files of a partition, and their bytes; a larger file is a partition of its own.
MOST_FILES, MOST_BYTES = 1000, 256 << 20
#: Of waveforms a prefix is read only, whatever their size.
MOST_WAVES = 250


def register(spark: SparkSession) -> None:
    for source in (WavePrefix, FileDigest):
        spark.dataSource.register(source)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def listed(path: str) -> tuple[fs.FileSystem, str, list[fs.FileInfo]]:
    """All files at or below a path, in the order of their names."""
    store, root = opened(path)
    one = store.get_file_info(root)
    if one.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [one] if one.is_file else [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file]
    return store, root, sorted(every, key=lambda x: x.path)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class Lines:
    """Lines of a plain or gzip text file as they are asked for; ``read`` counts the bytes taken from the file."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.source = store.open_input_stream(path, compression=None)
        self.read = 0

    def __iter__(self) -> Iterator[bytes]:
        inflate, rest = None, b""
        while data := self.source.read(BUFFER):
            if not self.read:
                inflate = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
                begin = True
            self.read += len(data)
            text = b""
            while inflate and data:
                text += inflate.decompress(data)
                data = inflate.unused_data if inflate.eof else b""
                inflate = zlib.decompressobj(31) if inflate.eof else inflate
            text = text or data
            if begin and text:
                text, begin = text.removeprefix(b"\xef\xbb\xbf"), False
            *whole, rest = (rest + text).split(b"\n")
            yield from whole
        if rest:
            yield rest

    def close(self) -> None:
        self.source.close()


def cells(line: bytes) -> tuple[float, float]:
    """The first two columns as numbers, NaN for text that is none."""
    found = []
    for x in [*line.split(b","), b""][:2]:
        try:
            found.append(float(x.strip(b'" \r')))
        except ValueError:
            found.append(math.nan)
    return found[0], found[1]


class WavePrefix(DataSource):
    """Options: path; seconds (from a file's first sample) or end (on the file's clock); most_interval (1 second).

    Columns: file (relative to the path), idx, sec = start + idx * interval, value (NULL for text that is no number), read_bytes (of the file so far).
    A header comes first; a file of no samples has no rows, and one of a single sample, or whose interval is not in (0, most_interval], is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "wave_prefix"

    def schema(self) -> str:
        return "file string, idx long, sec double, value double, read_bytes long"

    def reader(self, schema) -> DataSourceReader:
        return WavePrefixReader(dict(self.options))


class WavePrefixReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.seconds = float(options["seconds"]) if "seconds" in options else None
        self.end = float(options["end"]) if "end" in options else None
        if (self.seconds is None) == (self.end is None):
            raise ValueError("wave_prefix needs either seconds or end")
        self.most = float(options.get("most_interval", 1))

    def partitions(self) -> list[InputPartition]:
        paths = [x.path for x in listed(self.path)[2] if not os.path.basename(x.path).startswith(("_", "."))]
        return [Files(tuple(paths[k : k + MOST_WAVES])) for k in range(0, len(paths), MOST_WAVES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, root = opened(self.path)
        for path in partition.paths:
            yield from self.prefix(store, root, path)

    def prefix(self, store: fs.FileSystem, root: str, path: str) -> Iterator[tuple]:
        name = os.path.relpath(path, root) if path != root else os.path.basename(path)
        lines = Lines(store, path)
        try:
            samples = (x for k, x in enumerate(x for x in lines if x.strip()) if k)
            head = [cells(x) for _, x in zip(range(2), samples)]  # noqa: B905
            if len(head) == 1:
                raise ValueError(f"{name} has one sample and no interval")
            if not head:
                return
            start, interval = head[0][0], head[1][0] - head[0][0]
            if not 0 < interval <= self.most:
                raise ValueError(f"sampling interval of {name} outside (0, {self.most:g}]: {interval:g}")
            limit = self.end if self.seconds is None else start + self.seconds
            for idx in range(1 << 62):
                sec = start + idx * interval
                if sec >= limit:
                    return
                if idx < 2:
                    value = head[idx][1]
                elif (line := next(samples, None)) is not None:
                    value = cells(line)[1]
                else:
                    return
                yield name, idx, sec, None if math.isnan(value) else value, lines.read
        finally:
            lines.close()


class FileDigest(DataSource):
    """Option: path, the root. Links that lead out of it are left out. Columns: name (relative to the root), bytes, sha256."""

    @classmethod
    def name(cls) -> str:
        return "file_digest"

    def schema(self) -> str:
        return "name string, bytes long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return FileDigestReader(self.options["path"])


class FileDigestReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, root, files = listed(self.path)
        if isinstance(store, fs.LocalFileSystem):
            inside = os.path.realpath(root)
            files = [x for x in files if os.path.realpath(x.path) == inside or os.path.realpath(x.path).startswith(inside.rstrip("/") + "/")]
        parts: list[list[str]] = []
        held = 0
        for x in files:
            if not parts or len(parts[-1]) == MOST_FILES or held + x.size > MOST_BYTES:
                parts.append([])
                held = 0
            parts[-1].append(x.path)
            held += x.size
        return [Files(tuple(p)) for p in parts]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, root = opened(self.path)
        for path in partition.paths:
            digest, size = hashlib.sha256(), 0
            with store.open_input_stream(path, compression=None) as source:
                while data := source.read(DIGEST_BUFFER):
                    digest.update(data)
                    size += len(data)
            yield os.path.relpath(path, root) if path != root else os.path.basename(path), size, digest.hexdigest()

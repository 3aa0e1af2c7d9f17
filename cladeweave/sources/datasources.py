"""Spark data sources in Python: lines of block-gzipped files, split at their blocks, and HDF5 matrices, split at their chunks.

Files are opened by pyarrow's file systems, which know file, hdfs, s3 and gs addresses, on
the executor that reads a part; the driver reads sizes and heads only.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 8 << 20
#: A block of a block-gzipped file: a gzip member of at most 64 KB that says its own size in an extra field.
_MAGIC, _MOST = b"\x1f\x8b\x08\x04", 1 << 16


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of an address or a local path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of a file, or of the files of a folder but hidden ones."""
    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == arrow_fs.FileType.Directory:
        every = system.get_file_info(arrow_fs.FileSelector(inner))
        return sorted((i.path, i.size) for i in every if i.type == arrow_fs.FileType.File and i.base_name[0] not in "._")
    if info.type != arrow_fs.FileType.File:
        raise FileNotFoundError(path)
    return [(info.path, info.size)]


def block_size(head: bytes) -> int:
    """The size of the block that begins here, 0 where none does."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return 0
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, 12 + extra
    while at + 4 <= min(end, len(head)):
        name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def is_blocked(path: str) -> bool:
    """Whether a path holds block-gzipped files that these file systems open."""
    try:
        system, _ = file_system(path)
        return all(block_size(system.open_input_file(p).read(64)) for p, size in _files(path) if size)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False


@dataclass
class Part(InputPartition):
    path: str
    lo: int
    hi: int


class Blocks:
    """The blocks of a file from the first one that begins at `at` or behind it."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size = file, size
        self.at = at if at == 0 else self._found(at)

    def _found(self, at: int) -> int:
        data = self.file.read_at(min(2 * _MOST + 64, self.size - at), at)
        k = data.find(_MAGIC)
        while k >= 0:
            n = block_size(data[k : k + 64])
            # what looks like a head is one if another block or the end follows
            if n and (at + k + n == self.size or block_size(self.file.read_at(min(64, self.size - at - k - n), at + k + n))):
                return at + k
            k = data.find(_MAGIC, k + 1)
        return self.size

    def next(self) -> bytes:
        n = block_size(self.file.read_at(min(64, self.size - self.at), self.at))
        if not n:
            raise ValueError(f"no block at {self.at}")
        data = self.file.read_at(n, self.at)
        self.at += n
        return zlib.decompress(data, 31)  # checks the block's sum


def lines_of(file, size: int, lo: int, hi: int):
    """Lines that begin behind the first line end of the blocks from lo (all, from 0) up to the first line end behind hi: each line of the file falls to one part."""
    blocks, tail, skip = Blocks(file, size, lo), b"", lo > 0
    while blocks.at < size:
        late = blocks.at >= hi
        data = tail + blocks.next()
        if skip:
            cut = data.find(b"\n")
            if cut < 0:
                if late:
                    return  # a line that began before and ends behind this part
                tail = b""
                continue
            if late:
                return
            data, skip = data[cut + 1 :], False
        if late:
            cut = data.find(b"\n")
            if cut >= 0:
                yield data[:cut]
                return
            tail = data
            continue
        *whole, tail = data.split(b"\n")
        yield from whole
    if tail and not skip:
        yield tail


class _LinesReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self):
        return [Part(p, lo, min(lo + self.split, size)) for p, size in _files(self.path) for lo in range(0, size, self.split)]

    def read(self, part: Part):
        system, _ = file_system(self.path)
        with system.open_input_file(part.path) as file:
            held, n = [], 0
            for line in lines_of(file, file.size(), part.lo, part.hi):
                held.append(line.removesuffix(b"\r"))
                n += len(line)
                if n > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], ["value"])
                    held, n = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], ["value"])


class BlockedLines(DataSource):
    """value: the lines of block-gzipped files. Options: path, split (bytes of a part)."""

    @classmethod
    def name(cls) -> str:
        return "blocked_lines"

    def schema(self) -> str:
        return "value STRING"

    def reader(self, schema) -> DataSourceReader:
        return _LinesReader(self.options["path"], int(self.options.get("split", SPLIT)))


class _MatrixReader(DataSourceReader):
    def __init__(self, path: str, columns: int):
        self.path, self.columns = path, columns

    def partitions(self):
        import h5py

        system, inner = file_system(self.path)
        with system.open_input_file(inner) as file, h5py.File(file, "r") as f:
            snps = f["snps"]
            chunk = snps.chunks[1] if getattr(snps, "chunks", None) else 1
            step = max(1, self.columns // chunk) * chunk  # whole chunks, so none is read twice
            return [Part(inner, lo, min(lo + step, snps.shape[1])) for lo in range(0, snps.shape[1], step)]

    def read(self, part: Part):
        import h5py

        system, _ = file_system(self.path)
        with system.open_input_file(part.path) as file, h5py.File(file, "r") as f:
            block, locus = f["snps"][:, part.lo : part.hi].astype("int32"), f["snpsmap"][part.lo : part.hi, 0].astype("int64") - 1
        k = block.shape[1]
        for i, row in enumerate(block):
            columns = [np.full(k, i, np.int32), locus, np.arange(part.lo, part.lo + k, dtype=np.int64), row]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sample_idx", "locus", "site", "base"])


class Hdf5Matrix(DataSource):
    """sample_idx, locus (from 0), site, base of a SNP file with /snps (samples x sites) and /snpsmap (locus from 1 first). Options: path, columns (sites of a part, rounded to whole chunks)."""

    @classmethod
    def name(cls) -> str:
        return "snps_hdf5"

    def schema(self) -> str:
        return "sample_idx INT, locus BIGINT, site BIGINT, base INT"

    def reader(self, schema) -> DataSourceReader:
        return _MatrixReader(self.options["path"], int(self.options.get("columns", 4096)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockedLines)
    spark.dataSource.register(Hdf5Matrix)

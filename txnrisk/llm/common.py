"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import txnrisk
from txnrisk.sources.scratch import scratch_root

#: Bytes of text that a worker turns into Python objects at a time.
SLICE_BYTES = 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers that don't start in this folder."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(txnrisk.__file__)))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "txnrisk_llm"), "zip", root, "txnrisk")
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def utf8(name: str) -> Column:
    """A text column as its UTF-8 bytes; null as no bytes."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def remainder(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id's decimal digits, modulo ``modulus``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % modulus


def release() -> None:
    """Give free memory back to the system: a worker goes on to other tasks, and others run beside it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


_kept: list = []


def kept(load):
    """A loader whose last result a worker keeps for its next tasks."""
    cached = functools.lru_cache(maxsize=1)(load)
    _kept.append(cached)
    return cached


def keep_only(mine=None) -> None:
    """Drop what other operators' loaders keep: a worker that is used again serves one of them at a time."""
    for cached in _kept:
        if cached is not mine:
            cached.cache_clear()
    release()


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches so that no slice has more than ``limit`` bytes of ``text``, one row
    at least; yields each slice with its texts."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = 0
        while start < batch.num_rows:
            size, stop = 0, start
            texts: list[bytes] = []
            while stop < batch.num_rows:
                value = column[stop].as_py() or b""
                if texts and size + len(value) > limit:
                    break
                texts.append(value)
                size += len(value)
                stop += 1
            yield batch.slice(start, stop - start), texts
            start = stop
    release()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared scratch folder, as a URI or path that tasks can open."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    fs, inner = opened(path)
    fs.create_dir(inner, recursive=True)
    return path


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


class AtomicFile:
    """A file that appears under its name only when it is complete, so a lost or repeated
    task leaves no half-written file behind."""

    def __init__(self, path: str):
        self.path = path
        self._fs, self._to = opened(path)
        self._tmp = f"{self._to}.{uuid.uuid4().hex}.tmp"
        self._out = self._fs.open_output_stream(self._tmp)
        self.size = 0
        self.crc = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)
        self.crc = zlib.crc32(data, self.crc)

    def commit(self) -> None:
        self._out.close()
        self._fs.move(self._tmp, self._to)

    def abort(self) -> None:
        self._out.close()
        self._fs.delete_file(self._tmp)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a small table of work items over the cluster."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key)

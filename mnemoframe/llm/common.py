"""Shared pieces: table reading, shared-folder tables, and numpy kernels over Arrow text columns.

The kernels work on the UTF-8 bytes of many texts at once. Words are runs of bytes other than space and \\t..\\r, as in
``[^\\x20\\x09-\\x0D]+``; a word's hash is a keyed polynomial of its bytes, the same in every process.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
BITMAP_CELLS, MAP_CELLS = 1 << 25, 1 << 15  # a bitmap of Spark has 2 ** 15 cells
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_KEY = np.random.Generator(np.random.PCG64(20240131)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the workers, once for each application, so they need no path of the driver's machine."""
    if spark.sparkContext.applicationId not in _SHIPPED:
        _SHIPPED.add(spark.sparkContext.applicationId)
        top = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp()  # the driver serves the file from here as long as it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/mnemoframe_workers.zip", "w") as out:
            for file in sorted(top.glob("mnemoframe/**/*.py")):
                out.write(file, file.relative_to(top))
        spark.sparkContext.addPyFile(out.filename)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set (single-machine tests), one is set under /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = "file:///tmp/mnemoframe-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/mnemoframe-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hpath)
    fs.deleteOnExit(hpath)
    return path


def stored(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so a lost executor costs no recomputation.

    by: a column of few values, each in a folder of its own, so that a reader of one value reads no other.
    """
    path = new_folder(df.sparkSession, tag)
    writer = df.write.mode("overwrite")
    if by:
        key = "spark.sql.maxConcurrentOutputFileWriters"  # else a task sorts its rows
        before = df.sparkSession.conf.get(key, None)
        df.sparkSession.conf.set(key, "64")
        try:
            writer.partitionBy(by).parquet(path)
        finally:
            df.sparkSession.conf.set(key, before) if before is not None else df.sparkSession.conf.unset(key)
    else:
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/mnemoframe-" in file:
            hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def perhaps_among(rows: DataFrame, keys: list[str | Column], wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose keys may be among those of ``wanted`` (columns in the order of ``keys``), or with ``left_anti`` those that are not.

    By a bitmap of the keys' hashes of fixed size, which is sent to all tasks: rows of long texts that a join would not keep need not be
    shuffled for it. Many keys fill the bitmap, so that more rows pass; an exact join must follow.
    """
    at, bits = (next(f"_{name}{k}" for k in range(len(rows.columns) + 1) if f"_{name}{k}" not in rows.columns) for name in ("map", "bits"))
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(BITMAP_CELLS))
    cells = wanted.select(place(wanted.columns).alias("cell")).select(F.floor(F.col("cell") / MAP_CELLS).alias(at), (F.col("cell") % MAP_CELLS).alias("bit"))
    maps = cells.groupBy(at).agg(F.bitmap_construct_agg("bit").alias(bits))
    cell = place(keys)
    byte = F.conv(F.hex(F.substring(bits, F.floor(cell % MAP_CELLS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (cell % 8).cast("int")) == 1
    return rows.join(F.broadcast(maps), (F.floor(cell / MAP_CELLS) == F.col(at)) & held, how)


def give_back() -> None:
    """At the end of a task: memory that Arrow's and C's allocators hold for later goes back, as Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts; a null is an empty text."""
    arr = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """The words of rows lo..hi of a text buffer: byte range, row (from 0) and hash of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = False):
        base = int(offsets[lo])
        self.buf = data[base : int(offsets[hi])]
        self.offsets = offsets[lo : hi + 1] - base
        self.n_rows = hi - lo
        solid = ~WORD_SPACE[self.buf]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = self.offsets[1:-1]
        inner = inner[inner < len(self.buf)]
        first[inner] |= solid[inner]  # a text's first byte begins a word whatever the text before it ends with
        self.start = np.flatnonzero(first)
        body = np.flatnonzero(solid)
        rank = np.searchsorted(body, self.start)  # where each word begins among the solid bytes
        self.length = np.diff(np.append(rank, len(body)))
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        self.counts = np.bincount(self.row, minlength=self.n_rows)
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        if len(self.start):
            chars = self.buf[body]
            if lower:
                chars = LOWER[chars]
            at = np.arange(len(body)) - np.repeat(rank, self.length)
            with np.errstate(over="ignore"):
                power = np.cumprod(np.full(int(self.length.max()) + 1, _BASE))
                self.hash = mix(np.add.reduceat(_BYTE_KEY[chars] * power[at], rank) + self.length.astype(np.uint64))
            self.n_chars = np.add.reduceat(((chars & 0xC0) != 0x80).astype(np.int64), rank)
        else:
            self.hash = np.zeros(0, np.uint64)
            self.n_chars = np.zeros(0, np.int64)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` words; a row with fewer words, but one at least, gives its whole sequence."""
    n = len(words.hash)
    keys = mix(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    with np.errstate(over="ignore"):
        rows, hashes = [], []
        if n >= width:
            acc = np.zeros(n - width + 1, np.uint64)
            for k in range(width):
                acc += words.hash[k : n - width + 1 + k] * keys[k]
            whole = words.row[: n - width + 1] == words.row[width - 1 :]
            rows.append(words.row[: n - width + 1][whole])
            hashes.append(mix(acc[whole]))
        for r in np.flatnonzero((words.counts > 0) & (words.counts < width)):
            w = words.hash[words.firsts[r] : words.firsts[r + 1]]
            rows.append(np.array([r]))
            hashes.append(mix(np.array([(w * keys[: len(w)]).sum() + np.uint64(len(w))], np.uint64)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)


def distinct_by_row(rows: np.ndarray, values: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """Sorted distinct values of each row."""
    order = np.argsort(rows, kind="stable")
    values = values[order]
    ends = np.cumsum(np.bincount(rows, minlength=n_rows))
    return [np.unique(values[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]

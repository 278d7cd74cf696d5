"""What the operators of this subpackage share: column picking, staged tables, and hashing of words in numpy.

Words are the runs of bytes other than 0x20 and 0x09-0x0D. They are found and hashed on whole Arrow buffers, a few
megabytes at a time, so that memory doesn't depend on how many rows an Arrow batch holds. Word hashes have 64 bits.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once in numpy, and rows.
SLICE_BYTES, SLICE_ROWS = 1 << 19, 1 << 15
#: White space, as the contracts of this subpackage define it.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: Whether Spark deletes the files that a write or query of this session has shuffled when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

MASK = (1 << 64) - 1
U = np.uint64


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, the first of each; other columns may have any names, also ones that clash."""
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one is made and set only where that setting is absent, and all run on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="trellis-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: For tables with rows of megabytes: the writer looks at its buffer after each row, not each hundred, and ends a row group at 8 MB.
#: Neither it nor the reader, whose batches end with row groups, then holds more than a few rows, however many a task has.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: later jobs start there, whatever executors are lost.

    Files that the write has shuffled go as soon as it is done; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trellis/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more: another has taken its place."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/trellis/" not in folder:
            raise ValueError(f"{folder} isn't a staged table")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def released() -> None:
    """Gives freed memory back to the system: Python workers live on after a task, beside those of the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finalizer of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return splitmix((np.arange(n, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed & MASK))


BASE = 0x9E3779B97F4A7C15 | 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = _seeded(256, 0x5EED)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(of: int, n: int) -> np.ndarray:
    """of**0 .. of**(n-1) modulo 2**64, kept between calls but for those of parts longer than a slice."""
    if (kept := _powers.get(of)) is not None and n <= len(kept):
        return kept[:n]
    steps = np.full(max(n, SLICE_BYTES + 1), U(of))
    steps[0] = U(1)
    out = np.multiply.accumulate(steps)
    if n <= SLICE_BYTES + 1:
        _powers[of] = out
    return out[:n]


class Texts:
    """Texts that lie one after another in a buffer of bytes. offsets has one more entry than there are texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, lower: bool = False, apart: np.ndarray = IS_SPACE) -> "Words":
        data = LOWER[self.data] if lower else self.data
        n = len(data)
        inside = np.zeros(n + 2, bool)
        np.logical_not(apart[data], out=inside[1:-1])
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        return Words(data, starts, ends, np.searchsorted(starts, self.offsets))


class Words:
    """Words of texts: byte ranges in data; text i has the words first[i] to first[i + 1]."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> None:
        self.data, self.starts, self.ends, self.first = data, starts, ends, first

    def hashes(self) -> np.ndarray:
        """A hash of each word; those of a longer text are computed slice by slice, so that memory follows the longest word."""
        out, at = np.empty(len(self.starts), U), 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + SLICE_BYTES, side="right")))
            out[at:to] = self._hashes(self.starts[at:to], self.ends[at:to])
            at = to
        return out

    def _hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        data = self.data[starts[0] : ends[-1]]
        starts, ends, n = starts - starts[0], ends - starts[0], len(data)
        with np.errstate(over="ignore"):
            sums = np.empty(n + 1, U)
            sums[0] = 0
            np.cumsum(BYTE_VALUES[data] * powers(BASE, n), out=sums[1:])
            h = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, n + 1)[starts]
            return splitmix(h + (ends - starts).astype(U) * U(0xD1B54A32D192ED03))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive entries of h; those at text borders are the caller's to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        total = np.zeros(n, U)
        for j, c in enumerate(_seeded(k, 0xA11CE + seed)):
            total += h[j : j + n] * (c | U(1))
        return splitmix(total)


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(first row, texts) of runs of rows of at most most bytes, or of one longer row, and of SLICE_ROWS at most. A null text is an empty one."""
    array = batch.column(batch.schema.get_field_index(column))
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.binary() if pa.types.is_string(array.type) else pa.large_binary()).cast(pa.large_binary())
    n = len(array)
    if not n:
        return
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1), at + SLICE_ROWS)
        yield at, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An integer column without nulls."""
    return column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())

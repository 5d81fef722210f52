"""Shared pieces of the training-data operators: tables, scratch storage and vectorised text hashing."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step works on; larger texts are a step of their own.
CHUNK_BYTES = 1 << 18


#: Rows of an Arrow batch: texts of a few kB each make batches of a few MB, in the JVM and in Python.
BATCH_ROWS = 1000
# memory that a batch needed goes back to the system, not to a pool of the worker's
pa.set_memory_pool(pa.system_memory_pool())
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def give_back() -> None:
    """What this process has freed goes back to the system."""
    if _trim:
        _trim(0)


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """step, such that a task's worker gives back at the end what it has freed; workers are kept through later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is named and all tasks run in this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{os.getpid()}"


#: Removes the shuffle files of a query at its end, so that they don't lie on disk beside those that follow.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df to the shared scratch folder and reads it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    path = f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialise has written, once all that reads them is itself written."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            _delete(t.sparkSession, path)


def written() -> tuple[str, ...]:
    """Tables that this process has written and not removed."""
    return tuple(_written)


def discard_since(spark: SparkSession, before: tuple[str, ...], *keep: DataFrame) -> None:
    """Removes what materialise has written since written() gave before, keep aside."""
    kept = {*before, *(getattr(t, "_scratch", None) for t in keep)}
    for path in [p for p in _written if p not in kept]:
        _delete(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Removes all tables that materialise has written; results that still read them must have been stored before."""
    _delete(spark, f"{scratch_dir(spark)}/tables")
    _written.clear()


def spread(spark: SparkSession) -> int:
    """Partitions for a shuffle by key."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- vectorised text hashing ---------------------------------------------------------------------

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240517))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The separators of a word are space and \x09-\x0D.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * CHUNK_BYTES)
        steps = np.full(size, _P, dtype=np.uint64)
        steps[0] = 1
        _pow = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = _U(pow(int(_P), -1, 2**64))
        _inv = np.cumprod(steps, dtype=np.uint64)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = hash of data[i:j] times P**i."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data))[0], out=out[1:])
    return out


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for runs of rows with about limit bytes together."""
    data, offsets = text_column(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


#: Of runs of letters: a-z (A-Z lower-cased) and all bytes of other scripts.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NONSPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and 64-bit hashes of the words (runs of bytes of a kind, A-Z lower-cased); bounds: the first word of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    h = prefix_hash(LOWER[data])
    hashes = mix((h[ends] - h[starts]) * powers(n + 1)[1][starts])
    return starts, ends, hashes, np.searchsorted(starts, offsets)

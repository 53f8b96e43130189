"""Helpers that the training-data operators share: staging, size-checked broadcasts, batch text arrays."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table is broadcast; larger ones go through a shuffled join.
BROADCAST_ROWS = 20_000
#: Bytes of text that one numpy chunk holds (a longer single text makes a chunk of its own).
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch: both an executor's JVM and its Python workers hold a batch at once.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Words as the contamination and license scans take them: runs of 0-9, a-z and non-ASCII (after A-Z is lowered).
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. In local mode, where driver and executors are one process, a temporary one will do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there, and lost executors cost no upstream work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A staged lookup table, marked for broadcast only if it has at most `limit` rows."""
    small = staged(table, "lookup")
    return F.broadcast(small) if small.count() <= limit else small


def tidy(spark: SparkSession) -> None:
    """Between the rounds of a long loop: Spark drops broadcasts and shuffles once the driver's collector has found their plans unused, and Python's references keep plans alive until its own collector has run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores before it until it clashes with no column (Spark's names ignore case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


# ---- numpy side: whole Arrow batches as byte arrays ----


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets) of consecutive rows with about `limit` bytes each; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_binary():
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


_B = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^k and B^-k modulo 2^64 for k < n; B is odd, so it has an inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _B), ("down", pow(_B, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same for the same bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at row borders."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(inside) + 1, bool)
    border[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | border[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | border[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, np.int64 if flags.dtype.kind in "bui" else np.float64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


#: What a worker keeps between tasks, by name.
KEPT: dict[str, object] = {}


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system, as the worker lives on beside the next stage's executor."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def forget(uses: tuple[str, ...]) -> None:
    """Drops what the worker keeps, but for what is used now."""
    for name in KEPT.keys() - set(uses):
        del KEPT[name]


def frugal(run, uses: tuple[str, ...] = ()):
    """run (batches to batches), with its memory released when a task ends; what the worker has kept for other operators goes when one begins."""

    def wrapped(batches):
        forget(uses)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, unless their PYTHONPATH has it already; and has Arrow batches of at most BATCH_BYTES, unless the cluster sets that."""
    if not spark.sparkContext.getConf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    if str(root) in map(os.path.abspath, os.environ.get("PYTHONPATH", "").split(os.pathsep)) or getattr(spark.sparkContext, "_tidewell_sent", False):
        return
    # the driver serves the archive for as long as the session lives
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/tidewell", "zip", root, "tidewell"))
    spark.sparkContext._tidewell_sent = True

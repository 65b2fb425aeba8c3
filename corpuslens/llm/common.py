"""Helpers that several operators share: scratch tables, Arrow batches, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at a time inside a Python task; bounds its memory.
BLOCK_BYTES = 4 << 20
#: Largest batch of rows that passes between Spark and a Python task.
BATCH_BYTES = 8 << 20
#: Rows of a key from which on it is heavy; more, if heavy keys are too many to be broadcast.
HEAVY_ROWS, BROADCAST_BYTES = 1000, 32 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, a
    local session takes a temporary folder, and any other one must name it.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslens-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Let batches between Spark and Python tasks hold ``BATCH_BYTES`` at most, in this session from now on.

    Both sides keep a batch whole, and Spark's buffers double as they grow, so the
    default of 64 MB takes several times that for each task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "64m")).lower()
    plain = int(now.rstrip("bkmg")) << {"k": 10, "m": 20, "g": 30}.get(now.rstrip("b")[-1], 0)
    if not 0 < plain <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation of what
    came before, and gives later joins true sizes to plan with.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/corpuslens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables. What was made of them must be stored itself by then."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(table))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(rows: DataFrame, told: DataFrame, keys: list[str], count: str, row_bytes: Column | int = 64, how: str = "inner") -> DataFrame:
    """Join ``rows`` with what is ``told`` of their keys; its column ``count`` says how many of ``rows`` have the key.

    No task gets all rows of a heavy key: ``told`` of those keys is broadcast, as
    far as rows of ``row_bytes`` fit ``BROADCAST_BYTES``, and only the other keys
    are shuffled. ``told`` is read several times, so it should be stored. how:
    inner, or left to keep rows whose key isn't told.
    """
    least = HEAVY_ROWS

    def size() -> int:
        return told.where(F.col(count) > least).agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0

    while (heavy_bytes := size()) > BROADCAST_BYTES:
        least *= 10
    if not heavy_bytes:
        return rows.join(told, keys, how)
    heavy = told.where(F.col(count) > least)
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(told.where(F.col(count) <= least), keys, how)
    return rows.join(F.broadcast(heavy), keys).unionByName(light)


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as no column of that name takes."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(name: str):
    """A text column as UTF-8 bytes; null stays null."""
    return F.col(name).cast("string").cast("binary")


def blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of ``column``."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(
            pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64
        )
        block = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # the worker lives on; what it had is for others


class WordHashes(dict):
    """64-bit hash of each word met so far; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring word hashes."""
    if len(h) < n:
        return h[:0]
    g = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        g = g * _GOLDEN + h[j : len(h) - n + 1 + j]
    return mix(g)

"""Exact deduplication by content-defined chunk recipes.

Each text is cut at places its own bytes choose, so equal passages mostly give
equal chunks. Chunks move once, to be compared byte by byte under their
identifier; from then on a document is its recipe, the ordered list of verified
chunk identifiers, some 32 bytes for each 4 KB of text. Equal recipes are equal
texts.

Null counts as empty, and empty texts equal each other. Of equal texts the row
with the largest id stays; a null id is smaller than any other. Where that id
is on several rows of one text, exactly one of them stays. Columns of the input
keep their names and values, whatever these are.

Groups of over ``LARGE_GROUP`` rows are told to their rows by a broadcast of at
most ``BROADCAST_BYTES``, so that no task gets all rows of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import blocks, mix, stored, text_bytes, unused

MIN_BYTES, MEAN_BITS, MAX_BYTES = 2048, 12, 32768
_REACH = 32
#: Rows of a group from which on it is broadcast; more, if such groups are too many to be.
LARGE_GROUP, BROADCAST_BYTES = 1000, 32 << 20

#: A random 32-bit number for each byte value.
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)

#: Identifier functions, in the order in which they are tried.
IDENTIFIERS: tuple[Callable[[bytes], bytes], ...] = (
    lambda b: hashlib.sha256(b).digest(),
    lambda b: hashlib.sha512(b).digest()[:32],
    lambda b: hashlib.sha3_256(b).digest(),
    lambda b: hashlib.blake2b(b, digest_size=32).digest(),
)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``: where a hash of the last 32 bytes has zero low bits, within the size limits."""
    n = len(data)
    if n <= MIN_BYTES:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    reach = 1
    while reach < _REACH:
        shifted = np.zeros_like(h)
        shifted[reach:] = h[:-reach] * np.uint32(0x9E3779B1 + 2 * reach)
        h = (h ^ (h >> np.uint32(15))) + shifted
        reach *= 2
    ends, last = [], 0
    for at in (np.flatnonzero((h & np.uint32((1 << MEAN_BITS) - 1)) == 0) + 1).tolist():
        while at - last > MAX_BYTES:
            last += MAX_BYTES
            ends.append(last)
        if at - last >= MIN_BYTES and at < n:
            ends.append(at)
            last = at
    while n - last > MAX_BYTES:
        last += MAX_BYTES
        ends.append(last)
    return [*ends, n]


def chunks(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _chunk_rows(identify: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 0):
            content = [c for text in part.column(0).to_pylist() for c in chunks(text or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([identify(c) for c in content], pa.binary()), pa.array(content, pa.binary())], ["chunk", "content"])

    return run


def _recipes(identify: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 1):
            texts = [t or b"" for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([b"".join(map(identify, chunks(t))) for t in texts], pa.binary())],
                ["id", "text_sha256", "recipe"],
            )

    return run


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers=IDENTIFIERS) -> DataFrame:
    """One row per row of ``docs``: id, SHA-256 of its text, recipe of verified chunk identifiers, and a row number.

    An identifier function serves only if no two different chunks share a value
    of it; else the next one does.
    """
    content = docs.select(text_bytes(text_col).alias("text"))
    for identify in identifiers:
        by_chunk = content.mapInArrow(_chunk_rows(identify), "chunk binary, content binary").groupBy("chunk")
        if by_chunk.agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo <> hi").isEmpty():
            rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
            made = rows.mapInArrow(_recipes(identify), "id long, text_sha256 string, recipe binary")
            return stored(made.withColumn("row", F.monotonically_increasing_id()), "recipes")
    raise ValueError("different chunks share an identifier under every identifier function")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers=IDENTIFIERS) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256."""
    made = recipes(docs, id_col, text_col, identifiers)
    groups = stored(
        made.groupBy("recipe").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("last")).where("n > 1"), "groups"
    )
    least = LARGE_GROUP
    while (groups.where(F.col("n") > least).agg(F.sum(F.octet_length("recipe") + 64)).first()[0] or 0) > BROADCAST_BYTES:
        least *= 10
    large = F.broadcast(groups.where(F.col("n") > least))
    joined = made.join(large, "recipe").unionByName(made.join(large.select("recipe"), "recipe", "left_anti").join(groups.where(F.col("n") <= least), "recipe", "left"))
    alone = F.col("n").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("last.row"))).alias("kept"),
        "text_sha256",
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    sha_name, id_name, text_name = (unused(docs.columns, x) for x in ("_sha", "_kept_id", "_kept_sha"))
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(id_name), F.col("text_sha256").alias(text_name))
    sha = F.sha2(F.coalesce(text_bytes(text_col), F.lit(b"")), 256)
    stay = docs.withColumn(sha_name, sha).join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(id_name)) & (F.col(sha_name) == F.col(text_name)), "left_semi")
    again = docs.groupBy(F.col(id_col)).count().where("count > 1")
    if not again.isEmpty():
        stay = stay.dropDuplicates([id_col, sha_name])
    return stay.drop(sha_name)

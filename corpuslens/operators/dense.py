"""Vector retrieval for a table of queries: exact in blocks, and approximate by hyperplanes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.sources.scratch import kept

BLOCK_ROWS = 4096
#: Pairs of blocks that one task scores and sorts: the tasks grow in number with the pairs, not in size.
PAIRS_PER_TASK = 16
#: Scores are compared at this many digits, so that ties don't hang on the order of a sum.
DIGITS = 9


def _unit(column: pd.Series | np.ndarray, width: int | None = None) -> np.ndarray:
    """Rows of length one, of vectors cut to ``width``; one wider than they are is an error."""
    x = column if isinstance(column, np.ndarray) else np.stack([np.asarray(v, np.float64) for v in column])
    if width is not None and width > x.shape[1]:
        raise ValueError(f"{width} is wider than the vectors, which have {x.shape[1]} components")
    x = x[:, :width]
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


#: Queries of a block that are scored at once, so that a task's scores stay small whatever the block.
SLICE_ROWS = 256


def _k_best(query: np.ndarray, chunk: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs of each query; ties by chunk, scores that aren't a number last."""
    at = np.lexsort((chunk, -score, query))
    first = np.flatnonzero(np.r_[True, np.diff(query[at]) != 0])
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    at = at[place < k]
    return query[at], chunk[at], score[at]


def _pairs(query: np.ndarray, asked: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """The k best of ids for each query, a slice of queries at a time; asked and x are of length one."""
    for low in range(0, len(query), SLICE_ROWS):
        scores = np.round(asked[low : low + SLICE_ROWS] @ x.T, DIGITS)
        if len(ids) > k:
            keep = scores >= np.partition(scores, -k, axis=1)[:, -k, None]
            keep |= np.isnan(scores)
            q, c = np.nonzero(keep)
        else:
            q, c = np.divmod(np.arange(scores.size), scores.shape[1])
        yield _k_best(query[low + q], ids[c], scores[q, c], k)


def _best_of_blocks(k: int, widths: list[int | None]):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "dim": [], "chunk_id": [], "score": []})]
        if len(vectors) and len(queries):
            ids, query = vectors["chunk_id"].to_numpy(), queries["query_id"].to_numpy()
            for width in widths:
                for q, c, score in _pairs(query, _unit(queries["vec"], width), ids, _unit(vectors["vec"], width), k):
                    out.append(pd.DataFrame({"query_id": q, "dim": width or 0, "chunk_id": c, "score": score}))
        return pd.concat(out[1:] or out).astype({"query_id": "int64", "dim": "int32", "chunk_id": "int64", "score": "float64"})

    return run


def _in_blocks(queries: DataFrame, vectors: DataFrame, k: int, widths: list[int | None], block_rows: int) -> DataFrame:
    """The k best of each query and width: query_id, dim, rank, chunk_id, score."""
    rows = kept(vectors.select(F.col("chunk_id").cast("long"), "vec").dropna(), "vectors")
    asked = kept(queries.select(F.col("query_id").cast("long"), "vec").dropna(), "queries")
    n, m = max(1, -(-rows.count() // block_rows)), max(1, -(-asked.count() // block_rows))
    left = rows.select("chunk_id", "vec", F.pmod(F.xxhash64("chunk_id"), F.lit(n)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("part"))
    right = asked.select("query_id", "vec", F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("shard"))
    tasks = -(-n * m // PAIRS_PER_TASK)
    if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = left.repartition(tasks, "shard", "part"), right.repartition(tasks, "shard", "part")
    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(_best_of_blocks(k, widths), "query_id long, dim int, chunk_id long, score double")
    best = Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "dim", "rank", "chunk_id", "score")


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, spec_ids: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest chunks by cosine: query_id, rank, chunk_id, score.

    queries: (query_id, vec); vectors: (chunk_id, vec[, spec_id]). Both are dealt
    into blocks of a bounded size; each pair of blocks is one product of two
    matrices, and only its k best leave the task. spec_ids keeps the search to
    some documents. Rows with a null id or vector take no part.
    """
    if spec_ids is not None:
        vectors = vectors.join(spec_ids.select("spec_id").distinct(), "spec_id", "left_semi")
    return _in_blocks(queries, vectors, k, [None], block_rows).drop("dim")


def dense_multidim(queries: DataFrame, vectors: DataFrame, dims: list[int], k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Results for several widths, each cut from the widest vector, in one pass: query_id, dim, rank, chunk_id, score."""
    return _in_blocks(queries, vectors, k, list(dims), block_rows)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each vector as bytes of floats where they hold it exactly, else of doubles."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    fits = (short == x).all(1)
    return [(s if f else d).tobytes() for s, d, f in zip(short, x.astype("<f8"), fits)]


def _unpacked(column: pd.Series, width: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f4" if len(b) == 4 * width else "<f8").astype(np.float64) for b in column])


def _buckets(planes: np.ndarray, near: bool):
    """Keys of the buckets of each vector: one in each table, and if ``near`` those that differ from it in one plane. planes: (tables, bits, width)."""
    tables, bits, width = planes.shape
    powers = 1 << np.arange(bits, dtype=np.int64)
    flips = np.concatenate([[0], powers]) if near else np.zeros(1, np.int64)
    across = planes.reshape(-1, width).T

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = np.stack([np.asarray(v, np.float64) for v in batch.column(1).to_pylist()])
                own = ((x @ across > 0).reshape(len(x), tables, bits) * powers).sum(2)
                keys = (own[:, :, None] ^ flips) + (np.arange(tables, dtype=np.int64) << bits)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(_packed(x), pa.binary()), pa.array(keys.reshape(len(x), -1).tolist(), pa.list_(pa.int64()))], ["id", "vec", "keys"]
                )

    return run


def _best_of_buckets(k: int, width: int):
    """The k best of each query within the buckets of a block; rows and queries meet only where their keys are equal."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(rows) and len(asked):
            rows = rows.sort_values("key", kind="stable")
            keys, ids, x = rows["key"].to_numpy(), rows["id"].to_numpy(), _unit(_unpacked(rows["vec"], width))
            query, own, q = asked["id"].to_numpy(), asked["keys"].to_numpy(), _unit(_unpacked(asked["vec"], width))
            x[~x.any(1)] = np.nan  # a vector of no length has no cosine
            key, who = np.concatenate(own), np.repeat(np.arange(len(own)), [len(o) for o in own])
            order = np.argsort(key, kind="stable")
            key, who = key[order], who[order]
            starts = np.flatnonzero(np.r_[True, np.diff(key) != 0])
            size = 0
            for low, high in zip(starts, np.r_[starts[1:], len(key)]):
                a, b = np.searchsorted(keys, key[low], "left"), np.searchsorted(keys, key[low], "right")
                if a < b:
                    for best in _pairs(query[who[low:high]], q[who[low:high]], ids[a:b], x[a:b], k):
                        found.append(best)
                        size += len(best[0])
                if size > 1 << 20:
                    found = [_k_best(*map(np.concatenate, zip(*found)), k)]
                    size = 0
        query, chunk, score = _k_best(*map(np.concatenate, zip(*found)), k)
        return pd.DataFrame({"query_id": query, "chunk_id": chunk, "score": score})

    return run


#: Vectors of a bucket, on average, at which buckets are halved.
BUCKET_ROWS = 64


def ann_topk(queries: DataFrame, vectors: DataFrame, k: int, width: int, tables: int = 64, bits: int | None = None, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """About the k nearest chunks by cosine: rows that share a hyperplane bucket with the query, scored exactly.

    Every row is indexed, in one bucket of each table; a query also looks into the
    buckets beyond each single plane. The number of planes (bits) grows with the
    logarithm of the rows, so that buckets don't grow. Recall against dense_topk
    depends on tables.

    Buckets whose keys begin alike make a block of about ``block_rows`` rows; a block
    of more rows or queries is divided. Scores are taken in the blocks, as products
    of matrices, and only the k best of a query leave one, so no pair is shuffled.
    """
    if bits is None:
        bits = min(40, max(6, int(np.ceil(np.log2(max(1, vectors.count()) / BUCKET_ROWS)))))
    planes = np.random.default_rng(seed).normal(size=(tables, bits, width))

    def keyed(df: DataFrame, id_col: str, near: bool) -> DataFrame:
        whole = df.select(F.col(id_col).cast("long").alias("id"), F.col("vec").cast("array<double>")).dropna()
        return kept(whole.mapInArrow(_buckets(planes, near), "id long, vec binary, keys array<long>"), "buckets")

    rows, asked = keyed(vectors, "chunk_id", False), keyed(queries, "query_id", True)
    low = bits - min(bits, max(0, int(np.ceil(np.log2(max(1, rows.count()) / block_rows)))))
    placed = rows.select("id", "vec", F.explode("keys").alias("key")).withColumn("block", F.shiftright("key", low))
    # a query's keys of one block stay together
    blocks_of = F.array_distinct(F.transform("keys", lambda x: F.shiftright(x, low)))
    looks = asked.select("id", "vec", "keys", F.explode(blocks_of).alias("block")).withColumn("keys", F.filter("keys", lambda x: F.shiftright(x, low) == F.col("block")))
    parts = lambda df, name: df.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (2 * block_rows)).alias(name))
    sizes = kept(parts(placed, "n").join(parts(looks, "m"), "block"), "blocks")
    dealt = lambda name: F.pmod(F.xxhash64("id"), F.col(name))
    everywhere = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    left = placed.join(sizes, "block").select("id", "vec", "key", "block", dealt("n").alias("shard"), everywhere("m").alias("part"))
    right = looks.join(sizes, "block").select("id", "vec", "keys", "block", dealt("m").alias("part"), everywhere("n").alias("shard"))
    by = ["block", "shard", "part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_best_of_buckets(k, width), "query_id long, chunk_id long, score double")
    scored = found.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")

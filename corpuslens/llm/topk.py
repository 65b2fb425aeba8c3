"""Exact maximum inner product search with ball trees.

The upper levels of one tree deal vectors into cells that lie together in space.
They are fitted on a sample of at most ``SAMPLE_ROWS`` vectors; every vector goes
down them to its cell, whose ball is about the sample's centre and reaches its
farthest vector. Cells of over ``SHARD_ROWS`` vectors are dealt into shards by a
hash; each shard has a tree of its own, in which nodes split at the median along
the widest direction and keep their centre, radius and smallest id. For a query
q, no vector of a node scores more than q·centre + |q|·radius, so nodes are taken
from a heap in the order of that bound, and the search ends when the bound can't
beat the current k-th score.

A first pass searches the cell whose centre suits each query best. The k-th score
found there travels with the query, but only to cells whose bound reaches it; the
others are dropped before anything is shuffled. Queries come to a shard in blocks
of a bounded size, so no task holds all queries or all vectors.

Components are integers, and scores exact: they are summed as doubles where these
hold all of them exactly, else as long integers, else as Python's. A score that no
long holds is compared as it is but returned as the largest or smallest long. Ties
go to the smaller id.

Vectors that are null or empty, or hold null or non-finite components (also after
scaling), take no part, nor do rows with a null id. A query meets the vectors of its
own length only. Rows that repeat an id all take part, as candidates of one id
and, if it is a query's, the query is asked once for each distinct vector of that
id; a row is no candidate for its own id.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import discard, stored
from corpuslens.llm.exact_scores import best as best_of
from corpuslens.llm.exact_scores import by_width, clipped, floor_of, products, quantised, wide_key

SHARD_ROWS = 2048
QUERY_ROWS = 4096
LEAF_ROWS = 64
#: Vectors that the upper levels are fitted on, and the most cells they make.
SAMPLE_ROWS, MAX_CELLS = 20_000, 1024


def bounds_of(centres: np.ndarray, radii: np.ndarray, q: np.ndarray) -> np.ndarray:
    """No vector of a ball scores more than this; the last term covers the rounding of doubles."""
    with np.errstate(all="ignore"):
        length = np.sqrt(q @ q)
        bounds = np.floor(centres @ q + length * radii + 1e-9 * length * (np.sqrt((centres * centres).sum(1)) + radii) + 1e-6)
    return np.where(np.isnan(bounds), np.inf, bounds)  # where doubles overflow, nothing is known


class BallTree:
    """Ball tree over integer vectors, held in arrays."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        centres, radii, self.least, self.span, self.children = [], [], [], [], []
        perm = np.arange(len(ids))

        def build(lo: int, hi: int) -> int:
            node = len(self.span)
            part = perm[lo:hi]
            x = self.vectors[part]
            centre = x.mean(0)
            centres.append(centre)
            radii.append(float(np.sqrt(((x - centre) ** 2).sum(1).max())))
            self.least.append(int(self.ids[part].min()))
            self.span.append((lo, hi))
            self.children.append(None)
            if hi - lo > leaf and radii[node] > 0:
                far = x[((x - centre) ** 2).sum(1).argmax()]
                far2 = x[((x - far) ** 2).sum(1).argmax()]
                side = x @ (far2 - far)
                mid = (hi - lo) // 2
                perm[lo:hi] = part[np.argpartition(side, mid)]
                left, right = build(lo, lo + mid), build(lo + mid, hi)
                self.children[node] = (left, right)
            return node

        with np.errstate(all="ignore"):
            build(0, len(ids))
            self.longest = float(np.sqrt((self.vectors**2).sum(1).max()))
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.ids, self.vectors = self.ids[perm], self.vectors[perm]

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """Up to k best (score, id), but for ``own``; at least all that belong to the k best of a search whose k-th score is ``floor``."""
        q = query.astype(np.float64)
        with np.errstate(all="ignore"):
            exact = self.longest * float(np.sqrt(q @ q)) < 2.0**52  # so that doubles hold each score and each partial sum
        bounds = bounds_of(self.centres, self.radii, q)
        best: list[tuple[int, int]] = []  # heap of (score, -id), worst first
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor or len(best) == k and -bound < best[0][0]:
                break
            if len(best) == k and -bound == best[0][0] and self.least[node] >= -best[0][1]:
                continue
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            lo, hi = self.span[node]
            scores = (self.vectors[lo:hi] @ q).astype(np.int64) if exact else products(q[None], self.vectors[lo:hi])[0]
            ids = self.ids[lo:hi]
            least = max(floor, best[0][0]) if len(best) == k else floor
            at = best_of(scores, ids, np.flatnonzero((ids != own) & (scores >= least) if exact else ids != own), k)
            for i in at.tolist():
                item = (int(scores[i]), -int(self.ids[lo + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i) for s, i in best]


class Cells:
    """The upper levels: directions and thresholds of a complete binary tree, and its leaves' centres."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        width = sample.shape[1]
        self.directions, self.thresholds = np.zeros(((1 << depth) - 1, width)), np.zeros((1 << depth) - 1)
        parts = [sample]
        for level in range(depth):
            split = []
            for i, x in enumerate(parts):
                if len(x) < 2:  # all of it goes left
                    self.thresholds[(1 << level) - 1 + i] = np.inf
                    split += [x, x[:0]]
                    continue
                far = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
                line = x[((x - far) ** 2).sum(1).argmax()] - far
                side = x @ line
                middle = np.median(side)
                self.directions[(1 << level) - 1 + i], self.thresholds[(1 << level) - 1 + i] = line, middle
                split += [x[side < middle], x[side >= middle]]
            parts = split
        self.centres = np.array([x.mean(0) if len(x) else np.zeros(width) for x in parts])

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((x * self.directions[node]).sum(1) >= self.thresholds[node])
        return node - ((1 << self.depth) - 1)


def _place(trees: dict[int, Cells]):
    """Columns (…, v) with the width, the cell and the distance from the cell's centre added. A width without a tree has one cell about nought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(all="ignore")
        for batch in batches:
            widths, cells, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for width, rows, v in by_width(batch.column("v")):
                x = v.astype(np.float64)
                widths[rows] = width
                if width in trees:
                    cells[rows] = trees[width].of(x)
                    x = x - trees[width].centres[cells[rows]]
                far[rows] = np.sqrt((x * x).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(widths), pa.array(cells), pa.array(far)], [*batch.schema.names, "width", "cell", "far"])

    return run


def _route(trees: dict[int, Cells], radii: dict[tuple[int, int], float], first: bool):
    """Rows (query_id, q, v, floor, home) for each cell to be searched: the one that suits best at first, then all others whose bound reaches the floor."""
    balls: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for width in {w for w, _ in radii}:
        at = np.array(sorted(c for w, c in radii if w == width))
        centres = trees[width].centres[at] if width in trees else np.zeros((1, width))
        balls[width] = at, centres, np.array([radii[width, c] for c in at.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, widths, cells = [], [], []
            floors, homes = np.asarray(batch.column("floor")), np.asarray(batch.column("home"))
            for width, rows, v in by_width(batch.column("v")):
                if width not in balls:
                    continue
                at, centres, reach = balls[width]
                for i, q in zip(rows.tolist(), v.astype(np.float64)):
                    hit = at[[(centres @ q).argmax()]] if first else at[(bounds_of(centres, reach, q) >= floors[i]) & (at != homes[i])]
                    row += [i] * len(hit)
                    widths += [width] * len(hit)
                    cells += hit.tolist()
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(taken) for c in batch.columns], pa.array(widths, pa.int32()), pa.array(cells, pa.int32())], [*batch.schema.names, "width", "cell"])

    return run


def _search(k: int) -> Callable:
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(vectors) and len(queries):
            tree = BallTree(vectors["vec_id"].to_numpy(), np.stack(vectors["v"].to_list()))
            for query_id, part, v, floor in zip(queries["query_id"], queries["q"], np.stack(queries["v"].to_list()), queries["floor"]):
                out += [(query_id, part, i, clipped(s), wide_key(s)) for s, i in tree.search(v, query_id, k, floor)]
        return pd.DataFrame(out, columns=["query_id", "q", "vec_id", "score", "wide"]).astype({c: "int64" for c in ("query_id", "q", "vec_id", "score")})

    return run


def _fit(rows: DataFrame, n: int, shard_rows: int) -> dict[int, Cells]:
    """Upper levels for each length of the sampled vectors."""
    share = int(min(1.0, SAMPLE_ROWS / max(1, n)) * (1 << 40))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)) <= share).select("v").limit(SAMPLE_ROWS).toArrow()
    parts_of: dict[int, list[np.ndarray]] = {}
    for chunk in sample.column("v").chunks:
        for width, _, v in by_width(chunk):
            parts_of.setdefault(width, []).append(v.astype(np.float64))
    cells = min(MAX_CELLS, -(-n // shard_rows))
    depth = max(0, (cells - 1).bit_length())
    return {width: Cells(np.concatenate(parts), depth) for width, parts in parts_of.items()}


def topk(
    vectors: DataFrame, queries: DataFrame, k: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """For each row of ``queries`` its k best rows of ``vectors`` by inner product: query_id, rank, vec_id, score."""
    return _searched(vectors, queries, k, scale, id_col, vector_col, shard_rows, query_rows)[0]


def _searched(vectors: DataFrame, queries: DataFrame, k: int, scale: float, id_col: str, vector_col: str, shard_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The result, and the rows (query, cell) of both passes."""

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v")).where("vec_id is not null and v is not null and size(v) > 0")

    plain = stored(clean(vectors), "vectors")
    trees = _fit(plain, plain.count(), shard_rows)
    placed = "vec_id long, v array<double>, width int, cell int, far double"
    rows = stored(plain.mapInArrow(_place(trees), placed), "placed")
    balls = stored(rows.groupBy("width", "cell").agg(F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards")), "balls")
    # of the sampled lengths alone, some thousand cells at most for each; another length is one cell, which is always searched
    sampled = balls.where(F.col("width").isin(list(trees)))
    radii = {(r["width"], r["cell"]): r["radius"] for r in sampled.collect()}
    asked = stored(clean(queries).distinct().select(F.col("vec_id").alias("query_id"), F.monotonically_increasing_id().alias("q"), "v"), "queries")
    routed = "query_id long, q long, v array<double>, floor double, home int, width int, cell int"
    found = "query_id long, q long, vec_id long, score long, wide binary"

    def route(df: DataFrame, first: bool) -> DataFrame:
        df = df.select("query_id", "q", "v", "floor", "home")
        known = df.mapInArrow(_route(trees, radii, first), routed)
        if not first:
            return known
        other = df.where(~F.size("v").isin(list(trees))).withColumns({"width": F.size("v"), "cell": F.lit(0)})
        return known.unionByName(other)

    def pairs(ask: DataFrame) -> DataFrame:
        load = ask.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("parts"))
        plan = stored(load.join(balls, ["width", "cell"]).select("width", "cell", "shards", "parts"), "plan")
        numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        key = ["width", "cell", "shard", "part"]
        left = rows.join(plan, ["width", "cell"]).select("vec_id", "v", "width", "cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int").alias("shard"), numbers("parts").alias("part"))
        right = ask.join(plan, ["width", "cell"]).select("query_id", "q", "v", "floor", "width", "cell", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"), numbers("shards").alias("shard"))
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(k), found)

    none = F.lit(float("-inf"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("wide"), "vec_id")
    first = stored(route(asked.withColumns({"floor": none, "home": F.lit(-1)}), True), "first")
    pilot = stored(pairs(first), "pilot")
    floors = pilot.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).where(F.col("rank") == k).select("q", floor_of(F.col("score"), F.col("wide")).alias("floor"))
    known = first.select("query_id", "q", "v", F.col("cell").alias("home")).join(floors, "q", "left").withColumn("floor", F.coalesce("floor", none))
    rest = stored(route(known, False), "rest")
    discard(plain)
    every = pilot.unionByName(pairs(rest)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return every.select("query_id", "rank", "vec_id", "score"), first, rest

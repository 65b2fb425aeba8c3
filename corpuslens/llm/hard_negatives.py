"""Hard negatives for contrastive training: exact, by blocks with zone maps.

Rows are ordered by label, by their place on a Hilbert curve, and by id, and written
as Parquet in that order. Runs of ``BLOCK_ROWS`` rows are blocks; a zone map keeps,
for each block, the least and largest value of every dimension, the least and
largest label, and the smallest id. For an anchor q, interval arithmetic over the
dimensions bounds the score of everything in a block:

    sum of min(q·lo, q·hi)  <=  score  <=  sum of max(q·lo, q·hi).

The curve runs through the ``CURVE_DIMS`` directions of largest variance, fitted on
a bounded sample of at most ``SAMPLE_ROWS`` vectors. They order the rows, which
matters for how tight the intervals are, but not for the result.

An anchor's positives are the best rows of its own label. Its own block is searched
first; the k-th score found there goes with it to those blocks of its label whose
upper bound reaches it. Each positive of score p then opens a window of scores,
from ``low`` to ``high`` per cent of p. For negatives the block of another label
with the largest upper bound is searched first, then all blocks whose interval
meets a window and reaches the worst of the rows found for it so far.

Anchors meet the zone maps in groups of ``MAP_BLOCKS`` blocks, and come to a block
in groups of ``ANCHOR_ROWS``, so no task holds all of either. Rows with equal
vectors fall to blocks by id, so a vector that a third of all rows share is many
blocks, whose smallest ids decide ties without reading them.

Components are floor(scale * x) and scores are exact integers: doubles or long
integers where these hold every sum, else Python's integers. A score that no long
can hold is compared as it is but returned as the largest or smallest long.

Rows with a null id, label or vector, an empty vector, or a component that is null
or not finite (also after scaling) take no part. Vectors of different lengths don't
meet. All rows of one id are candidates, but not for each other; an anchor is asked
once for each distinct label and vector of its id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import stored
from corpuslens.llm.exact_scores import LONG, best, by_width, clipped, floor_of, products, quantised, wide_key, wide_value

BLOCK_ROWS, ANCHOR_ROWS, MAP_BLOCKS = 2048, 4096, 4096
SAMPLE_ROWS, CURVE_DIMS, CURVE_BITS = 20_000, 8, 7
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows; columns are axes of ``bits`` bits): Gray-code transform by Skilling."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of rotations, from the highest bit down
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def interval(low: np.ndarray, high: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that an anchor (row) may have in a block (column), with room for the rounding of doubles."""
    up, down = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)
    room = 1e-9 * (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-6
    return up @ low.T + down @ high.T - room, up @ high.T + down @ low.T + room


# Order on the curve


class Curve:
    """Hilbert curve through the directions in which a sample of vectors varies most."""

    def __init__(self, sample: np.ndarray):
        x = _tame(sample)
        self.centre = x.mean(0)
        values, vectors = np.linalg.eigh(np.atleast_2d(np.cov(x - self.centre, rowvar=False, ddof=0)))
        self.axes = vectors[:, np.argsort(-values, kind="stable")[:CURVE_DIMS]]
        at = (x - self.centre) @ self.axes
        self.low, self.high = np.quantile(at, 0.005, axis=0), np.quantile(at, 0.995, axis=0)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        cells = 1 << CURVE_BITS
        at = ((_tame(vectors) - self.centre) @ self.axes - self.low) / np.maximum(self.high - self.low, 1e-9)
        return hilbert(np.clip(np.floor(at * cells), 0, cells - 1).astype(np.int64), CURVE_BITS)


def _tame(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -(2.0**40), 2.0**40)


def _fit(rows: DataFrame, n: int) -> dict[int, Curve]:
    share = int(min(1.0, SAMPLE_ROWS / max(1, n)) * (1 << 40))
    sample = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)) <= share).select("v").limit(SAMPLE_ROWS).toArrow()
    parts_of: dict[int, list[np.ndarray]] = {}
    for chunk in sample.column("v").chunks:
        for width, _, v in by_width(chunk):
            parts_of.setdefault(width, []).append(v)
    return {width: Curve(np.concatenate(parts)) for width, parts in parts_of.items()}


def _placed(curves: dict[int, Curve]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, places = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for width, rows, v in by_width(batch.column("v")):
                widths[rows] = width
                if width in curves:
                    places[rows] = curves[width].of(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(widths), pa.array(places)], [*batch.schema.names, "width", "place"])

    return run


ROW = "id long, label long, anchor boolean, v array<double>"


def write_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` in the order of label, length, curve and id, as Parquet, with the number of their block."""
    n = rows.count()
    order = ["label", "width", "place", "id"]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // (16 * block_rows)))
    placed = rows.mapInArrow(_placed(_fit(rows, n)), f"{ROW}, width int, place long")
    number = F.monotonically_increasing_id()
    # the table fixes the order before the partitions' sizes are asked for
    ordered = stored(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part": F.shiftright(number, 33), "at": number.bitwiseAND((1 << 33) - 1)}), "ordered")
    sizes = stored(ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "sizes")  # one row for 16 blocks or more
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    numbered = ordered.join(F.broadcast(starts), "part").withColumn("block", F.floor((F.col("start") + F.col("at")) / block_rows).cast("long"))
    return stored(numbered.select("block", "width", "id", "label", "anchor", "v"), "blocks")


# Zone maps


ZONE = "block long, width int, low array<double>, high array<double>, label_low long, label_high long, least long"


def _zones_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks, ids, labels = (batch.column(c).to_numpy() for c in ("block", "id", "label"))
        out = []
        for width, rows, v in by_width(batch.column("v")):
            for block in np.unique(blocks[rows]):
                mine = blocks[rows] == block
                x, at = v[mine], rows[mine]
                out.append((int(block), width, x.min(0), x.max(0), int(labels[at].min()), int(labels[at].max()), int(ids[at].min())))
        types = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*out)) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], [x.split()[0] for x in ZONE.split(", ")])


def _merged(zones: pd.DataFrame) -> pd.DataFrame:
    low, high = np.stack(zones["low"].to_list()).min(0), np.stack(zones["high"].to_list()).max(0)
    return pd.DataFrame({
        "block": zones["block"].iloc[:1].to_list(), "width": [len(low)], "low": [low.tolist()], "high": [high.tolist()],
        "label_low": [zones["label_low"].min()], "label_high": [zones["label_high"].max()], "least": [zones["least"].min()],
    })


def zone_maps(blocks: DataFrame) -> DataFrame:
    """One row per block and length of vector. A task folds its rows first; what meets is a row per block and batch."""
    partial = blocks.select("block", "id", "label", "v").mapInArrow(_zones_of_batches, ZONE)
    return stored(partial.groupBy("block", "width").applyInPandas(_merged, ZONE), "zones")


# Search. Anchors travel as q (number), id, label, v and windows: positives have one without limits


WINDOW = "struct<w:int,p:bigint,wide:binary,floor:double,floor_id:bigint>"
ASK = f"q long, id long, label long, v array<double>, width int, windows array<{WINDOW}>"


def _limits(window: dict, low: int, high: int) -> tuple[int | None, int | None]:
    """Least and largest score of a window; none for positives."""
    if window["p"] is None:
        return None, None
    p = wide_value(int(window["p"]), window["wide"])
    return -((-low * p) // 100), (high * p) // 100


def _double(x: int, side: int) -> float:
    """A double that is no nearer than ``x`` on that side."""
    try:
        return float(np.nextafter(float(x), side * np.inf)) if abs(x) >= 1 << 53 else float(x)
    except OverflowError:
        return np.inf if side > 0 and x > 0 else -np.inf if side < 0 and x < 0 else np.sign(x) * 1.7e308


def _route(same: bool, low: int, high: int, first: bool) -> Callable:
    """Blocks to be read for each anchor, of those in this part of the zone maps: q, block, bound. ``first``: the one that may hold the largest score."""

    def run(zones: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(zones) and len(asked):
            lows, highs = np.stack(zones["low"].to_list()), np.stack(zones["high"].to_list())
            blocks, least, label_low, label_high = (zones[c].to_numpy() for c in ("block", "least", "label_low", "label_high"))
            with np.errstate(all="ignore"):
                down, up = interval(lows, highs, np.stack(asked["v"].to_list()))
            for n, (q, label, windows) in enumerate(zip(asked["q"], asked["label"], asked["windows"])):
                mine = (label_low <= label) & (label <= label_high) if same else (label_low != label) | (label_high != label)
                if first:
                    at = np.flatnonzero(mine)
                    if len(at):
                        best = at[np.nan_to_num(up[n, at], nan=np.inf).argmax()]
                        out.append((q, int(blocks[best]), float(np.nan_to_num(up[n, best], nan=np.inf))))
                    continue
                needed = np.zeros(len(blocks), bool)
                for window in windows:
                    bottom, top = _limits(window, low, high)
                    reach = np.floor(up[n])
                    fits = ~((reach < window["floor"]) | (reach == window["floor"]) & (least > window["floor_id"]))
                    if bottom is not None:
                        fits &= ~(reach < _double(bottom, -1)) & ~(down[n] > _double(top, 1))
                    needed |= fits
                out += [(q, int(b), 0.0) for b in blocks[needed & mine].tolist()]
        return pd.DataFrame(out, columns=["q", "block", "bound"]).astype({"q": "int64", "block": "int64", "bound": "float64"})

    return run


def _within(scores: np.ndarray, bottom: int | None, top: int | None) -> np.ndarray | bool:
    if bottom is None:
        return True
    if scores.dtype != object:
        if bottom > LONG or top < -LONG:
            return False
        bottom, top = max(bottom, -LONG), min(top, LONG)
    return ((scores >= bottom) & (scores <= top)).astype(bool)


FOUND = "q long, w int, id long, score long, wide binary"


def _search(same: bool, low: int, high: int, k: int) -> Callable:
    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(block) and len(asked):
            ids, labels, rows = block["id"].to_numpy(), block["label"].to_numpy(), np.stack(block["v"].to_list())
            for start in range(0, len(asked), 256):  # bounds the matrix of scores
                part = asked.iloc[start : start + 256]
                scored = products(np.stack(part["v"].to_list()), rows)
                for scores, q, own, label, windows in zip(scored, part["q"], part["id"], part["label"], part["windows"]):
                    mine = ((labels == label) == same) & (ids != own)
                    for window in windows:
                        among = np.flatnonzero(mine & _within(scores, *_limits(window, low, high)))
                        for i in best(scores, ids, among, k).tolist():
                            score = int(scores[i])
                            out.append((q, window["w"], int(ids[i]), clipped(score), wide_key(score)))
        return pd.DataFrame(out, columns=["q", "w", "id", "score", "wide"]).astype({"q": "int64", "w": "int32", "id": "int64", "score": "int64"})

    return run


class Miner:
    """Blocks and zone maps of one table, and the searches over them."""

    def __init__(self, rows: DataFrame, block_rows: int, anchor_rows: int, map_blocks: int, low: int, high: int):
        self.blocks = write_blocks(rows, block_rows)
        self.zones = zone_maps(self.blocks)
        self.anchor_rows, self.map_blocks, self.low, self.high = anchor_rows, map_blocks, low, high
        self.last = self.zones.agg(F.max("block")).first()[0] or 0
        self.read: list[DataFrame] = []

    def route(self, asked: DataFrame, same: bool, first: bool) -> DataFrame:
        """(q, block) for each block that an anchor's windows must read."""
        chunks = self.last // self.map_blocks
        parts = max(1, -(-asked.count() // self.anchor_rows))
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
        key = ["chunk", "width", "part"]
        left = self.zones.withColumns({"chunk": F.floor(F.col("block") / self.map_blocks).cast("int"), "part": numbers(parts - 1)})
        right = asked.withColumns({"part": F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int"), "chunk": numbers(int(chunks))})
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_route(same, self.low, self.high, first), "q long, block long, bound double")
        if first:
            found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))).where("r = 1")
        return stored(found.select("q", "block"), "routes")

    def search(self, asked: DataFrame, routes: DataFrame, same: bool, k: int) -> DataFrame:
        """The k best rows of each window in each block of ``routes``. Only these blocks are read."""
        self.read.append(routes)
        load = routes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / self.anchor_rows).cast("int").alias("parts"))
        plan = stored(load, "plan")
        chosen = self.blocks
        if plan.count() <= 1000:  # the scan skips row groups without them
            chosen = chosen.where(F.col("block").isin([r["block"] for r in plan.select("block").collect()]))
        key = ["block", "width", "part"]
        left = chosen.join(plan, "block").select("block", "width", "id", "label", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        right = routes.join(asked, "q").join(plan, "block").select(*[x.strip().split()[0] for x in ASK.split(", ")], "block", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"))
        return stored(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(same, self.low, self.high, k), FOUND), "found")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q", "w").orderBy(F.desc("score"), F.desc("wide"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floors(found: DataFrame, k: int) -> DataFrame:
    """The k-th row of each window where there is one: q, w, floor, floor_id. Scores that doubles don't hold exactly are rounded down."""
    return _first(found, k).where(F.col("rank") == k).select("q", "w", floor_of(F.col("score"), F.col("wide")).alias("floor"), F.when(F.abs(F.col("score").cast("double")) < F.lit(2.0**53), F.col("id")).otherwise(F.lit(LONG)).alias("floor_id"))


def _with_floors(windows: DataFrame, floors: DataFrame) -> DataFrame:
    """Windows (q, w, p, wide) gathered for each anchor, some at most for each."""
    known = windows.join(floors, ["q", "w"], "left").fillna({"floor": float("-inf"), "floor_id": LONG})
    return known.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("w", "p", "wide", "floor", "floor_id"))).alias("windows"))


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, map_blocks: int = MAP_BLOCKS,
) -> DataFrame:
    """For rows where ``anchor`` holds: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    return mined(rows, anchor, id_col, label_col, vector_col, scale, positives, negatives, low, high, block_rows, anchor_rows, map_blocks)[0]


def mined(rows, anchor, id_col, label_col, vector_col, scale, positives, negatives, low, high, block_rows, anchor_rows, map_blocks) -> tuple[DataFrame, Miner]:
    """The result, and the miner with the routes of its searches."""
    clean = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), quantised(F.col(vector_col), scale).alias("v")
    ).where("id is not null and label is not null and v is not null")
    miner = Miner(stored(clean, "vectors"), block_rows, anchor_rows, map_blocks, low, high)
    # equal rows lie side by side, in two blocks at most; one of them is as good a home
    homes = miner.blocks.where("anchor").groupBy("id", "label", "width", "v").agg(F.min("block").alias("home"))
    anchors = stored(homes.withColumn("q", F.monotonically_increasing_id()), "anchors")

    def ask(windows: DataFrame) -> DataFrame:
        return anchors.join(windows, "q").select("q", "id", "label", "v", "width", "windows")

    open_window = anchors.select("q", F.lit(0).alias("w"), F.lit(None).cast("long").alias("p"), F.lit(None).cast("binary").alias("wide"))
    none = open_window.limit(0).select("q", "w", F.lit(0.0).alias("floor"), F.lit(0).cast("long").alias("floor_id"))
    home = anchors.select("q", F.col("home").alias("block"))
    pilot = miner.search(ask(_with_floors(open_window, none)), home, True, positives)
    bounded = stored(ask(_with_floors(open_window, _floors(pilot, positives))), "asked")
    rest = miner.search(bounded, stored(miner.route(bounded, True, False).join(home, ["q", "block"], "left_anti"), "routes"), True, positives)
    best_rows = stored(_first(pilot.unionByName(rest), positives).select("q", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("p"), "wide"), "positives")

    windows = best_rows.where("p >= 0").select("q", "w", "p", "wide")  # below nought a window ends before it begins
    asked = stored(ask(_with_floors(windows, none)), "asked")
    first = miner.route(asked, False, True)
    pilot = miner.search(asked, first, False, negatives)
    bounded = stored(ask(_with_floors(windows, _floors(pilot, negatives))), "asked")
    rest = miner.search(bounded, stored(miner.route(bounded, False, False).join(first, ["q", "block"], "left_anti"), "routes"), False, negatives)
    picked = _first(pilot.unionByName(rest), negatives).select("q", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = picked.join(best_rows.select("q", "w", "positive_id", F.col("p").alias("positive_score")), ["q", "w"]).join(anchors.select("q", F.col("id").alias("anchor_id")), "q")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), miner

"""Integer inner products that are exact at any size, shared by the vector searches.

Components are floor(scale * x), kept as integral doubles, so every finite vector
takes part. Products are doubles or long integers where these hold each partial sum,
else Python's integers, for the rows that need them alone. A score that no long holds
travels as the largest or smallest long, with a key that sorts as the score does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = (1 << 63) - 1


def _floor(x: Column) -> Column:
    """The floor as a double; from 2^52 on every double is its own floor, and a long may not hold it."""
    return F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as an integral double; null where one is null or not finite, and for empty vectors."""
    cells = F.transform(vector, lambda x: _floor(x.cast("double") * scale))
    fine = F.forall(cells, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when((F.size(vector) > 0) & fine, cells)


_int = np.frompyfunc(int, 1, 1)


def products(anchors: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Exact integer inner products (anchors × rows of the block); only where large components meet are they Python's integers."""
    sums, tall = np.abs(anchors).sum(1), np.abs(block).max(1)
    kinds = [(np.flatnonzero(a), np.flatnonzero(b)) for a in (sums < 2.0**33, sums >= 2.0**33) for b in (tall < 2.0**20, tall >= 2.0**20)]
    parts = []
    for rows, columns in kinds:
        if len(rows) and len(columns):
            x, y = anchors[rows], block[columns]
            most = sums[rows].max() * tall[columns].max()
            if most < 2.0**53:
                parts.append((rows, columns, (x @ y.T).astype(np.int64)))
            elif most < 2.0**62:
                parts.append((rows, columns, x.astype(np.int64) @ y.astype(np.int64).T))
            else:
                parts.append((rows, columns, _int(x).dot(_int(y).T)))
    if len(parts) == 1:
        return parts[0][2]
    out = np.zeros((len(anchors), len(block)), object if any(p.dtype == object for _, _, p in parts) else np.int64)
    for rows, columns, part in parts:
        out[np.ix_(rows, columns)] = part
    return out


def wide_key(score: int) -> bytes | None:
    """Bytes that sort as the scores do, for scores that no long holds; null for others."""
    if -LONG <= score < LONG:
        return None
    size = score.bit_length() // 8 + 1
    if score > 0:
        return b"\x01" + size.to_bytes(4) + score.to_bytes(size)
    return b"\x00" + ((1 << 32) - 1 - size).to_bytes(4) + (score + (1 << 8 * size)).to_bytes(size)


def wide_value(score: int, key: bytes | None) -> int:
    """The score that ``wide_key`` was made of."""
    if key is None:
        return score
    value = int.from_bytes(key[5:])
    return value if key[0] else value - (1 << 8 * (len(key) - 5))


def clipped(score: int) -> int:
    """The score, or the long nearest to it."""
    return max(-LONG - 1, min(LONG, score))


def floor_of(score: Column, wide: Column) -> Column:
    """A double that is no larger than the score of these columns."""
    near = score.cast("double")
    down = F.when(F.abs(near) < F.lit(2.0**53), near).otherwise(near - F.abs(near) * 1e-15)
    return F.when(wide.isNotNull() & (score < 0), F.lit(float("-inf"))).otherwise(down)


def by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of a column of lists by their length: length, rows, matrix."""
    ends, flat = np.asarray(column.offsets), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        yield int(width), rows, flat[ends[rows][:, None] + np.arange(width)]


def best(scores: np.ndarray, ids: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of ``among`` (positions): higher scores, then smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(among.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(among) > k:
        least = np.partition(scores[among], len(among) - k)[len(among) - k]
        among = among[scores[among] >= least]
    return among[np.lexsort((ids[among], -scores[among]))[:k]]

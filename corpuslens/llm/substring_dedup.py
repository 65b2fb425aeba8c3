"""Removal of repeated passages, by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the
smallest hash among its runs of ``GRAM`` words, so equal windows have equal
minimisers and neighbouring windows mostly share one. Consecutive windows with
the same minimiser form a super-k-mer. The steps:

1. Every document yields the headers of its super-k-mers: minimiser, place,
   number of windows. A minimiser met in one document only can't repeat, so
   only the others' super-k-mers go on.
2. Those travel as one packed string each to the bucket of their minimiser,
   where sorting the windows finds equal ones exactly.
3. A bucket of more than ``HOT_WINDOWS`` windows (a passage that very many
   documents share) is divided: its super-k-mers are cut where the runs of words
   next to the minimiser enter or leave the window, and go to a bucket of their
   own for each such context. Equal packed strings are counted before they are
   shuffled, so that one of each, with its smallest id, is left to be sorted.
   Should a context still have over ``CONTEXT_WINDOWS`` windows, they are
   counted by their words, each alone; one that comes again and again in a
   string, as in a run of one word, is there once, with the words that it covers.
4. Covered words are cut from the documents.

Words are runs of anything but ASCII white space, unchanged. Null ids take no
part (nothing is smaller or larger than null): their text stays whole. Null
and empty texts have no words. Rows that repeat an id are judged each by its
own text; a row never counts as earlier than another row of the same id. Rows
that repeat id and text cost in proportion to their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import WordHashes, blocks, discard, gram_hashes, join_counted, mix, stored, text_bytes

GRAM = 12
#: Windows in a bucket up to which one task sorts it.
HOT_WINDOWS = 2048
#: Windows in a context up to which one task sorts it; some 30 MB.
CONTEXT_WINDOWS = 1 << 16

_HEADER = "mini long, id long, h long, start int, nwin int"
_PIECE = "mini long, sub long, hot boolean, id long, h long, start int, nwin int, packed binary"
_SPAN = "id long, h long, a int, b int"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def super_kmers(lengths: np.ndarray, hashes: np.ndarray, window: int, gram: int):
    """Runs of windows with one minimiser: document, start word, windows, minimiser.

    ``hashes`` holds the word hashes of several documents one after another.
    """
    empty = np.empty(0, np.int64)
    if len(hashes) < window:
        return empty, empty, empty, np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    mini = sliding_min(gram_hashes(hashes, gram), window - gram + 1)
    n = len(mini)
    inside = doc[:n] == doc[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (mini[1:] != mini[:-1]) | (doc[1:n] != doc[: n - 1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    size = np.diff(first, append=n)
    keep = inside[first]
    first, size = first[keep], size[keep]
    begin = np.cumsum(lengths) - lengths
    return doc[first], first - begin[doc[first]], size, mini[first]


def _headers(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for part in blocks(batches, 2):
            words, lengths, rows = [], [], []
            for i, text in enumerate(part.column(2).to_pylist()):
                w = text.split()
                if len(w) >= window:
                    words.append(cache.of(w))
                    lengths.append(len(w))
                    rows.append(i)
            if not rows:
                continue
            doc, start, size, mini = super_kmers(np.array(lengths), np.concatenate(words), window, gram)
            at = pa.array(np.array(rows)[doc])
            yield pa.RecordBatch.from_arrays(
                [pa.array(mini.view(np.int64)), part.column(0).take(at), part.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))],
                ["mini", "id", "h", "start", "nwin"],
            )

    return run


def contexts(hashes: np.ndarray, mini: np.uint64, window: int, gram: int) -> np.ndarray:
    """A key for each window of a super-k-mer: the runs of words before and after its first minimiser, as far as they are in the window."""
    grams = gram_hashes(hashes, gram)
    start = np.arange(len(hashes) - window + 1)
    found = np.flatnonzero(grams == mini)
    place = found[np.searchsorted(found, start)]
    before, after = place - gram, place + gram
    left = np.where(before >= start, grams[np.maximum(before, 0)], np.uint64(0))
    right = np.where(after + gram <= start + window, grams[np.minimum(after, len(grams) - 1)], np.uint64(0))
    return mix(mix(left + np.uint64(1)) + right)


def _cut(window: int, gram: int):
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for part in blocks(batches, 2, 1 << 20):
            out: list[tuple] = []
            for id_, h, text, pieces in zip(*(c.to_pylist() for c in part.columns)):
                words = text.split()
                for p in pieces:
                    start, n, mini = p["start"], p["nwin"], p["mini"]
                    runs = [(0, n, 0)]
                    if p["hot"]:
                        key = contexts(cache.of(words[start : start + n + window - 1]), np.int64(mini).view(np.uint64), window, gram)
                        at = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), n]
                        runs = [(a, b, k) for a, b, k in zip(at, at[1:], key.view(np.int64)[at[:-1]].tolist())]
                    for a, b, sub in runs:
                        out.append((mini, sub, p["hot"], id_, h, start + a, b - a, b" ".join(words[start + a : start + b + window - 1])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 8, types)], ["mini", "sub", "hot", "id", "h", "start", "nwin", "packed"])

    return run


def windows_of(packed: bytes, window: int) -> list[bytes]:
    """The windows of a packed super-k-mer, in order."""
    ends = list(accumulate(len(w) + 1 for w in packed.split(b" ")))
    begins = [0, *ends]
    return [packed[begins[i] : ends[i + window - 1] - 1] for i in range(len(ends) - window + 1)]


def repeated_in_bucket(rows: list[tuple], window: int) -> list[tuple]:
    """Spans of the words that the bucket's repeated windows cover.

    rows: (id, h, start, packed). A window repeats if it also starts in a row
    of smaller id. Sorting brings equal windows together, smallest id first.
    """
    if len({r[0] for r in rows}) < 2:
        return []
    found = sorted((w, r[0], k, i) for k, r in enumerate(rows) for i, w in enumerate(windows_of(r[3], window)))
    marked: dict[int, list[int]] = {}
    last, least = None, None
    for w, id_, k, i in found:
        if w != last:
            last, least = w, id_
        elif id_ > least:
            marked.setdefault(k, []).append(i)
    spans = []
    for k, at in marked.items():
        id_, h, start, _ = rows[k]
        at.sort()
        a = b = at[0]
        for i in at[1:]:
            if i > b + window:
                spans.append((id_, h, start + a, start + b + window))
                a = i
            b = i
        spans.append((id_, h, start + a, start + b + window))
    return spans


def _span_batch(spans: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    cols = list(zip(*spans)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "h", "a", "b"])


def _sort_buckets(window: int):
    """Rows (mini, sub, id, h, start, packed): buckets come one after another; each is held alone, and is bounded."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in blocks(batches, 5, 1 << 20):
            yield from zip(*(c.to_pylist() for c in part.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: list[tuple] = []
        for _, bucket in groupby(rows(batches), key=lambda r: r[:2]):
            spans += repeated_in_bucket([r[2:] for r in bucket], window)
            if len(spans) > 20_000:
                yield _span_batch(spans)
                spans = []
        yield _span_batch(spans)

    return run


def _spread(window: int):
    """Each distinct window of packed strings (id, h, packed), with the spans [a, b) that it covers there."""
    types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 2, 1 << 17):
            out: list[tuple] = []
            for i, h, packed in zip(*(c.to_pylist() for c in part.columns)):
                places: dict[bytes, list[tuple[int, int]]] = {}
                for at, w in enumerate(windows_of(packed, window)):
                    places.setdefault(w, []).append((at, at + window))
                out += [(w, i, h, a, b) for w, spans in places.items() for a, b in merged(spans)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, types)], ["words", "id", "h", "a", "b"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, 1):
        n_words, n_removed, kept, removed = [], [], [], []
        for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
            words = (text or b"").split()
            n_words.append(len(words))
            cuts = merged([(s["a"], s["b"]) for s in spans or ()])
            for a, b in reversed(cuts):
                del words[a:b]
            n_removed.append(n_words[-1] - len(words))
            removed.append([{"start": a, "end": b} for a, b in cuts])
            kept.append(b" ".join(words))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, span)],
            ["id", "n_words", "n_removed", "kept", "removed"],
        )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), text_bytes(text_col).alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, hot_windows: int = HOT_WINDOWS, context_windows: int = CONTEXT_WINDOWS) -> DataFrame:
    """Word spans [a, b) that repeat an earlier document: rows (id, hash of its text, spans), of which a row may have several."""
    gram = min(GRAM, window)
    keyed = _keyed(docs, id_col, text_col)
    usable = keyed.where("id is not null and text is not null")
    headers = stored(usable.mapInArrow(_headers(window, gram), _HEADER), "headers")
    shared = stored(
        headers.groupBy("mini")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("nwin").alias("n"))
        .where("lo < hi")
        .select("mini", "n", (F.col("n") > hot_windows).alias("hot")),
        "shared",
    )
    piece = F.struct("mini", "hot", "start", "nwin")
    wanted = join_counted(headers, shared, ["mini"], "n").groupBy("id", "h").agg(F.collect_set(piece).alias("pieces"))  # of repeated rows once
    pieces = stored(usable.join(wanted, ["id", "h"]).select("id", "h", "text", "pieces").mapInArrow(_cut(window, gram), _PIECE), "pieces")
    discard(headers, shared)
    cold = _sorted_spans(pieces.where("not hot").select("mini", "sub", "id", "h", "start", "packed"), window)
    return cold.select("id", "h", F.array(F.struct("a", "b")).alias("spans")).unionByName(
        _hot_spans(pieces.where("hot"), window, max(hot_windows, context_windows))
    )


def _sorted_spans(rows: DataFrame, window: int) -> DataFrame:
    dealt = rows.repartition("mini", "sub").sortWithinPartitions("mini", "sub")
    return dealt.mapInArrow(_sort_buckets(window), _SPAN)


def _hot_spans(pieces: DataFrame, window: int, most: int) -> DataFrame:
    """Spans of hot buckets: of each packed string, all holders but the one of smallest id repeat it; that one is sorted among the others' like."""
    held = ["mini", "sub", "packed"]
    strings = stored(
        pieces.groupBy(*held).agg(F.min("id").alias("lo"), F.first("nwin").alias("nwin"), F.count(F.lit(1)).alias("times")).withColumn("u", F.monotonically_increasing_id()), "strings"
    )
    sizes = stored(strings.groupBy("mini", "sub").agg(F.sum("nwin").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1"), "contexts")
    several = join_counted(strings, sizes, ["mini", "sub"], "k")
    few = several.where(F.col("n") <= most).select("mini", "sub", F.col("lo").alias("id"), F.col("u").alias("h"), F.lit(0).alias("start"), "packed")
    spread = several.where(F.col("n") > most).select("lo", "u", "packed").mapInArrow(_spread(window), "words binary, id long, h long, a int, b int")
    first = spread.groupBy("words").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").drop("hi")
    alone = spread.join(first, "words").where("id > lo").select("id", "h", "a", "b")
    inner = stored(_sorted_spans(few, window).unionByName(alone).groupBy(F.col("h").alias("u")).agg(F.collect_set(F.struct("a", "b")).alias("spans")), "inner")
    holders = stored(join_counted(pieces, strings.drop("nwin"), held, "times", F.octet_length("packed") + 64).select("id", "h", "start", "nwin", "u", (F.col("id") > F.col("lo")).alias("later")), "holders")
    discard(strings, sizes)
    whole = holders.where("later").select("id", "h", F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("nwin") + (window - 1)).alias("b"))).alias("spans"))
    moved = F.transform("spans", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b")))
    return whole.unionByName(holders.where("not later").join(inner, "u").select("id", "h", moved.alias("spans")))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, hot_windows: int = HOT_WINDOWS, context_windows: int = CONTEXT_WINDOWS) -> DataFrame:
    """Cut words covered by a window that an earlier document also has.

    One row per input row: the id, n_words, n_removed, kept_text (words joined
    by one space) and removed (array of word spans [start, end)). Windows are
    judged on the input, not on what other cuts leave.
    """
    spans = repeated_spans(docs, id_col, text_col, window, hot_windows, context_windows)
    by_row = spans.groupBy("id", "h").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    cut = (
        _keyed(docs, id_col, text_col).join(by_row, ["id", "h"], "left").select("id", "text", "spans")
        .mapInArrow(_remove, "id long, n_words long, n_removed long, kept binary, removed array<struct<start:int,end:int>>")
    )
    return cut.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"), "removed")

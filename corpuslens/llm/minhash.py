"""Near-duplicate classes by ProbMinHash, banding and verification.

A document is a weighted set: its shingles of five words, each with weight
1 + ln(times it occurs). The similarity of two documents is the probability
Jaccard of their weights,

    J(a, b) = sum over i in both of 1 / sum over j of max(a_j / a_i, b_j / b_i),

which for equal weights is the Jaccard similarity of the sets. In ProbMinHash,
each element sends points of a Poisson process with its weight as rate to
random components of the signature; a component keeps the element that came
first. An element stops when its next point is later than every component's
first. Components of two signatures agree with probability J.

The steps:

1. Rows become groups of equal texts, each with one node, a row of that text.
   All else is done between nodes.
2. ``BANDS`` bands of ``ROWS`` components each put nodes into buckets. At
   J = 0.8 a pair shares none with probability (1 - 0.8**6)**40, under 6e-6.
3. In every bucket, all nodes are compared to its hub, the node that meets most
   others in all its buckets; J is computed exactly from the texts. A hub's text
   goes to at most ``HUB_PARTS`` places, and its members come to it one after
   another. Links make classes (connected components, by large and small stars).
4. Pairs of one bucket that are still in different classes are compared too,
   by a sketch of ``SKETCH`` bits first: a pair at J = 0.8 agrees in 90 % of
   them, and passes unless it falls short by more than five standard
   deviations. The sketches are compared inside the join, so the pairs that
   don't pass are never rows. Members of a bucket of over ``REFINE`` nodes go
   to buckets of a longer signature instead, where less similar ones seldom
   meet; a pair at J = 0.8 misses those with probability under 2e-5. So no link
   between classes is left out by a cap, and pairs within a class are never
   listed.

Signatures are drawn for blocks of ``CELLS`` components at most, so a task's
memory depends on neither the number nor the length of the texts in a batch.

Null counts as a text without words. Texts without words have no shingles and
are near nothing, not even each other. Texts of fewer than five words have one
shingle, all their words. Rows with a null id are classes of their own (null).
Rows that share an id are told apart by their texts: each is in the class of
its text, and exactly one row of a class stays, also of rows that repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import WordHashes, blocks, discard, gram_hashes, join_counted, mix, stored, text_bytes, unused

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 6
SKETCH, FINE_BANDS, FINE_ROWS = 2048, 96, 10
REFINE = 1000
#: Places that the text of one hub is sent to.
HUB_PARTS = 256
#: Links that any task can hold, at 16 bytes each.
LINKS_OF_A_TASK = 1 << 20
#: Components of the signatures that are drawn at a time.
CELLS = 1 << 17

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], cache: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their weights."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0)
    found, count = np.unique(gram_hashes(cache.of(words), min(size, len(words))), return_counts=True)
    return found, 1 + np.log(count)


def signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """ProbMinHash signatures of several weighted sets at once.

    elements, weights and doc (0 … n_docs - 1) are parallel arrays. The fewer
    elements are left, the more points of each are drawn in a round.
    """
    first = np.full(n_docs * size, np.inf)
    winner = np.zeros(n_docs * size, np.uint64)
    latest = np.full(n_docs, np.inf)
    point = np.zeros(len(elements))
    drawn = 0
    while len(elements):
        k = min(64, max(1, (1 << 14) // len(elements)))
        steps = np.arange(drawn + 1, drawn + k + 1, dtype=np.uint64) * _GOLDEN
        drawn += k
        r = mix(elements[:, None] + steps)
        wait = -np.log1p(-((r >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weights[:, None]
        wait[:, 0] += point
        when = np.cumsum(wait, 1)
        slot = doc[:, None] * size + (((mix(r + _GOLDEN) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
        point, when, slot = when[:, -1], when.ravel(), slot.ravel()
        early = np.flatnonzero(when < first[slot])
        at, when = slot[early], when[early]
        np.minimum.at(first, at, when)
        won = when == first[at]
        winner[at[won]] = elements[early[won] // k]
        touched = np.unique(doc[early // k])
        latest[touched] = first.reshape(n_docs, size)[touched].max(1)
        go = np.flatnonzero(point < latest[doc])
        elements, weights, doc, point = elements[go], weights[go], doc[go], point[go]
    return winner.reshape(n_docs, size)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets, each (sorted elements, weights)."""
    both, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = a[1][at], b[1][bt]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    # for element i, j counts as a_j / a_i where a_j / b_j is the larger ratio, else as b_j / b_i
    order = np.argsort(wa / wb, kind="stable")
    wa, wb = wa[order], wb[order]
    from_a = np.cumsum(wa[::-1])[::-1]
    below_b = np.cumsum(wb) - wb
    return float((1 / ((from_a + only_a) / wa + (below_b + only_b) / wb)).sum())


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of each signature; keys of different bands differ."""
    keys = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys * _GOLDEN + sig[:, r * bands : (r + 1) * bands])
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN)


def _lists(x: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1).view(np.int64)))


def _signed(batches: Iterator[pa.RecordBatch], size: int, components: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray, np.ndarray]]:
    """Blocks of rows (any, text) with their texts, whether each is without words, and their signatures."""
    cache = WordHashes()
    most = max(1, CELLS // components)
    whole = blocks(batches, 1, 1 << 20)
    for part in (block.slice(i, most) for block in whole for i in range(0, block.num_rows, most)):
        texts = [t or b"" for t in part.column(1).to_pylist()]
        sets = [shingles(t.split(), cache, size) for t in texts]
        lengths = np.array([len(s[0]) for s in sets])
        sig = signatures(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), np.repeat(np.arange(len(sets)), lengths), len(sets), components)
        yield part, texts, lengths == 0, sig


def _sign(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, empty, sig in _signed(batches, size, bands * rows):
            same = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), same, pa.array(empty), _lists(band_keys(sig, bands, rows))], ["id", "same", "empty", "bands"])

    return run


def _sketch(size: int):
    """Bits of a longer signature, packed into longs, and its band keys."""
    at = np.arange(1, SKETCH + 1, dtype=np.uint64) * _GOLDEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, sig in _signed(batches, size, SKETCH):
            bits = np.packbits((mix(sig + at) >> np.uint64(63)).astype(np.uint8), axis=1).view(np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(bits), _lists(band_keys(sig, FINE_BANDS, FINE_ROWS))], ["node", "sketch", "fine"])

    return run


def _verify(threshold: float, size: int):
    """Rows (hub, part, node, text) come in order; the row of a hub, whose node is null, comes before its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        hub = None
        for part in blocks(batches, 3, 1 << 20):
            a, b, sim = [], [], []
            for h, node, text in zip(*(part.column(i).to_pylist() for i in (0, 2, 3))):
                own = shingles(text.split(), cache, size)
                if node is None:
                    hub = own
                    continue
                s = probability_jaccard(hub, own)
                if s >= threshold:
                    a.append(h)
                    b.append(node)
                    sim.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "sim"])

    return run


def components(links: DataFrame) -> DataFrame:
    """Smallest node of the component of every other node in it: (node, root). links: (a, b).

    Large-star and small-star rounds over the links until they change no more;
    a round keeps one row for each link and never gathers a node's neighbours.
    From ``LINKS_OF_A_TASK`` links on, the least neighbour of a node of many links is broadcast to
    them; below, all links of one node fit a task.
    """

    def joined(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
        return rows.join(least, "u") if n < LINKS_OF_A_TASK else join_counted(rows, stored(least, "least"), ["u"], "n")

    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n, links_of = before[0], F.count(F.lit(1)).alias("n")
        least = both.groupBy("u").agg(F.min("v").alias("m"), links_of).withColumn("m", F.least("u", "m"))
        large = stored(joined(both.where("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"), links_of)
        small = joined(large, down, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v")))
        last, edges = edges, stored(small.distinct(), "edges")
        discard(last, large)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


class _Nodes:
    """Nodes that share a bucket with another one, their buckets and their texts."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, size: int, threshold: float):
        self.size, self.threshold = size, threshold
        keyed = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
        signed = keyed.mapInArrow(_sign(bands, rows, size), "id long, same binary, empty boolean, bands array<long>")
        self.signed = stored(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
        usable = self.signed.where("id is not null and not empty")
        least = F.min(F.struct("id", "row"))
        self.equal = stored(usable.groupBy("same").agg(least.alias("least"), F.count(F.lit(1)).alias("times")).select("same", F.col("least.row").alias("node"), F.col("least.id").alias("id"), "times"), "equal")
        rows_of = usable.join(self.equal.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("band"))
        crowded = stored(rows_of.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowded")
        self.buckets = stored(rows_of.join(crowded, "band"), "buckets")
        discard(crowded)
        members = self.equal.join(self.buckets.select("node").distinct(), "node", "left_semi")
        same = F.unhex(F.sha2("text", 256))
        texts = keyed.where("text is not null").withColumn("same", same).join(members, ["id", "same"]).select("node", "text")
        self.texts = stored(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")  # rows that repeat have one text

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts are similar enough; a is the hub of its pairs."""
        placed = pairs.select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.lit(HUB_PARTS)).cast("int").alias("part"), F.col("b").alias("node"))
        hubs = placed.select("hub", "part").distinct().join(self.texts.withColumnRenamed("node", "hub"), "hub").select("hub", "part", F.lit(None).cast("long").alias("node"), "text")
        members = placed.join(self.texts, "node").select("hub", "part", "node", "text")
        dealt = hubs.unionByName(members).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("node").asc_nulls_first())
        return dealt.mapInArrow(_verify(self.threshold, self.size), "a long, b long, sim double")


def _unlike(cells: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of one cell (key, node, label) with different labels whose sketches are alike enough, each at the first key they share."""
    p = (1 + threshold) / 2
    most_unlike = int(SKETCH * (1 - p) + 5 * (SKETCH * p * (1 - p)) ** 0.5)
    longs = range(SKETCH // 64)
    keys = cells.groupBy("node").agg(F.collect_list("key").alias("keys"))
    full = cells.join(keys, "node").join(sketches.select("node", "sketch"), "node")

    def side(name: str) -> DataFrame:
        return full.select("key", F.col("node").alias(name), F.col("label").alias(f"label_{name}"), F.col("keys").alias(f"keys_{name}"), *[F.get("sketch", F.lit(i)).alias(f"{name}{i}") for i in longs])

    unlike = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in longs), F.lit(0))
    first = F.array_min(F.array_intersect("keys_a", "keys_b"))
    x, y = side("a"), side("b")
    on = (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & (unlike <= most_unlike) & (x["key"] == first)
    return x.join(y, on).select("a", "b")


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, refine: int = REFINE,
) -> DataFrame:
    """One row per row of ``docs``: its id, class_id (the smallest id of its class), n_links and kept.

    n_links: how many of the links that made the classes touch the row's text.
    kept: whether the row is the one of its class that stays; its id is class_id.
    """
    return _classified(docs, id_col, text_col, threshold, bands, rows, size, refine).select(F.col("id").alias(id_col), "class_id", "n_links", "kept")


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int, size: int, refine: int) -> DataFrame:
    nodes = _Nodes(docs, id_col, text_col, bands, rows, size, threshold)
    buckets = nodes.buckets
    reach = buckets.groupBy("node").agg(F.sum(F.col("n") - 1).alias("reach"))
    hubs = stored(buckets.join(reach, "node").groupBy("band").agg(F.max(F.struct("reach", (-F.col("node")).alias("minus"))).alias("top")).select("band", (-F.col("top.minus")).alias("hub")), "hubs")
    tested = stored(buckets.join(hubs, "band").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "tested")
    links = stored(nodes.linked(tested), "links")

    roots = components(links)
    labelled = stored(buckets.join(roots, "node", "left").select(F.col("band").alias("key"), "n", "node", F.coalesce("root", "node").alias("label")), "labelled")
    discard(hubs, buckets)

    def divided(cells: DataFrame) -> DataFrame:
        """Cells whose key has nodes of several classes."""
        split = cells.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        return cells.join(split, "key", "left_semi")

    open_ = stored(divided(labelled), "open")
    discard(labelled)
    texts = nodes.texts.join(open_.select("node").distinct(), "node", "left_semi")
    sketches = stored(texts.select("node", "text").mapInArrow(_sketch(size), "node long, sketch array<long>, fine array<long>"), "sketches")
    small = open_.where(F.col("n") <= refine).select("key", "node", "label")
    large = open_.where(F.col("n") > refine).select("node", "label").distinct()
    fine = divided(large.join(sketches.select("node", "fine"), "node").select(F.explode("fine").alias("key"), "node", "label"))
    either = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = stored(_unlike(small, sketches, threshold).unionByName(_unlike(fine, sketches, threshold)).distinct().join(either, ["a", "b"], "left_anti"), "rest")
    more = stored(nodes.linked(rest), "more")
    discard(open_, sketches, tested, rest, nodes.texts)
    links = links.unionByName(more)
    if not more.isEmpty():
        roots = components(links)

    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    rooted = stored(nodes.equal.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    own = F.struct("id", F.col("node").alias("row"))
    classes = stored(rooted.groupBy("root").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1"), "classes")
    least = F.coalesce("least", own).alias("least")
    known = stored(join_counted(rooted, classes, ["root"], "nodes", how="left").join(degree, "node", "left").select("same", least, "n_links", "times"), "known")
    discard(rooted, classes)
    usable, alone = nodes.signed.where("id is not null and not empty"), nodes.signed.where("id is null or empty")
    return join_counted(usable.select("id", "same", "row"), known, ["same"], "times", 96).select(
        "id", "same", F.col("least.id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("row") == F.col("least.row")).alias("kept"),
    ).unionByName(alone.select("id", "same", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept")))


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, refine: int = REFINE,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are dropped by id and text; of rows that repeat both, one is left.
    """
    found = _classified(docs, id_col, text_col, threshold, bands, rows, size, refine).where("id is not null")
    verdicts = stored(found.groupBy("id", "same").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("stay")).where("n > stay"), "verdicts")
    id_name, text_name = unused(docs.columns, "_id"), unused(docs.columns, "_text")
    text = F.unhex(F.sha2(F.coalesce(text_bytes(text_col), F.lit(b"")), 256))
    on = (F.col(id_col).cast("long") == F.col(id_name)) & (text == F.col(text_name))

    def where(condition: str) -> DataFrame:
        return verdicts.where(condition).select(F.col("id").alias(id_name), F.col("same").alias(text_name))

    left, again = docs.join(where("stay = 0"), on, "left_anti"), where("stay > 0")
    if again.isEmpty():
        return left
    once = left.join(again, on, "left_semi").withColumn(text_name, text).dropDuplicates([id_col, text_name]).drop(text_name)
    return left.join(again, on, "left_anti").unionByName(once)

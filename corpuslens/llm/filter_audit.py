"""Interaction of document filters, over every order in which they may be applied.

Five filters judge a text: too few words (A), too few different words (B), too many
capitals (C), a mark such as # or | (D), and a text that a smaller id has too (E).
What each document fails is a mask of five bits. All the counts of all 120 orders
follow from the number of documents with each mask, so documents are read once.

E needs all equal texts. They meet in compressed tries whose terminals hold the
smallest id met so far:

1. Each task puts its texts into tries of bounded size. A row whose text has a
   smaller id there already fails E, and so does a holder that a smaller id
   replaces; both go on without their text. Only holders stay open.
2. Open texts are range-partitioned by a prefix, 32 bytes at first. Where the
   texts of one prefix are too many bytes, or too large a share of all, and differ,
   their prefix is made four times as long, and so on; prefixes of single texts
   aren't.
3. A text held by very many tasks goes through a round of tries by (prefix, salt)
   first, so that a few holders of it are left.
4. Each range has its tries, traversed when the range is read: what still holds a
   terminal passes E, what was replaced fails it.

A task's memory is the trie of its range: the different texts of some prefixes,
cut at ``RANGE_BYTES`` where they differ within their prefix.

Null texts count as empty. A row without an id is neither a copy nor an original.
Rows that share id and text are no copies of each other. The part is the language,
empty for null. Labels join by id: a document is good or toxic if any of its label
rows says so.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import blocks, stored, text_bytes

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 3, b"#$%&*|"

#: Text that one trie of the first pass holds, and that the tries of one range should hold.
BLOCK_BYTES, RANGE_BYTES = 16 << 20, 64 << 20
#: A prefix should hold no more than one part in so many of all text either, where that is more than so many bytes.
SHARES, LEAST_RANGE_BYTES = 256, 256 << 10
#: What a node takes besides its label, about.
NODE_BYTES = 500
PREFIX_BYTES, PREFIX_GROWTH = 32, 4
#: Holders of one text from which on it goes through a salted round, and the salts.
MANY_HOLDERS, SALTS = 1000, 64
#: Most prefixes that are broadcast; more are joined, spread over the salts.
BROADCAST_PREFIXES = 20_000

_CAPITALS, _INNER_BYTES = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that the text (UTF-8) fails."""
    words = text.split()  # of bytes: at ASCII white space only
    points = len(text.translate(None, _INNER_BYTES))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * points) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


def _common(a: bytes, b: bytes) -> int:
    """Length of the prefix that two texts share, by halving."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Trie:
    """Compressed trie. A node is [label, children by first byte, held]; a terminal holds its smallest id's rows."""

    def __init__(self):
        self.root = [b"", {}, None]
        self.bytes = 0

    def terminal(self, text: bytes) -> list:
        """The node at which the whole text ends, made where it isn't there."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                made = [text[at:], {}, None]
                self.bytes += len(made[0]) + NODE_BYTES
                node[1][text[at]] = made
                return made
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = _common(label, text[at : at + len(label)])
            upper = [label[:shared], {label[shared]: child}, None]
            child[0] = label[shared:]
            node[1][text[at]] = upper
            self.bytes += NODE_BYTES
            node, at = upper, at + shared
        return node

    def held(self) -> Iterator[tuple[bytes, list]]:
        """Whole texts and what their terminals hold."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, node[2]
            stack += [(child, text) for child in node[1].values()]


ROWS = "id long, part string, mask int, copies long, text binary"
_SCHEMA = pa.schema([("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("copies", pa.int64()), ("text", pa.binary())])
_E = 1 << 4


class _Out:
    """Rows gathered into batches of bounded size."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.bytes += 64 + len(row[4] or b"")

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[]] * len(_SCHEMA)
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _tries(judge: bool, last: bool, limit: int | None):
    """Put open rows into tries. ``judge``: masks A to D are still to be found. ``last``: holders pass E; else they stay open, with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trie = _Out(), Trie()

        def close() -> Iterator[pa.RecordBatch]:
            for text, (lowest, holders) in trie.held():
                for (part, mask), n in holders.items():
                    out.add(lowest, part, mask, n, None if last else text)
                if out.bytes > limit_out:
                    yield out.batch()
            yield out.batch()

        limit_out = 4 << 20
        for batch in blocks(batches, 4):
            for i, part, mask, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if judge:
                    mask = own_mask(text)
                if i is None:
                    out.add(None, part, mask, n, None)
                    continue
                node = trie.terminal(text)
                if node[2] is None:
                    node[2] = [i, {(part, mask): n}]
                elif i > node[2][0]:
                    out.add(i, part, mask | _E, n, None)
                elif i < node[2][0]:
                    for (other, its), m in node[2][1].items():
                        out.add(node[2][0], other, its | _E, m, None)
                    node[2] = [i, {(part, mask): n}]
                else:
                    node[2][1][part, mask] = node[2][1].get((part, mask), 0) + n
                if out.bytes > limit_out:
                    yield out.batch()
                if limit and trie.bytes > limit:
                    yield from close()
                    trie = Trie()
        yield from close()

    return run


def _holders_by_prefix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("prefix").agg(
        F.sum(F.octet_length("text") + NODE_BYTES).alias("bytes"), F.count(F.lit(1)).alias("holders"), F.max(F.octet_length("text")).alias("longest"),
        F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"),
    )


def _marked(rows: DataFrame, prefixes: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column that says whether their prefix is one of ``prefixes``; these hold very many rows each, so they are spread."""
    listed = prefixes.select(F.col("prefix").alias("p"), F.lit(True).alias(name))
    if prefixes.count() <= BROADCAST_PREFIXES:
        joined = rows.join(F.broadcast(listed), F.col("prefix") == F.col("p"), "left")
    else:
        spread = listed.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(spread, (F.col("prefix") == F.col("p")) & (F.pmod(F.xxhash64("id", "text"), F.lit(SALTS)) == F.col("s")), "left").drop("s")
    return joined.withColumn(name, F.coalesce(name, F.lit(False))).drop("p")


def adaptive_prefixes(open_rows: DataFrame, range_bytes: int = RANGE_BYTES, prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """``open_rows`` with the prefix of their text that is long enough to tell large ranges apart."""
    rows, length = open_rows.withColumn("prefix", F.substring("text", 1, prefix_bytes)), prefix_bytes
    total = open_rows.agg(F.sum(F.octet_length("text") + NODE_BYTES)).first()[0] or 0
    most = min(range_bytes, max(total // SHARES, LEAST_RANGE_BYTES))
    todo = rows
    while True:
        heavy = stored(_holders_by_prefix(todo).where((F.col("bytes") > most) & (F.col("longest") > length) & (F.col("lo") < F.col("hi"))), "prefixes")
        if heavy.isEmpty():
            return rows
        length *= PREFIX_GROWTH
        longer = _marked(rows, heavy, "long").withColumn("prefix", F.when(F.col("long"), F.substring("text", 1, length)).otherwise(F.col("prefix")))
        rows, todo = longer.drop("long"), longer.where("long").drop("long")


def masks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, prefix_bytes: int = PREFIX_BYTES, many_holders: int = MANY_HOLDERS,
) -> DataFrame:
    """What each document fails: id, part, mask (bit 0 is A), copies (rows of the input that the row stands for: those of one id, part and text)."""
    plain = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.lit(0).alias("mask"), F.lit(1).cast("long").alias("copies"),
        F.coalesce(text_bytes(text_col), F.lit(b"")).alias("text"),
    )
    met = stored(plain.mapInArrow(_tries(True, False, block_bytes), ROWS), "met")
    decided, todo = met.where("text is null"), met.where("text is not null")
    rows = adaptive_prefixes(todo, range_bytes, prefix_bytes)
    sizes = stored(_holders_by_prefix(rows), "sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    hot = sizes.where((F.col("holders") > many_holders) & (F.col("lo") == F.col("hi")))
    if not hot.isEmpty():
        split = _marked(rows, hot, "hot")
        salted = split.where("hot").repartition(F.col("prefix"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).drop("hot", "prefix")
        thinned = stored(salted.mapInArrow(_tries(False, False, range_bytes), ROWS), "thinned")
        decided = decided.unionByName(thinned.where("text is null"))
        # all rows of such a prefix hold one text, by its hash; should two texts share the hash, they part in the trie
        left = thinned.where("text is not null").withColumn("prefix", F.substring("text", 1, prefix_bytes))
        rows = split.where("not hot").drop("hot").unionByName(left)
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // range_bytes))
    ranged = rows.repartitionByRange(int(ranges), "prefix").drop("prefix")
    return decided.unionByName(ranged.mapInArrow(_tries(False, True, None), ROWS)).drop("text")


def counts(found: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of each part by mask: part, mask, n, good, toxic."""
    says = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    folded = found.groupBy("id", "part", "mask").agg(F.sum("copies").alias("n"))
    joined = folded.join(says, "id", "left")
    return joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def audit(counted: DataFrame) -> DataFrame:
    """Every step of every order of the filters in every part, from ``counts``: a part is one row of 32 counts until its orders are laid out."""
    every = range(1 << len(FILTERS))
    columns = [F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in every]).alias(c) for c in ("n", "good", "toxic")]
    parts = counted.groupBy("part").agg(*columns)
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))

    letter = F.substr("filter_order", "step", F.lit(1))
    steps = steps.withColumns({"letter": letter, "bit": bits(letter), "before": bits(F.substr("filter_order", F.lit(1), F.col("step") - 1))})
    bit, before = F.col("bit"), F.col("before")

    def total(of: str, holds) -> Column:
        masks = F.transform(F.col(of), lambda n, m: F.when(holds(m), n).otherwise(0))
        return F.aggregate(masks, F.lit(0).cast("long"), lambda a, n: a + n)

    fails, gone = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) != 0)
    removed = lambda m: fails(m) & ~gone(m)
    told = steps.select(
        "part", "filter_order", "step", "letter", total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
    )
    return told.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **sizes: int) -> DataFrame:
    """Masks, counts and audit in one: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit(counts(masks(docs, id_col, text_col, part_col, **sizes), labels, id_col))

"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the mixture divided by its
share of the corpus, times the mixture's size. Each document's number of copies
comes from a Poisson distribution with that mean: the smallest k whose
cumulative probability reaches the document's hash-seeded uniform number. A
rate above ``TABLE_RATE`` is the sum of equal parts of at most that, each drawn
by a number of its own, so tables stay short whatever the rate. So the number
of copies depends on the id, the seed and the rate alone, and any task can be
run again. Copies are dealt out by a hash and sorted by it, which is a uniform
shuffle of the whole mixture.

A document of more than ``DRAWS_A_BLOCK`` parts is first divided into blocks of
so many, which are dealt out before they are drawn: no task makes more than a
block's copies of a row at a time. Copies are numbered from 1 within the first
block, from ``BLOCK_STEP`` + 1 within the second, and so on.

Sizes are characters; null and empty texts count as none, and a source of no
characters, or of target weight nought, has rate nought. A null source is a
source of its own. Rows with a null id draw as one document would; rows that
repeat an id are copied alike, and are dealt out by their texts too, so they
don't meet in one task unless they are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import stored, unused

#: Sources up to which their rates are broadcast: some 100 bytes each and a short array.
BROADCAST_SOURCES = 20_000
#: Largest rate of one table of probabilities.
TABLE_RATE = 128
#: Parts drawn together in one row, some 8,000 copies; and by how much the numbers of copies go up from block to block, which is more than a block can have.
DRAWS_A_BLOCK, BLOCK_STEP = 64, 20_000


def uniform(key: Column, seed: int, draw: Column | None = None) -> Column:
    """A number in (0, 1] from an id, a seed and a draw's number: the first 52 bits of an MD5."""
    draws = F.lit(str(seed)) if draw is None else F.when(draw == 0, str(seed)).otherwise(F.concat(F.lit(f"{seed}."), draw.cast("string")))
    text = F.concat_ws(":", draws, F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def draws_of(rate: Column) -> Column:
    """Into how many equal parts a rate is divided."""
    return F.greatest(F.ceil(rate / TABLE_RATE), F.lit(1)).cast("long")


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, … far into the tail, for a rate up to ``TABLE_RATE``."""
    steps = F.sequence(F.lit(1), (rate + 12 * F.sqrt(rate) + 40).cast("int"))
    start = F.struct((-rate).alias("logp"), F.exp(-rate).alias("cum"), F.array(F.exp(-rate)).alias("all"))

    def add(acc, k):
        logp = acc["logp"] + F.ln(rate / k)
        cum = acc["cum"] + F.exp(logp)
        return F.struct(logp.alias("logp"), cum.alias("cum"), F.concat(acc["all"], F.array(cum)).alias("all"))

    table = F.aggregate(steps, start, add, lambda acc: acc["all"])
    return F.when(rate > 0, table).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Each source with its characters and repetition rate.

    weights: target weight by source, nought for others; equal weights if None.
    budget: the mixture's size as a multiple of the corpus.
    """
    sizes = docs.groupBy(F.col(source_col).alias("_src")).agg(F.sum(F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        target = F.when(F.col("chars") > 0, 1.0).otherwise(0.0)
    else:
        target = F.lit(0.0)
        for name, w in weights.items():
            target = F.when(F.col("_src") == name, float(w)).otherwise(target)
    sizes = stored(sizes.withColumn("target", target), "sizes")
    totals = sizes.agg(F.sum("chars").alias("chars"), F.sum("target").alias("targets")).first()
    wanted = F.col("target") * F.lit(float(budget) * float(totals["chars"] or 0))
    given = F.lit(float(totals["targets"] or 0)) * F.col("chars")
    return sizes.select("_src", "chars", F.when((F.col("target") > 0) & (F.col("chars") > 0), F.try_divide(wanted, given)).otherwise(0.0).alias("rate"))


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The mixture: the columns of ``docs`` and copy (from 1), rate, shuffle_key, shuffled globally.

    Where ``docs`` has a column of one of these names, that stays as it is and
    the new one has an underscore before its name.
    """
    src, cum, draws, n, block = (unused(docs.columns, x) for x in ("_src", "_cum", "_draws", "_n", "_block"))
    copy, rate, shuffle_key = (unused(docs.columns, x) for x in ("copy", "rate", "shuffle_key"))
    of_source = F.col("rate")
    rates = source_rates(docs, weights, budget, source_col, text_col)
    rates = rates.select(F.col("_src").alias(src), of_source.alias(rate), draws_of(of_source).alias(draws), poisson_table(of_source / draws_of(of_source)).alias(cum))
    size = rates.agg(F.count(F.lit(1)).alias("n"), F.max(draws).alias("most")).first()
    if size["n"] <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    key, many = F.col(id_col), F.col(draws) > DRAWS_A_BLOCK
    rated = docs.join(rates, F.col(source_col).eqNullSafe(F.col(src)))
    if (size["most"] or 0) <= DRAWS_A_BLOCK:
        drawn = rated.withColumn(block, F.lit(0).cast("long"))
    else:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given stays: blocks are small, what comes of them isn't
        divided = rated.where(many).withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(draws) / DRAWS_A_BLOCK) - 1)))
        drawn = rated.where(~many).withColumn(block, F.lit(0).cast("long")).unionByName(divided.repartition(parts, key, F.xxhash64(F.col(text_col)), block))
    first = F.col(block) * DRAWS_A_BLOCK
    numbers = F.transform(F.sequence(first, F.least(first + DRAWS_A_BLOCK, F.col(draws)) - 1), lambda j: uniform(key, seed, j))  # an array, so each is computed once
    copies = F.aggregate(numbers, F.lit(0), lambda total, u: total + F.size(F.filter(cum, lambda c: c < u)))
    placed = F.md5(F.concat_ws(":", F.lit(f"{seed}/place"), F.coalesce(key.cast("string"), F.lit("")), F.col(copy).cast("string")))
    mixed = (
        drawn.withColumn(n, copies).where(F.col(n) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
        .withColumn(copy, F.col(block) * BLOCK_STEP + F.col(copy))
        .select(*docs.columns, copy, rate, placed.alias(shuffle_key))
    )
    return mixed.repartition(F.col(shuffle_key), F.xxhash64(F.col(text_col))).sortWithinPartitions(shuffle_key)

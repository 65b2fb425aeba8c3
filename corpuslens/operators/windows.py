"""Windows, samples and conversation histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group (rank), or of all rows if ``by`` is empty (unranked)."""
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def first_distinct(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def clause_gaps(chunks: DataFrame) -> DataFrame:
    """Missing clause numbers between neighbours under one parent.

    chunks: (spec_id, clause, section_title, document_order) → spec_id, parent,
    prev, next, missing, prev_title, next_title. The first title of a clause
    counts; clauses with an empty part, and leaves that aren't numbers, don't.
    """
    fine = chunks.where(F.col("clause").rlike(r"^[^.]+(\.[^.]+)*$") & F.regexp_extract("clause", r"([^.]*)$", 1).rlike(r"^\d+$"))
    firsts = fine.groupBy("spec_id", "clause").agg(F.min_by("section_title", F.struct("document_order", "section_title")).alias("title"))
    leaves = firsts.select("spec_id", F.regexp_extract("clause", r"^(.*?)\.?[^.]*$", 1).alias("parent"), F.regexp_extract("clause", r"(\d+)$", 1).cast("long").alias("leaf"), "title")
    order = Window.partitionBy("spec_id", "parent").orderBy("leaf")
    pairs = leaves.withColumns({"next": F.lead("leaf").over(order), "next_title": F.lead("title").over(order)})
    gaps = pairs.where(F.col("next") - F.col("leaf") > 1)
    return gaps.select("spec_id", "parent", F.col("leaf").alias("prev"), "next", F.sequence(F.col("leaf") + 1, F.col("next") - 1).alias("missing"), F.col("title").alias("prev_title"), "next_title")


def _in_turn(items: DataFrame, group: str, bucket: str, inside: list[Column], bucket_order: list[Column]) -> DataFrame:
    """Items numbered (_place) by taking the first of each bucket, then the second, and so on."""
    tiers = items.withColumn("_tier", F.row_number().over(Window.partitionBy(group, bucket).orderBy(*inside)))
    return tiers.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy("_tier", *bucket_order)))


def stratified_sample(items: DataFrame, targets: DataFrame, seed: int, default: int = 10) -> DataFrame:
    """Items (item_id, category, spec_id) by the targets (category, target) of their categories.

    A category within its target is taken whole; else items are taken from the
    documents in turn, in an order that the seed and the ids give.
    """
    key = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    joined = items.join(targets, "category", "left").withColumn("target", F.coalesce("target", F.lit(default)))
    placed = _in_turn(joined, "category", "spec_id", [key("item_id"), F.col("item_id")], [key("spec_id"), F.col("spec_id")])
    return placed.where(F.col("_place") <= F.col("target")).drop("_tier", "_place", "target")


def select_balanced(pool: DataFrame, targets: DataFrame, quota: DataFrame, coverage: str = "coverage") -> DataFrame:
    """Items (item_id, category, series, coverage) by category targets, series in turn by quota, best covered first."""
    joined = pool.join(targets, "category").join(quota, "series", "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    placed = _in_turn(joined, "category", "series", [F.coalesce(coverage, F.lit(0.0)).desc(), F.col("item_id")], [F.desc("quota"), F.col("series")])
    return placed.where(F.col("_place") <= F.col("target")).select("item_id", "category", "series", F.col("_place").alias("place"))


def plan_slots(targets: DataFrame, quota: DataFrame, oversample: float) -> DataFrame:
    """Slots for each category and series by largest remainder: (category, target), (series, quota) → category, series, slots.

    Both tables are small lists of names; every category meets every series.
    """
    whole = F.coalesce(F.nullif(F.aggregate("all", F.lit(0).cast("double"), lambda total, x: total + x["quota"]), F.lit(0.0)), F.lit(1.0))
    series = quota.agg(F.collect_list(F.struct("series", "quota")).alias("all")).withColumn("_one", F.lit(1))
    every = targets.withColumn("_one", F.lit(1)).join(F.broadcast(series), "_one").select("category", "target", whole.alias("whole"), F.explode("all").alias("s"))
    n = F.greatest(F.lit(1), F.bround(F.col("target") * oversample).cast("int"))
    raw = n * F.col("s.quota") / F.col("whole")
    shared = every.select("category", "s.series", n.alias("n"), F.floor(raw).cast("int").alias("base"), F.round(raw - F.floor(raw), 9).alias("rest"))
    left = F.col("n") - F.sum("base").over(Window.partitionBy("category"))
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("rest"), "series"))
    return shared.withColumns({"_left": left, "_place": place}).select("category", "series", (F.col("base") + (F.col("_place") <= F.col("_left")).cast("int")).alias("slots"))


def adjacent_runs(chunks: DataFrame, n: int = 3) -> DataFrame:
    """Runs of up to ``n`` (two at least) neighbouring chunks of a document, each from its first: spec_id, chunk_id, ids, content."""
    ahead = Window.partitionBy("spec_id").orderBy("document_order", "chunk_id").rowsBetween(0, n - 1)
    runs = chunks.select("spec_id", "chunk_id", F.collect_list("chunk_id").over(ahead).alias("ids"), F.array_join(F.collect_list("content").over(ahead), "\n\n").alias("content"))
    return runs.where(F.size("ids") >= 2)


def assign_ids(items: DataFrame, prefixes: dict[str, str], order: list[Column], default: str = "qa") -> DataFrame:
    """Numbered ids by category, such as ``def-001``."""
    short = F.lit(default)
    for k, v in prefixes.items():
        short = F.when(F.col("category") == k, v).otherwise(short)
    n = F.row_number().over(Window.partitionBy("category").orderBy(*order))
    return items.withColumn("id", F.concat(short, F.lit("-"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))))


# conversations: (conv_id, turn, role, text)


def history_window(messages: DataFrame, whole: int = 8, recent: int = 6) -> DataFrame:
    """Messages that aren't blank: all of short conversations are recent up to ``recent``; longer ones have an older block too (part)."""
    said = messages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    marked = said.withColumns({"_back": back, "_n": n}).withColumn("part", F.when(F.col("_back") <= recent, "recent").when(F.col("_n") > whole, "older"))
    return marked.where("part is not null").drop("_back", "_n")


def branch_history(messages: DataFrame, anchors: DataFrame) -> DataFrame:
    """Messages of a branch: up to the end of the anchor's turn, which is before the next user message; empty answers are left out.

    anchors: (conv_id, anchor), the turn that the branch starts from.
    """
    joined = messages.join(anchors, "conv_id")
    later_user = F.when((F.col("role") == "user") & (F.col("turn") > F.col("anchor")), F.col("turn"))
    cut = F.min(later_user).over(Window.partitionBy("conv_id", "anchor"))
    kept = joined.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col("turn") < F.col("_cut")))
    return kept.where((F.col("role") != "assistant") | (F.coalesce("text", F.lit("")) != "")).drop("_cut")


def rollback_turns(messages: DataFrame, n: int) -> DataFrame:
    """What is left of each conversation without its last ``n`` user messages and all after the first of those, with the number deleted.

    A conversation with fewer user messages loses all from its first one on.
    """
    users = messages.where("role = 'user'")
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    cutoff = users.withColumn("_b", back).where(F.col("_b") <= n).groupBy("conv_id").agg(F.min("turn").alias("_cut"))
    joined = messages.join(cutoff, "conv_id", "left")
    gone = F.coalesce(F.col("turn") >= F.col("_cut"), F.lit(False))
    return joined.groupBy("conv_id").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("deleted"), F.max(F.when(~gone, F.col("turn"))).alias("last_turn"))


def inflight(messages: DataFrame) -> DataFrame:
    """Conversations whose newest unfinished answer (assistant, status ok, empty) is still open: conv_id, turn."""
    open_ = messages.where((F.col("role") == "assistant") & (F.col("status") == "ok") & (F.coalesce("text", F.lit("")) == ""))
    return open_.groupBy("conv_id").agg(F.max("turn").alias("turn"))

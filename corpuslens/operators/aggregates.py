"""Aggregates over chunks, evaluations and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.sources.scratch import kept


def list_docs(chunks: DataFrame, release: str | None = None, series: str | None = None) -> DataFrame:
    """Documents with their number of chunks."""
    kept = chunks
    if release is not None:
        kept = kept.where(F.col("release") == release)
    if series is not None:
        kept = kept.where(F.col("series") == series)
    return kept.groupBy("spec_id", "release", "series", "title").agg(F.count(F.lit(1)).alias("n_chunks"))


def doc_sections(chunks: DataFrame) -> DataFrame:
    """Sections of each document with their number of chunks and first place, which orders them."""
    return chunks.groupBy("spec_id", "section_path", "section_title").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("document_order").alias("first_order"))


def platform_stats(tables: dict[str, DataFrame], tasks: DataFrame, usage: DataFrame, today: Column) -> DataFrame:
    """Row counts of tables, tasks by status, and sums of the last 7 days (8 dates, both ends included): (kind, name, value)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("rows").alias("kind"), F.lit(name).alias("name"), "value")
        out = one if out is None else out.unionByName(one)
    by_status = tasks.groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("tasks").alias("kind"), "name", "value")
    recent = usage.where((F.col("day") >= F.date_sub(today, 7)) & (F.col("day") <= today))
    sums = recent.agg(*[F.coalesce(F.round(F.sum(c), 6), F.lit(0.0)).alias(c) for c in ("tokens", "cost")])
    flat = sums.select(F.lit("last_7_days").alias("kind"), F.expr("stack(2, 'tokens', cast(tokens as double), 'cost', cost) as (name, value)"))
    return out.unionByName(by_status).unionByName(flat)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count_if(F.col("thumb") == "up").alias("up"), F.count_if(F.col("thumb") == "down").alias("down"), F.count(F.lit(1)).alias("total"))


def source_audit(manifest: DataFrame) -> DataFrame:
    """Documents, bytes and images by series, and in all (series null, overall = 1)."""
    return manifest.rollup("series").agg(
        F.grouping("series").cast("int").alias("overall"), F.count(F.lit(1)).alias("n_docs"), F.count_distinct("spec_id").alias("n_distinct"), F.sum("size").alias("bytes"), F.sum("n_images").alias("images")
    )


def eval_aggregate(results: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Means without nulls over all results and by each of ``by`` alone, with rates and the upper median of durations."""
    sets = [[F.col(b)] for b in by] + [[]]
    out = results.groupingSets(sets, *[F.col(b) for b in by]).agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("total"), *[F.round(F.avg(m), 9).alias(m) for m in metrics],
        F.round(F.avg((F.size("forbidden") > 0).cast("double")), 9).alias("forbidden_rate"), F.count_if(F.col("terminal_event") == "final").alias("n_final"),
    )
    counted = counts(results, by, "duration_ms")
    levels = [counted.select(*[F.col(b) if b == one else F.lit(None).cast(counted.schema[b].dataType).alias(b) for b in by], F.lit(level).alias("level"), VALUE, COUNT) for one, level in _levels(by)]
    every = levels[0]
    for one in levels[1:]:
        every = every.unionByName(one)
    keys = ["level", *by]
    return _joined(out, percentiles_of_counts(every, keys, {"duration_p50": (0.5, "upper")}), keys)


def _levels(by: list[str]) -> list[tuple[str | None, int]]:
    """Each key alone, then none, with the grouping id of the set."""
    full = (1 << len(by)) - 1
    return [(b, full & ~(1 << (len(by) - 1 - i))) for i, b in enumerate(by)] + [(None, full)]


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` with those of ``right`` that have the same keys; null equals null."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(renamed, on, "left").drop(*[f"_{k}" for k in keys])


VALUE, COUNT = "_value", "_count"


def counts(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """How often each group has each value."""
    return df.groupBy(*by, F.col(col).alias(VALUE)).agg(F.count(F.lit(1)).alias(COUNT))


def percentiles(df: DataFrame, by: list[str], col: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """Percentiles of each group, exactly: the keys and a column for each of ``wanted`` (name: p, kind).

    nearest:   the value at round(p · (n - 1)), halves to even; 0 for no values
    upper:     the value at index n // 2 of the sorted values (p is not used)
    median:    the middle value, or the mean of the two (p is not used)
    exclusive: interpolated at p · (n + 1); null for fewer than 10 values

    Nulls don't count. No group is gathered: equal values are counted first, and
    the counts are dealt by ranges of value, each of which knows how many come
    before it.
    """
    return percentiles_of_counts(counts(df, by, col), by, wanted)


def percentiles_of_counts(counted: DataFrame, by: list[str], wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """The same from ``counts``, or several of them together."""
    merged = counted.groupBy(F.struct(*by, F.lit(0)).alias("_key"), VALUE).agg(F.sum(COUNT).alias(COUNT))
    dealt = kept(merged.repartitionByRange("_key", VALUE).withColumn("_range", F.spark_partition_id()), "counts")
    some = dealt.where(F.col(VALUE).isNotNull())
    ranges = some.groupBy("_key", "_range").agg(F.sum(COUNT).alias("_in"))
    upward = Window.partitionBy("_key").orderBy("_range")
    told = ranges.select(F.col("_key").alias("_k"), F.col("_range").alias("_r"), (F.sum("_in").over(upward) - F.col("_in")).alias("_before"), F.sum("_in").over(Window.partitionBy("_key")).alias("_n"))
    inside = Window.partitionBy("_key", "_range").orderBy(VALUE)
    ranked = some.join(told, (F.col("_key") == F.col("_k")) & (F.col("_range") == F.col("_r"))).withColumn("_to", F.col("_before") + F.sum(COUNT).over(inside))

    def at(index: Column) -> Column:
        return F.max(F.when((index < F.col("_to")) & (index >= F.col("_to") - F.col(COUNT)), F.col(VALUE).cast("double")))

    n = F.col("_n")

    def one(p: float, kind: str) -> Column:
        if kind == "nearest":
            return at(F.bround(F.lit(p) * (n - 1)).cast("long"))
        if kind == "upper":
            return at(F.floor(n / 2))
        if kind == "median":
            return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
        place = F.lit(p) * (n + 1)
        j = F.least(F.greatest(F.floor(place), F.lit(1)), n - 1).cast("long")
        lo, hi = at(j - 1), at(j)
        return F.when(F.max("_n") >= 10, lo + (hi - lo) * F.max(place - j))

    found = ranked.groupBy(F.col("_key").alias("_k")).agg(*[one(*spec).alias(name) for name, spec in wanted.items()])
    groups = dealt.select("_key").distinct().join(found, F.col("_key") == F.col("_k"), "left")
    return groups.select(*[F.col("_key")[b].alias(b) for b in by], *[F.coalesce(name, F.lit(0.0)).alias(name) if spec[1] == "nearest" else F.col(name) for name, spec in wanted.items()])


def runs_summary(runs: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """Repeated runs: mean over items of each item's best and of its mean value; durations pooled over all runs."""
    per_item = runs.groupBy(*by, "item_id").agg(F.max(metric).alias("best"), F.avg(metric).alias("mean"))
    means = per_item.groupBy(*by).agg(F.round(F.avg("best"), 9).alias("mean_best"), F.round(F.avg("mean"), 9).alias("mean_mean"))
    return _joined(means, percentiles(runs, by, "duration_ms", {"p50": (0.5, "nearest"), "p95": (0.95, "nearest")}), by)


def delta(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of ``a`` less those of the baseline ``b``."""
    base = b.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    return a.join(base, keys).select(*keys, *[F.round(F.col(m) - F.col(f"_{m}"), 9).alias(m) for m in metrics])


def model_scoreboard(rows: DataFrame) -> DataFrame:
    """(model, predicted, correct, error, tokens) → totals, accuracy and parse rate of each model."""
    n = F.count(F.lit(1))
    right = F.count_if(F.col("correct"))
    parsed = F.count_if(F.col("predicted").isNotNull())
    return rows.groupBy("model").agg(
        n.alias("total"), parsed.alias("parsed"), right.alias("n_correct"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("tokens").alias("tokens"),
        F.round(right / n, 9).alias("accuracy"), F.round(parsed / n, 9).alias("parse_rate"),
    )


def _percent(part: Column, total: Column) -> Column:
    return F.floor(F.try_divide(100 * part, total)).cast("long")


def comparison_summary(scores: DataFrame, core: list[str]) -> DataFrame:
    """Each system on core and other items: answers, coverage, documents found, refusals; percentages rounded down.

    scores: (item_id, system, category, series, ok, coverage, spec_recall, verdict).
    """
    negative = F.col("category") == "negative"
    found, judged = F.col("spec_recall") & ~negative, F.col("verdict").isNotNull() & negative
    part = F.when(F.col("series").isin(core), "core").otherwise("tail")
    return scores.groupBy("system", part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), _percent(F.count_if(F.col("ok")), F.count(F.lit(1))).alias("answer_pct"), F.round(F.avg(F.when(~negative, F.col("coverage"))), 3).alias("coverage"),
        _percent(F.count_if(found), F.count_if(F.col("spec_recall").isNotNull() & ~negative)).alias("spec_hit_pct"),
        _percent(F.count_if(judged & (F.col("verdict") == "VALID_REFUSAL")), F.count_if(judged)).alias("refusal_pct"),
    )


def pairwise_summary(pairs: DataFrame) -> DataFrame:
    """(system_a, system_b, winner) → wins of each and ties."""
    w = F.col("winner")
    return pairs.groupBy("system_a", "system_b").agg(F.count_if(w == "1").alias("wins_a"), F.count_if(w == "2").alias("wins_b"), F.count_if(w == "TIE").alias("ties"), F.count(F.lit(1)).alias("n"))


def distribution_check(items: DataFrame, targets: DataFrame, tolerance: int = 5) -> DataFrame:
    """Items by category against targets (category, target): delta and OK, GAP, OVER or UNKNOWN."""
    counted = items.where(F.coalesce("category", F.lit("")) != "").groupBy("category").agg(F.count(F.lit(1)).alias("actual"))
    joined = counted.join(targets, "category", "full_outer").withColumn("actual", F.coalesce("actual", F.lit(0)))
    gap = F.col("actual") - F.col("target")
    status = F.when(F.col("target").isNull(), "UNKNOWN").when(F.abs(gap) <= tolerance, "OK").when(gap < 0, "GAP").otherwise("OVER")
    return joined.select("category", "actual", "target", gap.alias("delta"), status.alias("status"))


def filter_stats(routed: DataFrame) -> DataFrame:
    """Routed items by verdict, category and document: (kind, name, n)."""
    count = lambda df, kind: df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    kept = routed.where("verdict = 'kept'")
    return (
        count(routed.withColumnRenamed("verdict", "name"), "verdict").unionByName(count(kept.withColumnRenamed("category", "name"), "category"))
        .unionByName(count(kept.select(F.explode("specs").alias("name")), "spec"))
    )


def distribution(items: DataFrame) -> DataFrame:
    """Items by category and by each document they expect: (kind, name, n)."""
    count = lambda df, kind: df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count(items.withColumnRenamed("category", "name"), "category").unionByName(count(items.select(F.explode("specs").alias("name")), "spec"))


def chunk_quality(chunks: DataFrame) -> DataFrame:
    """By chunk type: lengths, share with a table rule and with formulae, table rows (capped at 50) in the middle."""
    size = F.char_length("content")
    rows = F.least(F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$"))), F.lit(50))
    ready = chunks.select("chunk_type", size.alias("size"), rows.alias("rows"), F.col("content").rlike(r"\|\s*:?-{2,}").alias("ruled"), F.col("content").contains("$").alias("formula"))
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 9).alias(c)
    out = ready.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), share("ruled"), share("formula"))
    for col in ("size", "rows"):
        out = _joined(out, percentiles(ready, ["chunk_type"], col, {f"mid_{col}": (0.5, "upper")}), ["chunk_type"])
    return out


def annotation_stats(chunks: DataFrame) -> DataFrame:
    """Chunks with formula notes by document and type, by document, and in all: symbols alone, lost formulae alone, both."""
    symbols, lost = F.col("content").contains("Formula symbols: "), F.col("content").contains("[Note: source markdown contains stripped")
    return chunks.rollup("spec_id", "chunk_type").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.count_if(symbols & ~lost).alias("symbols_only"), F.count_if(~symbols & lost).alias("lost_only"), F.count_if(symbols & lost).alias("both"),
    )


def golden_audit(items: DataFrame) -> DataFrame:
    """Items by source: how many, with forbidden phrases, facts, and facts that look like sentences."""
    sentence = lambda f: f.rlike(r"[.!?]$") | (F.size(F.split(f, r"\s+")) > 12)
    return items.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("forbidden") > 0).alias("with_forbidden"), F.sum(F.size("facts")).alias("n_facts"), F.sum(F.size(F.filter("facts", sentence))).alias("n_sentences"),
    )


def series_histogram(ids: DataFrame) -> DataFrame:
    """Distinct documents and clauses by series."""
    return ids.groupBy("series").agg(F.count_distinct("spec_id").alias("n_specs"), F.count_distinct("spec_id", "clause").alias("n_clauses"))

"""Cost, usage and quota, in batch. The streaming forms give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.joins import attach_price


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with their cost.

    calls: (kind, model, input_tokens, output_tokens, n_docs, doc_tokens). A
    re-ranking pays for its query once for each document and for the documents'
    tokens, a search for the call, all else for its tokens. Negatives count as
    nought, as do unknown and unbilled models.
    """
    p = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    priced = attach_price(calls, prices)
    cost = (
        F.when(F.col("kind") == "rerank", F.col("input_price") * (p("input_tokens") * p("n_docs") + p("doc_tokens")))
        .when(F.col("kind") == "search", F.col("call_price"))
        .otherwise(F.col("input_price") * p("input_tokens") + F.col("output_price") * p("output_tokens"))
    )
    return priced.withColumn("cost", cost).drop("input_price", "output_price", "call_price")


def usage_rows(calls: DataFrame) -> DataFrame:
    """Counters of each call that counts: those without a user or without any tokens or calls don't."""
    kept = calls.where(F.col("user_id").isNotNull() & ((F.col("input_tokens") + F.col("output_tokens") > 0) | F.col("kind").isin("rerank", "search")))
    of = lambda kinds, value: F.when(F.col("kind").isin(*kinds), value).otherwise(F.lit(0))
    return kept.select(
        "user_id", F.to_date("ts").alias("day"), "ts", of(["chat"], F.col("input_tokens")).cast("long").alias("llm_input_tokens"), of(["chat"], F.col("output_tokens")).cast("long").alias("llm_output_tokens"),
        of(["embedding"], F.col("input_tokens")).cast("long").alias("embedding_tokens"), of(["rerank"], F.lit(1)).cast("long").alias("rerank_calls"), of(["search"], F.lit(1)).cast("long").alias("web_search_calls"), "cost",
    )


COUNTERS = ["llm_input_tokens", "llm_output_tokens", "embedding_tokens", "rerank_calls", "web_search_calls"]


def usage_sums(digits: int = 6) -> list[Column]:
    return [*[F.sum(c).alias(c) for c in COUNTERS], F.round(F.sum("cost"), digits).alias("total_cost_usd")]


def usage_daily(calls: DataFrame) -> DataFrame:
    """Daily cube: one row for each user and UTC day."""
    return usage_rows(calls).groupBy("user_id", "day").agg(*usage_sums())


def cost_on(usage: DataFrame, day: Column) -> DataFrame:
    return usage.where(F.col("day") == day).agg(F.coalesce(F.round(F.sum("total_cost_usd"), 6), F.lit(0.0)).alias("cost"))


def cost_mtd(usage: DataFrame, today: Column) -> DataFrame:
    """Cost from the first of the month to today."""
    return usage.where(F.col("day").between(F.trunc(today, "month"), today)).agg(F.coalesce(F.round(F.sum("total_cost_usd"), 6), F.lit(0.0)).alias("cost"))


def cost_alerts(usage: DataFrame, today: Column, daily: float, critical: float, monthly: float) -> DataFrame:
    """Yesterday's cost and this month's up to today against limits; a limit of nought or less is off."""
    yesterday = F.date_sub(today, 1)
    sums = usage.where((F.col("day") == yesterday) | F.col("day").between(F.trunc(today, "month"), today)).agg(
        F.coalesce(F.round(F.sum(F.when(F.col("day") == yesterday, F.col("total_cost_usd"))), 6), F.lit(0.0)).alias("daily_cost"),
        F.coalesce(F.round(F.sum(F.when(F.col("day").between(F.trunc(today, "month"), today), F.col("total_cost_usd"))), 6), F.lit(0.0)).alias("monthly_cost"),
    )
    over = lambda c, limit: F.lit(limit > 0) & (F.col(c) > limit)
    return sums.select(yesterday.alias("day"), "daily_cost", "monthly_cost", over("daily_cost", daily).alias("daily_warning"), over("daily_cost", critical).alias("daily_critical"), over("monthly_cost", monthly).alias("monthly_warning"))


def rate_windows(events: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Requests in fixed windows from the epoch on: (event_id, user_id, bucket, ts) → window_start, n, over.

    limits: (seconds, most) by bucket; n is the request's place in its window,
    and over from place most + 1 on. Buckets without a limit are left out.
    """
    period, most = F.lit(None).cast("int"), F.lit(None).cast("int")
    for b, (s, k) in limits.items():
        period, most = F.when(F.col("bucket") == b, s).otherwise(period), F.when(F.col("bucket") == b, k).otherwise(most)
    timed = events.withColumns({"_p": period, "_m": most}).where("_p is not null")
    start = (F.floor(F.unix_timestamp("ts") / F.col("_p")) * F.col("_p")).cast("long")
    n = F.row_number().over(Window.partitionBy("user_id", "bucket", "window_start").orderBy("ts", "event_id"))
    return timed.withColumn("window_start", start).withColumn("n", n).withColumn("over", F.col("n") > F.col("_m")).drop("_p", "_m")


def daily_quota(events: DataFrame, tz: str, limit: int) -> DataFrame:
    """Requests of ordinary users by local day: n, and edge, ``first`` at the first and ``over`` at the first beyond the limit.

    Other roles are exempt; a limit of nought or less is off (no rows).
    """
    ordinary = events.where((F.col("role") == "user") & F.lit(limit > 0)).withColumn("local_day", F.to_date(F.from_utc_timestamp("ts", tz)))
    n = F.row_number().over(Window.partitionBy("user_id", "local_day").orderBy("ts", "event_id"))
    edge = F.when(F.col("n") == 1, "first").when(F.col("n") == limit + 1, "over")
    return ordinary.withColumn("n", n).withColumn("edge", edge).withColumn("over", F.col("n") > limit)


def run_event_fields(events: DataFrame) -> DataFrame:
    """Events of runs (run_id, seq, event, data, …) with what their data say: answer, citations, confidence, chunks, node, ms."""
    data = lambda path: F.get_json_object("data", path)
    return events.withColumns({
        "answer": data("$.answer"), "citations": data("$.citations"), "confidence": data("$.confidence").try_cast("double"), "chunks": data("$.chunks"),
        "node": data("$.node"), "ms": data("$.duration_ms").try_cast("long"),
    })


def fold_run_events(events: DataFrame) -> DataFrame:
    """Events of runs (run_id, seq, event, data) folded: answer, number of tokens, node durations, last lists, citations, confidence, terminal state, error."""
    last = lambda cond, value: F.max_by(F.when(cond, value), F.when(cond, F.col("seq")))
    ev = F.col("event")
    ended = ev.isin("final", "cancelled", "error")
    node = F.when((ev == "node_end") & F.col("node").isNotNull(), F.struct("seq", "node", "ms"))
    nodes = F.transform(F.array_sort(F.collect_list(node)), lambda x: F.struct(x["node"].alias("node"), x["ms"].alias("ms")))
    latest = F.filter(nodes, lambda x: x["ms"].isNotNull())
    return run_event_fields(events).groupBy("run_id").agg(
        F.coalesce(last(ev == "final", F.col("answer")), F.lit("")).alias("answer"), F.count_if(ev == "token").alias("n_tokens"), latest.alias("node_durations"),
        *[last(ev == c, F.col("chunks")).alias(c) for c in ("chunks_hit", "chunks_rerank", "chunks_expanded")],
        last(ev == "final", F.col("citations")).alias("citations"), F.coalesce(last(ev == "final", F.col("confidence")), F.lit(0.0)).alias("confidence"),
        F.coalesce(last(ended, ev), F.when(F.max(ev == "end"), "end"), F.lit("incomplete")).alias("terminal"), last(ev == "error", F.col("data")).alias("error"),
    )


def trailing_usage(usage: DataFrame, days: int = 7) -> DataFrame:
    """For each day with usage: sums of that day and the ``days`` before it (both ends included), and the month to date."""
    daily = usage.groupBy("day").agg(F.sum("total_cost_usd").alias("c"), F.sum("llm_input_tokens").alias("t"))
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    back = Window.partitionBy(F.lit(1)).orderBy(number).rangeBetween(-days, 0)
    month = Window.partitionBy(F.trunc("day", "month")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("day", F.round(F.sum("c").over(back), 6).alias("trailing_cost"), F.sum("t").over(back).alias("trailing_tokens"), F.round(F.sum("c").over(month), 6).alias("month_cost"))

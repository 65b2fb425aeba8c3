"""Streaming forms of rate windows, usage and trailing cost, by Spark's own aggregations.

Time is that of the event. Rows later than the watermark are dropped by Spark.
Quotas and runs, which need an order, are in ``processors``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.usage import COUNTERS, usage_rows


def rate_windows(events: DataFrame, bucket: str, seconds: int, most: int, delay: str = "10 minutes") -> DataFrame:
    """Requests of a bucket in windows from the epoch on: user_id, window_start, n, over.

    State of a window goes when the watermark passes its end by the delay.
    """
    own = events.where(F.col("bucket") == bucket).withWatermark("ts", delay)
    counted = own.groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.unix_timestamp("w.start").alias("window_start"), "n", (F.col("n") > most).alias("over"))


def usage_cube(calls: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running daily cube of calls with cost, by user and UTC day."""
    rows = usage_rows(calls.withWatermark("ts", delay))
    return rows.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.sum("cost").alias("total_cost_usd")).select("user_id", F.to_date("w.start").alias("day"), *COUNTERS, "total_cost_usd")


def upsert_into(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch's rows to a folder of its own, so that a replayed batch replaces itself; latest() reads them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key over all batches."""
    values = [c for c in rows.columns if c not in (*keys, "_batch", "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")


def trailing_usage(calls: DataFrame, days: int = 7, delay: str = "1 day") -> DataFrame:
    """As calls arrive, for each day: cost and tokens of that day and the ``days`` before it, and its month's cost up to it.

    Columns day, trailing_cost, trailing_tokens, month_cost. A call counts for its own
    day and those after it that are within ``days`` or in its month; tasks add these
    up before anything is shuffled. A day's state ends when the watermark of calls
    passes it by the longest of these spans.
    """
    span = max(days, 30)
    spread = usage_rows(calls).withColumn("_own", F.to_date("ts")).withColumn("_day", F.explode(F.sequence(F.col("_own"), F.greatest(F.date_add("_own", days), F.last_day("_own")))))
    dated = spread.withColumn("_at", F.col("_day").cast("timestamp")).withWatermark("_at", f"{span + 1} days {delay}")
    late = F.datediff("_day", "_own") <= days
    month = F.trunc("_day", "month") == F.trunc("_own", "month")
    summed = dated.groupBy(F.window("_at", "1 day").alias("w")).agg(
        F.sum(F.when(late, F.col("cost")).otherwise(0.0)).alias("trailing_cost"), F.sum(F.when(late, F.col("llm_input_tokens")).otherwise(0)).alias("trailing_tokens"),
        F.sum(F.when(month, F.col("cost")).otherwise(0.0)).alias("month_cost"),
    )
    return summed.select(F.to_date("w.start").alias("day"), "trailing_cost", "trailing_tokens", "month_cost")


def dedupe(chunks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Chunks (chunk_id, ts) whose id wasn't seen within the delay."""
    return chunks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["chunk_id"])

"""Search and navigation inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def search_doc(chunks: DataFrame, text: str, most: int = 50, like_mode: bool = False) -> DataFrame:
    """Chunks of each document whose title or clause contains a text, without regard to case; the first ``most`` in order.

    like_mode: ``%`` and ``_`` in the text stand for any text and any character.
    """
    def fits(c: str):
        low = F.lower(F.coalesce(c, F.lit("")))
        return low.like(f"%{text.lower()}%") if like_mode else F.contains(low, F.lit(text.lower()))

    order = Window.partitionBy("spec_id").orderBy("document_order", "chunk_id")
    return chunks.where(fits("section_title") | fits("clause")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def prefix_filter(chunks: DataFrame, prefix: str, mode: str = "segments") -> DataFrame:
    """Chunks under a clause: by its text (``5.3`` also takes ``5.30``) or by whole segments of section_path."""
    if mode == "text":
        return chunks.where(F.startswith("clause", F.lit(prefix)))
    parts = prefix.split(".")
    return chunks.where(F.slice("section_path", 1, len(parts)) == F.array(*[F.lit(p) for p in parts]))

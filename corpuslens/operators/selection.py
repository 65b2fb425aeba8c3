"""Selection of documents: filters, the newest release, what isn't indexed yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text


def filter_specs(manifest: DataFrame, spec_type: str, whitelist: list[str], ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Documents of one type whose series is listed; of these only ``ids`` (spec_id), and the first ``limit`` by id."""
    kept = manifest.where((F.col("spec_type") == spec_type) & F.col("series").isin(whitelist))
    if ids is not None:
        kept = kept.join(ids.select("spec_id").distinct(), "spec_id", "left_semi")
    return kept if limit is None else kept.orderBy("spec_id").limit(limit)


def select_glossary_docs(manifest: DataFrame, spec_type: str, whitelist: list[str], always: list[str]) -> DataFrame:
    """Documents of the listed series, and those always taken; none twice."""
    listed = (F.col("spec_type") == spec_type) & F.col("series").isin(whitelist)
    return manifest.where(listed | F.col("spec_id").isin(always))


def latest_release(manifest: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The row of the newest release of each document; the first of equals by ``ordinal``."""
    newest = Window.partitionBy("spec_id").orderBy(text.release_rank(F.col("release")).desc(), ordinal)
    return manifest.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def production_documents(manifest: DataFrame, spec_type: str, whitelist: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Newest releases first, then the filter: a document whose newest release is of another type is gone."""
    return filter_specs(latest_release(manifest, ordinal), spec_type, whitelist)


def only_new(docs: DataFrame, indexed: DataFrame, key: str = "spec_id") -> DataFrame:
    return docs.join(indexed.select(key).distinct(), key, "left_anti")


def keep_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def keep_missing(rows: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    """Rows without a score, or with a null one."""
    return rows.join(scores.where(F.col(score).isNotNull()).select(key).distinct(), key, "left_anti")


def latest_original(files: DataFrame) -> DataFrame:
    """Newest original of each document: files (spec_uid, name, ordinal) → (spec_uid, name, version).

    A version beats none, a larger one a smaller; the first of equals stays.
    """
    ranked = files.withColumn("version", text.doc_version(F.col("name")))
    newest = Window.partitionBy("spec_uid").orderBy(F.col("version").desc_nulls_last(), "ordinal")
    return ranked.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("spec_uid", "name", "version")

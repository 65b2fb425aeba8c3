"""An incremental corpus: changed and removed documents, from a listing of their files.

The listing (spec_id, path, digest) is a table of ``sources.snapshots``. Publishing a
new listing commits what differs from the one before. Its commits are the change
feed: each is a single small file, which a file stream reads; the documents that
differ between two versions come from the buckets whose folder differs.

A changed document is built again from all its files in the new listing, so it may
come in any number of deliveries; one without files is a tombstone, and its rows go.
Both are one commit of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources import snapshots
from corpuslens.sources.scratch import kept

LISTING = "spec_id string, path string, digest string"
_COMMIT = "bucket int, version int"


def _digests(rows: DataFrame) -> DataFrame:
    """A digest of each document's rows, in any order."""
    h = F.xxhash64("path", "digest")
    parts = [F.count(F.lit(1)).cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(F.xxhash64("digest", "path")).cast("string")]
    return rows.groupBy("spec_id").agg(F.concat_ws(":", *parts).alias("d"))


def listing_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents whose files differ: spec_id, op (``upsert`` or ``delete``)."""
    both = _digests(old).withColumnRenamed("d", "was").join(_digests(new).withColumnRenamed("d", "is"), "spec_id", "full")
    return both.where(~F.col("was").eqNullSafe(F.col("is"))).select("spec_id", F.when(F.col("is").isNull(), "delete").otherwise("upsert").alias("op"))


def publish_listing(files: DataFrame, path: str) -> dict[str, int]:
    """Make ``files`` (spec_id, path, digest) the listing; the counts of the commit. Nothing is committed if nothing changed."""
    spark = files.sparkSession
    now = kept(files.select(*(c.split()[0] for c in LISTING.split(", "))), "listing")
    changed = kept(listing_changes(snapshots.read_table(spark, path), now), "changed")
    return snapshots.replace_documents(now.join(changed.where("op = 'upsert'"), "spec_id", "left_semi"), path, changed)


def apply_listings(listing: str, corpus: str, applied: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over commits: brings the table ``corpus`` to the newest of them.

    ``build`` makes the rows of documents from their files (spec_id, path, digest).
    ``applied`` has the version of each batch, so a replayed batch does the same again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        until = batch.agg(F.max("version")).first()[0]
        since = spark.read.schema("version int, batch long").parquet(applied).where(F.col("batch") < number).agg(F.max("version")).first()[0]
        if until is not None and until > since:
            old, new = snapshots.changed_rows(spark, listing, since, until)
            changed = kept(listing_changes(old, new), "changed")
            snapshots.replace_documents(build(new.join(changed.where("op = 'upsert'"), "spec_id", "left_semi")), corpus, changed)
        told = max(since, until or 0)
        spark.createDataFrame([(told,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{applied}/batch={number}")

    return write


def stream_corpus(spark: SparkSession, listing: str, corpus: str, state: str, build: Callable[[DataFrame], DataFrame], commits_at_once: int = 100) -> None:
    """Take in the listing's commits that are there and stop; the next call goes on from there."""
    applied = f"{state}/applied"
    spark.createDataFrame([(0,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{applied}/batch=-1")
    commits = spark.readStream.schema(_COMMIT).option("maxFilesPerTrigger", commits_at_once).parquet(f"{listing}/commits")
    work = commits.writeStream.foreachBatch(apply_listings(listing, corpus, applied, build))
    work.option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()

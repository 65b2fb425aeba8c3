"""Writers by record, projections and exports. Tables replaced by document are in ``snapshots``."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with the same keys; of equal keys in ``new`` the first by content.

    Content is the other columns as JSON, so the result doesn't hang on the order of rows.
    """
    others = [c for c in new.columns if c not in keys]
    if others:
        content = F.struct(*others)
        once = new.groupBy(*keys).agg(F.min_by(content, F.to_json(content, {"ignoreNullFields": "false"})).alias("_content")).select(*keys, "_content.*").select(*new.columns)
    else:
        once = new.distinct()
    return existing.join(once.select(*keys), keys, "left_anti").unionByName(once, allowMissingColumns=True)


def upsert_manifest(existing: DataFrame, new: DataFrame, replace_revision: str | None = None) -> DataFrame:
    """Manifest with new rows by (release, spec_uid); first, all rows of one revision go if it is named."""
    kept = existing if replace_revision is None else existing.where(F.coalesce("dataset_revision", F.lit("")) != replace_revision)
    return upsert(kept, new, ["release", "spec_uid"])


def upsert_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(existing, new, ["chunk_id", "provider"])


def purge_documents(ids: DataFrame, tables: dict[str, DataFrame], key: str = "spec_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without some documents, and how many rows each lost: (sink, removed)."""
    wanted = ids.select(key).distinct()
    left = {name: df.join(wanted, key, "left_anti") for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        one = df.join(wanted, key, "left_semi").agg(F.count(F.lit(1)).alias("removed")).select(F.lit(name).alias("sink"), "removed")
        counts = one if counts is None else counts.unionByName(one)
    return left, counts


def finalize_corpus(chunks: DataFrame) -> DataFrame:
    """Number of chunks of each document of the merged corpus."""
    return chunks.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def to_payload(chunks: DataFrame) -> DataFrame:
    """Chunks for a vector store: id and all else as JSON."""
    return chunks.select("chunk_id", F.to_json(F.struct(*[c for c in chunks.columns if c != "chunk_id"])).alias("payload"))


def to_meta(chunks: DataFrame, provider: str) -> DataFrame:
    """Chunks for a relational table: nested columns as JSON, keyed by (chunk_id, provider)."""
    nested = {c for c, t in chunks.dtypes if t.startswith(("array", "map", "struct"))}
    return chunks.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in chunks.columns], F.lit(provider).alias("provider"))


def to_lexical(chunks: DataFrame) -> DataFrame:
    """Chunks for a lexical index: the columns that it reads."""
    return chunks.select("chunk_id", "spec_id", "clause", "section_title", "chunk_type", "content")


def export_jsonl(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, with times in ISO form."""
    rows.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").json(path)


def write_files(rows: DataFrame, root: str) -> int:
    """A file for each row (path under ``root``, content), written by the tasks; returns their number.

    ``root`` is a ``file:`` folder that the driver and all tasks share. A file gets
    its name once it is whole, so a task that is run again leaves no half files. Hadoop's
    local file system starts a process for each file and folder that it makes,
    and moves each file twice, which takes a hundred times as long as a small file.
    """
    if urlparse(root).scheme != "file":
        raise ValueError(f"{root} isn't a file: folder")
    folder = unquote(urlparse(root).path)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                to = os.path.join(folder, path)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                part = os.path.join(os.path.dirname(to), f".{uuid.uuid4().hex}")  # readers pass over hidden files
                with open(part, "wb") as out:
                    out.write((content or "").encode())
                os.replace(part, to)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def split_failures(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows that worked (without the error column) and those that failed."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def run_stats(per_doc: DataFrame) -> DataFrame:
    """A run's statistics from its documents (spec_id, error, n_chunks, tokens)."""
    failed = F.col("error").isNotNull()
    return per_doc.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"), F.coalesce(F.sum(F.when(~failed, F.col("n_chunks"))), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum(F.when(~failed, F.col("tokens"))), F.lit(0)).alias("tokens"),
    )


def sink_status(tables: dict[str, DataFrame], spec_id: str | None = None) -> DataFrame:
    """Rows and documents in each sink, of one document if given: (sink, n_rows, n_documents)."""
    out = None
    for name, df in tables.items():
        kept = df if spec_id is None else df.where(F.col("spec_id") == spec_id)
        one = kept.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("spec_id").alias("n_documents")).select(F.lit(name).alias("sink"), "n_rows", "n_documents")
        out = one if out is None else out.unionByName(one)
    return out

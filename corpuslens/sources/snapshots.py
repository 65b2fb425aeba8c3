"""Tables that are replaced by document and published by commit.

A table is a folder: ``data/`` holds Parquet files in folders that are never
changed once they are written, and ``commits/version=N`` holds one small file that
names, for each bucket, the folder with its rows and how many they are. A document
(``key``) belongs to the bucket of its hash, so a replacement rewrites the buckets of
its documents only, and the number of files follows the buckets, not the documents.

The commit's file appears by a single rename after all data are there: a reader
sees the table before or after a replacement, never between, and one that has
begun goes on reading the folders of its version. What a replacement deleted and
inserted is part of the same commit. One writer at a time; a second one that
commits the same version fails. Superseded folders stay until they are cleared.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslens.sources.scratch import kept

BUCKETS = 64
#: Rows of a bucket that one file holds, about; a bucket of more is written by several tasks.
FILE_ROWS = 1_000_000

_COMMIT = "bucket int, folder string, n_rows long, deleted long, inserted long, documents long, head string"


def _write_commit(spark: SparkSession, path: str, version: int, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("error").parquet(f"{path}/commits/version={version}")


def create_table(spark: SparkSession, path: str, schema: StructType, key: str = "spec_id", buckets: int = BUCKETS) -> None:
    """An empty table; an error if one is there."""
    head = json.dumps({"schema": schema.jsonValue(), "key": key, "buckets": buckets})
    _write_commit(spark, path, 0, [(b, None, 0, 0, 0, 0, head) for b in range(buckets)])


def commits(spark: SparkSession, path: str) -> DataFrame:
    """What each version changed: version, deleted, inserted, documents, n_rows (of the table after it)."""
    told = spark.read.schema(f"{_COMMIT}, version int").parquet(f"{path}/commits")
    return told.groupBy("version").agg(*[F.sum(c).alias(c) for c in ("deleted", "inserted", "documents", "n_rows")])


def _version(spark: SparkSession, path: str, version: int | None) -> tuple[int, list, dict]:
    told = spark.read.schema(f"{_COMMIT}, version int").parquet(f"{path}/commits")
    if version is None:
        version = told.agg(F.max("version")).first()[0]
    rows = told.where(F.col("version") == version).collect()  # one for each bucket
    if not rows:
        raise ValueError(f"there is no version {version} of {path}")
    return version, rows, json.loads(rows[0]["head"])


def _read(spark: SparkSession, head: dict, folders: set[str], path: str) -> DataFrame:
    schema = StructType.fromJson(head["schema"])
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*sorted(f"{path}/data/{f}" for f in folders))


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its last commit when this is called, or of an earlier version."""
    _, rows, head = _version(spark, path, version)
    return _read(spark, head, {f"{r['folder']}/bucket={r['bucket']}" for r in rows if r["folder"]}, path)


def changed_rows(spark: SparkSession, path: str, since: int, until: int) -> tuple[DataFrame, DataFrame]:
    """Rows of two versions in the buckets whose folder differs between them: all rows that differ, and their neighbours."""
    _, old, head = _version(spark, path, since)
    _, new, _ = _version(spark, path, until)
    place = lambda rows: {f"{r['folder']}/bucket={r['bucket']}" for r in rows if r["folder"]}
    was, now = place(old), place(new)
    return _read(spark, head, was - now, path), _read(spark, head, now - was, path)


def replace_documents(rows: DataFrame, path: str, documents: DataFrame | None = None) -> dict[str, int]:
    """Put ``rows`` in place of all that is there of their documents, and of ``documents`` (with the table's key), which may have no rows now.

    Returns the commit's version and counts: rows deleted, rows inserted, documents named.
    Rows without a key are refused.
    """
    spark = rows.sparkSession
    version, now, head = _version(spark, path, None)
    key, buckets = head["key"], head["buckets"]
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    columns = [f["name"] for f in head["schema"]["fields"]]
    new = kept(rows.select(*columns), "rows")
    if not new.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"rows without {key}")
    names = new.select(key)
    if documents is not None:
        names = names.unionByName(documents.where(F.col(key).isNotNull()).select(key))
    named = kept(names.distinct().withColumn("bucket", bucket), "named")
    touched = {r["bucket"]: (r["documents"], r["inserted"]) for r in named.groupBy("bucket").agg(F.count(F.lit(1)).alias("documents")).join(
        new.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("inserted")), "bucket", "left").fillna(0).collect()}  # buckets at most
    if not touched:
        return {"version": version, "deleted": 0, "inserted": 0, "documents": 0}
    old = _read(spark, head, {f"{r['folder']}/bucket={r['bucket']}" for r in now if r["folder"] and r["bucket"] in touched}, path)
    left = old.join(named.select(key), key, "left_anti").select(*columns)
    folder = uuid.uuid4().hex
    size = sum(r["n_rows"] for r in now if r["bucket"] in touched) + sum(n for _, n in touched.values())
    spread = max(1, -(-size // (FILE_ROWS * len(touched))))
    whole = left.unionByName(new).withColumn("bucket", bucket)
    dealt = whole.repartition(len(touched) * spread, F.col("bucket"), F.pmod(F.xxhash64(F.to_json(F.struct(*columns))), F.lit(spread))) if spread > 1 else whole.repartition(len(touched), "bucket")
    dealt.write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    counted = {r["bucket"]: r["n"] for r in spark.read.schema("bucket int").parquet(f"{path}/data/{folder}").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    commit = []
    for r in now:
        b = r["bucket"]
        if b in touched:
            n, (docs, inserted) = counted.get(b, 0), touched[b]
            commit.append((b, folder if n else None, n, r["n_rows"] + inserted - n, inserted, docs, r["head"]))
        else:
            commit.append((b, r["folder"], r["n_rows"], 0, 0, 0, r["head"]))
    _write_commit(spark, path, version + 1, commit)
    return {"version": version + 1, "deleted": sum(c[3] for c in commit), "inserted": sum(c[4] for c in commit), "documents": sum(c[5] for c in commit)}


def purge_documents(documents: DataFrame, path: str) -> dict[str, int]:
    """Remove all rows of ``documents``; the counts of the commit."""
    spark = documents.sparkSession
    _, _, head = _version(spark, path, None)
    return replace_documents(spark.createDataFrame([], StructType.fromJson(head["schema"])), path, documents)


def write_glossary(entries: DataFrame, documents: DataFrame, path: str) -> dict[str, int]:
    """Replace the entries of ``documents`` in a glossary's table; those without entries are emptied too."""
    return replace_documents(entries, path, documents)

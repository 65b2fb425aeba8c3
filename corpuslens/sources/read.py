"""Readers of corpora, manifests, records and expectations."""

from __future__ import annotations

import hashlib
import os
import re
from contextlib import contextmanager
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions import text as X
from corpuslens.sources.scratch import kept

FILES = "path string, size bigint"
MANIFEST_KEY = ["release", "spec_uid"]
#: Levels of folders that are dealt into tasks one by one: releases, series, documents. What is below is walked by the task of its document.
LEVELS = 3
#: Files and bytes of a reading task, about, and bytes of a batch that leaves it, unless one file has more.
TASK_FILES, TASK_BYTES, BATCH_BYTES = 1024, 64 << 20, 8 << 20
#: Extensions of texts that Spark's reader decompresses.
_COMPRESSED = r"\.(gz|bz2|deflate|lz4|snappy|zst|lzo|xz|br)$"


@contextmanager
def _few_listing_tasks(spark: SparkSession):
    """Folders are listed in tasks of many folders each: by default each is a task of its own, up to 10,000, which takes longer than its listing."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(8 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def _in_few_tasks(spark: SparkSession, read: DataFrame) -> DataFrame:
    """Files of a store that Spark lists and reads, in tasks of many files each: by default a task has a few, as each counts as 4 MB."""
    return read.coalesce(max(8 * spark.sparkContext.defaultParallelism, read.rdd.getNumPartitions() // 64))


def _shared(root: str, pattern: str = "*") -> str | None:
    """The folder of a ``file:`` root; none for other stores, and for roots and patterns with more than ``*`` and ``?`` of a name."""
    at = re.fullmatch(r"file:(?://)?(/(?!/)[^*?\[\]{}\\]*)", root)
    return at[1] if at and not re.search(r"[\[\]{}\\]", pattern) and os.path.isdir(at[1]) else None


def _walk(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files under a folder that the driver and all tasks share: path, size. Tasks list them; no names come to the driver.

    As with Spark's readers, hidden files, all in hidden folders, and empty files are left out.
    """

    def hidden(e: os.DirEntry) -> bool:
        if e.name.startswith(("_metadata", "_common_metadata")) and e.is_dir():
            return False
        return e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name or e.name.endswith("._COPYING_")

    def found(path: str, deep: bool):
        folders = [path]
        while folders:
            with os.scandir(folders.pop()) as entries:
                for e in entries:
                    if hidden(e):
                        continue
                    if e.is_dir():
                        if deep:
                            folders.append(e.path)
                        else:
                            yield e.path, None
                    elif e.is_file() and fnmatchcase(e.name, pattern) and (size := e.stat().st_size):
                        yield e.path, size

    def listed(deep: bool):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "size"])

        def run(batches):
            for batch in batches:
                rows = []
                for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                    for row in found(path, deep) if size is None else [(path, size)]:  # folders have no size
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

        return run

    rows = spark.createDataFrame([(folder.rstrip("/") or "/", None)], FILES)
    for _ in range(LEVELS):
        rows = rows.mapInArrow(listed(False), FILES).repartition(4 * spark.sparkContext.defaultParallelism)
    return kept(rows.mapInArrow(listed(True), FILES), "files")


def _dealt(files: DataFrame) -> DataFrame:
    """Files dealt into tasks that grow in number with the files and with their bytes."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_FILES), -(-size // TASK_BYTES)))


def _contents(files: DataFrame) -> DataFrame:
    """Files of a listing with all their bytes: path, content."""

    def run(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])

        for batch in batches:
            rows, held = [], 0
            for path in batch.column("path").to_pylist():
                with open(path, "rb") as file:
                    content = file.read()
                if rows and held + len(content) > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
                rows.append((path, content))
                held += len(content)
            yield batch_of(rows)

    return _dealt(files).mapInArrow(run, "path string, content binary")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files under a folder: path, size. Contents aren't read."""
    if folder := _shared(root):
        return _walk(spark, folder).select(F.concat(F.lit("file:"), "path").alias("path"), "size")
    with _few_listing_tasks(spark):
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _in_few_tasks(spark, read.select("path", F.col("length").alias("size")))


def read_corpus(spark: SparkSession, root: str, name: str = "raw.md") -> DataFrame:
    """Whole texts of every file of that name: release and document number from its path, text."""
    files = _walk(spark, folder, name) if (folder := _shared(root, name)) else None
    if files is not None and files.where(F.col("path").rlike(_COMPRESSED)).isEmpty():
        return _documents(_contents(files), F.col("path"), F.col("content").cast("string"))
    with _few_listing_tasks(spark):
        read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))  # it is encoded, but for plus
    return _in_few_tasks(spark, _documents(read, path, F.col("value")))


def _documents(files: DataFrame, path: Column, text: Column) -> DataFrame:
    part = lambda i: F.regexp_extract(path, r"([^/]+)/[^/]+/([^/]+)/[^/]+$", i)
    return files.select(part(1).alias("release"), part(2).alias("spec_uid"), text.alias("text"))


def build_manifest(files: DataFrame, name: str = "raw.md") -> DataFrame:
    """Documents of a listing (path, size) under RELEASE/SERIES/DOCUMENT/: those with a text file, with their images in order."""
    where = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)$"
    part = lambda i: F.regexp_extract("path", where, i)
    placed = files.select("path", "size", part(1).alias("release"), F.regexp_extract(part(2), r"^(\d+)", 1).alias("series"), part(3).alias("spec_uid"), part(4).alias("file")).where("spec_uid <> ''")
    is_text, is_image = F.col("file") == name, F.lower("file").rlike(r"\.(png|jpe?g|gif|webp|svg)$")
    grouped = placed.groupBy("release", "spec_uid").agg(
        F.max("series").alias("series"), F.max(F.when(is_text, F.col("path"))).alias("raw_md_path"), F.max(F.when(is_text, F.col("size"))).alias("raw_md_size"),
        F.array_sort(F.collect_list(F.when(is_image, F.struct("path", "size")))).alias("images"),
    )
    return grouped.where("raw_md_path is not null").withColumns({"spec_id": X.parse_spec_uid(F.col("spec_uid"))["spec_id"], "n_images": F.size("images")})


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, required: list[str] | None = None) -> DataFrame:
    """Records of JSON lines; blank and malformed lines are left out, and those where a required field is empty."""
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    for c in required or []:
        rows = rows.where(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    return rows.dropna(how="all")


def read_keyed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object whose keys are records: key and the record's fields. A file is one value, so it must fit a task."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,struct<{schema}>>")).alias("key", "r")).select("key", "r.*")


GOLDEN = """id string, category string, language string, question string, expected_specs array<struct<spec_id:string,sections:array<string>>>,
 expected_facts array<string>, forbidden array<string>, must_say_not_found boolean, source string, notes string"""


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their expectations; expected documents without a number are left out, absent lists are empty."""
    rows = spark.read.schema(GOLDEN).json(path, multiLine=True)
    none = F.array().cast("array<string>")
    specs = F.filter("expected_specs", lambda e: F.trim(F.coalesce(e["spec_id"], F.lit(""))) != "")
    tidy = F.transform(specs, lambda e: F.struct(F.trim(e["spec_id"]).alias("spec_id"), F.coalesce(e["sections"], none).alias("sections")))
    return rows.withColumns({
        "expected_specs": F.coalesce(tidy, F.array().cast("array<struct<spec_id:string,sections:array<string>>>")), "expected_facts": F.coalesce("expected_facts", none),
        "forbidden": F.coalesce("forbidden", none), "must_say_not_found": F.coalesce("must_say_not_found", F.lit(False)),
    })


def hash_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files with their SHA-256: path, size, sha256."""
    if folder := _shared(root, pattern):

        def run(batches):
            for batch in batches:
                paths, sizes, hashes = batch.column("path").to_pylist(), [], []
                for path in paths:
                    with open(path, "rb") as file:
                        hashes.append(hashlib.file_digest(file, "sha256").hexdigest())
                        sizes.append(file.tell())
                columns = [pa.array([f"file:{p}" for p in paths], pa.string()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "size", "sha256"])

        return _dealt(_walk(spark, folder, pattern)).mapInArrow(run, f"{FILES}, sha256 string")
    with _few_listing_tasks(spark):
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return _in_few_tasks(spark, read.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")))


def read_manifest(spark: SparkSession, path: str, release: str | None = None) -> DataFrame:
    """A manifest in order, of one release if given (a filter on the partition)."""
    rows = spark.read.parquet(path)
    return (rows if release is None else rows.where(F.col("release") == release)).orderBy("release", "series", "spec_uid")

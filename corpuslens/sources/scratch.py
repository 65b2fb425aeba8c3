"""A folder that the driver and all executors share, for tables between steps."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a temporary folder only where that is unset and the session is local."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslens-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/corpuslens-{name}-{uuid.uuid4().hex}"


def with_scheme(spark: SparkSession, path: str) -> str:
    """A scratch path under the full name of its store: where ``spark.checkpoint.dir`` has no scheme, the session's own folder in it tells the default one."""
    base, own = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.getCheckpointDir() or ""
    if not base or urlparse(base).scheme or not urlparse(own).scheme or f"{base.rstrip('/')}/" not in own:
        return path
    return own[: own.index(f"{base.rstrip('/')}/")] + path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch path and read again: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Materialised steps in the shared folder of the session.

Iterative work (model fits, snapshots) reads the same table many times.  It is
written once as Parquet below ``spark.checkpoint.dir``: lineage is cut, columns
stay prunable, and a lost executor only re-reads its files.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="trawlmill-")


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the session.

    Where it names none, a session whose tasks run in the driver's own process (master
    ``local``) uses a folder of its own; any other is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def fresh_path(spark: SparkSession, tag: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/trawlmill/{app}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write the table to the shared folder and return a scan of it."""
    path = fresh_path(df.sparkSession, tag)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more; anything outside the library's own folder is left alone."""
    spark = df.sparkSession
    own = f"{shared_dir(spark).rstrip('/')}/trawlmill/{spark.sparkContext.applicationId}/"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own.split(":", 1)[-1].lstrip("/") in folder:
            path = hadoop(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver's garbage go, and with it the shuffle files of steps that no table in hand is made from."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

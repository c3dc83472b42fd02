"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in the configured checkpoint folder; it is deleted when the application ends.

    Where none is configured, a local folder serves a local master; on a cluster
    that would be another folder on each machine, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="epochal-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root}/epochal-{spark.sparkContext.applicationId}"
    p, fs = _path(spark, path)
    if fs.mkdirs(p):
        fs.deleteOnExit(p)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, so that later steps neither recompute it nor depend on its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:  # what was shuffled for a table goes as soon as it is written, not when the driver happens to collect its garbage
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more, such as those of the rounds before."""
    for df in tables:
        p, fs = _path(df.sparkSession, df._saved)
        fs.delete(p, True)

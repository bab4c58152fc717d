"""Tables in the session's shared folder: they cut a plan's lineage, and are let go by name once their readers are written."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Unset it is one of this machine's, which only a local master may use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="dossier-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the session has ended; the shared folder's owner clears the rest
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder, and read back: any executor can be lost afterwards.

    The shuffle files behind it go with the write. The table goes with `release`, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dossier-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "snappy").option("parquet.enable.dictionary", "false").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_remove_at_exit, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._dossier_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes materialized tables. Whatever read them has to be written by then."""
    for table in tables:
        _remove(table.sparkSession, table._dossier_path)

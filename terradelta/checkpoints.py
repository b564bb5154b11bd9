"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a local master, as in tests, gets a temporary one;
    on a cluster it is an error, as other machines could not read the driver's own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Whether shuffle files of an action go with its end; Spark reads it when a DataFrame is made.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, estimate: bool = True) -> DataFrame:
    """The rows, written to the shared folder; the shuffle files that led to them go then, as nothing reads them again, and
    do not wait until the driver happens to collect its garbage. Spark keeps its estimate of the rows' size with them, and
    multiplies estimates in joins; loops with joins leave it out, as their rounds would make it a number of millions of digits."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        fresh = df.select("*")  # its own shuffles: those of df, if any were made, stay
    finally:
        spark.conf.set(_CLEANUP, before)
    rows = fresh.checkpoint()
    if estimate:
        return rows
    plain = spark._jsparkSession.internalCreateDataFrame(rows._jdf.queryExecution().toRdd(), rows._jdf.schema(), False)
    return DataFrame(plain, spark)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark can write, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

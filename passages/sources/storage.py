"""Where tables that outlive a job go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, as in tests, may do with a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="passages-")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet to the shared folder and read again: later stages don't work them out anew, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/passages-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """A path and the file system that has it, wherever Spark writes to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder; one that isn't there is none."""
    target, files = _at(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _at(spark, path)
    return files.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder; none if it isn't there."""
    target, files = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []

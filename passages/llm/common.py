"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space (fixed by the result contracts).
WORD = r"[^\x20\x09-\x0D]+"

#: ASCII white space, as one character class.
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes in memory up to which a side may be broadcast, and what a row of a few numbers and one item of an array take of them.
BROADCAST_BYTES, ROW_BYTES, ITEM_BYTES = 24 << 20, 60, 12


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, as in tests, may do with a temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="passages-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a SparkContext, so that operators also run where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_passages_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="passages-"), "passages.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("passages", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._passages_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet to the shared folder and read again.

    Cuts the lineage, survives the loss of executors and keeps later stages from computing it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/passages-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, items: int = 0, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Marks a side for broadcast if its count of rows, and of items in its arrays, shows that it fits BROADCAST_BYTES; else leaves it to a shuffled join.

    Call it on written tables: the count then only reads Parquet footers.
    """
    return F.broadcast(df) if df.count() * row_bytes + items * ITEM_BYTES <= BROADCAST_BYTES else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def words_of(text) -> "F.Column":
    """The words of a text as an array; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

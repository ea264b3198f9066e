"""Running values over keys of any size: rows are cut into sorted ranges of even size, worked on in parallel, and what earlier ranges hold is added.

A plain window by key puts all rows of a key into one task. Here a key with very many rows spans several ranges, each a task of its own. A range has
at most one key in common with the ranges before it, so what is carried over is one row a range at most: a broadcast bounded by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passages.sources.storage import kept

#: Names of the columns that a scan adds for a while.
RANGE, CARRIED = "_range", "_carried"


def in_ranges(rows: DataFrame, key: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range of (key, *order), written once, so that a task that runs again finds the same ranges.

    Rows that are equal in key and order share a range. Nulls come first.
    """
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(n, key, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def _carry(summaries: DataFrame, key: str, value: Column, before: bool = True) -> DataFrame:
    """Rows (key, RANGE, CARRIED): value over the summaries of the ranges before a range, or after it, of the same key. Ranges that continue nothing have no row."""
    frame = Window.partitionBy(key).orderBy(RANGE)
    frame = frame.rowsBetween(Window.unboundedPreceding, -1) if before else frame.rowsBetween(1, Window.unboundedFollowing)
    found = summaries.select(F.col(key).alias("_key"), F.col(RANGE).alias("_at"), value.over(frame).alias(CARRIED)).where(F.col(CARRIED).isNotNull())
    return F.broadcast(found)  # one row a range at most


def _with_carried(rows: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    return rows.join(carried, rows[key].eqNullSafe(carried["_key"]) & (rows[RANGE] == carried["_at"]), "left").drop("_key", "_at")


def running_sum(ranged: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value up to and with each row of its key. ranged: in_ranges() by the same key and order; null values count as nothing."""
    local = Window.partitionBy(RANGE, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy(key, RANGE).agg(F.sum(value).alias("_sum"))
    rows = _with_carried(ranged.withColumn(out, F.coalesce(F.sum(value).over(local), F.lit(0))), _carry(sums, key, F.sum("_sum")), key)
    return rows.withColumn(out, F.col(out) + F.coalesce(CARRIED, F.lit(0))).drop(CARRIED)


def last_seen(ranged: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the last value that isn't null, up to and with each row of its key. ranged as for running_sum()."""
    return _seen(ranged, key, order, value, out, F.last, F.max_by, True)


def next_seen(ranged: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the next value that isn't null, from each row of its key on."""
    return _seen(ranged, key, order, value, out, F.first, F.min_by, False)


def _seen(ranged, key, order, value, out, nearest, outermost, before) -> DataFrame:
    local = Window.partitionBy(RANGE, key).orderBy(*order)
    local = local.rowsBetween(Window.unboundedPreceding, 0) if before else local.rowsBetween(0, Window.unboundedFollowing)
    known = F.col(value).isNotNull()
    ends = ranged.groupBy(key, RANGE).agg(outermost(F.when(known, F.col(value)), F.when(known, F.struct(*order))).alias("_end"))
    rows = _with_carried(ranged.withColumn(out, nearest(value, ignorenulls=True).over(local)), _carry(ends, key, nearest("_end", ignorenulls=True), before), key)
    return rows.withColumn(out, F.coalesce(out, CARRIED)).drop(CARRIED)


def chain(instants: DataFrame, width: int) -> DataFrame:
    """Rows (key, at): of each key its first instant, then the first one at least width after that, and so on. instants: distinct rows (key, at), at not null.

    Where the next window may start is looked up for every instant at once; jumps of one, two, four ... windows are then made by joining
    jumps with themselves, and taken from the longest down. Rounds grow with the logarithm of the number of windows, and every round
    is one written table that is dealt out by instant: a key with very many hits uses every task.
    """
    here = instants.select("key", "at", F.lit(1).alias("kind"), F.col("at").alias("value"))
    later = instants.select("key", (F.col("at") + width).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("value"))
    order = ["at", "kind"]
    found = next_seen(in_ranges(here.unionByName(later), "key", order), "key", order, "value", "to").where("kind = 0 AND to IS NOT NULL")
    jumps = [kept(found.select("key", (F.col("at") - width).alias("at"), "to"), "jumps")]
    while jumps[-1].limit(1).count():
        last = jumps[-1]
        jumps.append(kept(last.alias("a").join(last.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.to") == F.col("b.at"))).select("a.key", "a.at", "b.to"), "jumps"))
    starts = kept(instants.groupBy("key").agg(F.min("at").alias("at")), "starts")
    for jump in reversed(jumps[:-1]):
        on = starts["key"].eqNullSafe(jump["key"]) & (starts["at"] == jump["at"])
        starts = kept(starts.union(starts.join(jump, on).select(starts["key"], F.col("to"))), "starts")
    return starts

"""Connected components by large and small stars: hubs lose their links to smaller ids step by step, and no group is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.sources.storage import kept


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) of all ids in edges (a, b), of any type with an order; component is the smallest id that can be reached.

    In turn every id hands its larger neighbours, and then its smaller ones, to the smallest of them. Minima are partial sums of a shuffle, and
    the joins have one row an id on one side, so that Spark may split a hub's rows on the other. Rounds grow with the logarithm of the
    longest path. Rows with a null are left out.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    ids = kept(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "ids")
    links, before = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"), None
    while (now := links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before:
        before = now
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = kept(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "least"), F.struct(F.col("a").alias("x"), "least"))).alias("l")).select(F.col("l.x").alias("a"), F.col("l.least").alias("b"))
        links = kept(small.where("a <> b").distinct(), "links")
    return ids.join(links.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))

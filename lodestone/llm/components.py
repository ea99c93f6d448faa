"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, free_shuffles


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) -> (id, root) for every id that has an edge; root: the least id of its component.

    Self loops and nulls are ignored, repeated edges count once. Nothing but two numbers goes to the driver.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "c")
        # large star: larger neighbours go to the least one
        e = both.join(least, F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the least one
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        moved = e.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = cut(moved.union(least.select("c", "m")).distinct())
        del both, least, moved
        free_shuffles(e.sparkSession)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id").union(e.select("v", "v").distinct())
        before = now
    raise RuntimeError("components did not settle")

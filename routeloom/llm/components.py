"""Connected components of an edge table by alternating large-star and small-star steps, each one aggregate and one join.

Nothing but two numbers a round reaches the driver, and every round's edges are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, released, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id long, component long), a stored table: the smallest id reachable, for every id that has an edge to another one."""
    spark = edges.sparkSession
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # large star: neighbours above a node go to its least neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: neighbours below a node, and itself, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        after = stored(small, "edges")
        mark = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        dropped(now)
        released(spark)
        now = after
        if mark == before:
            out = stored(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
            dropped(now)
            return out
        before = mark

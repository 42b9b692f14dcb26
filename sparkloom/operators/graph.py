"""Graph measures on an edge table (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out: repeated edges count each, loops for neither. One shuffle of partial sums."""
    edges = edges.filter("src <> dst")
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def hubs(edges: DataFrame, n: int) -> DataFrame:
    """The n nodes with the most edges, ties by node: a top-k per task, merged."""
    return degrees(edges).withColumn("degree", F.col("fan_in") + F.col("fan_out")).orderBy(F.desc("degree"), "node").limit(n)

"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.session import written


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reached) for edges ``a``, ``b`` of one type.

    Alternating large-star and small-star steps: each joins every edge with its node's
    smallest neighbour, so no neighbourhood is ever collected; a round is written to
    the shared folder. The number of rounds grows with the logarithm of the longest
    path, not with the size of a component.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "edges")
    state = None
    while True:
        # Large star: larger neighbours of each node move to its smallest neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        now = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Small star: each node and its smaller neighbours move to the smallest of them.
        low = now.groupBy("a").agg(F.min("b").alias("low"))
        moved = now.join(low, "a")
        now = written(moved.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                      .unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

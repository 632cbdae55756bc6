"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofuse.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of (a, b): neighbours move to the least of each other's."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) of each node of edges (a long, b long) that is not its component's least; root is that least."""
    now = stored(edges.where("a <> b").select("a", "b").distinct())
    print_ = None
    for _ in range(most_rounds):
        now = stored(_stars(_stars(now, True).distinct(), False).distinct())
        sums = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if sums == print_:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        print_ = sums
    raise RuntimeError("components did not settle")

"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.frames import cut


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars already: no node points twice, and none
    that points is pointed at."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.where("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, component): the smallest id reachable, for every id with a link.

    ``links`` has long columns ``a`` and ``b``; repeated links and loops are
    harmless.  Alternating large and small stars (each node passes its
    neighbours to the smallest of them) until only stars are left; a round is two
    aggregations with map-side combine and two equi-joins, whose hot nodes the
    skew join splits.  Every round is cut in the shared folder: the plan must not
    grow with the rounds.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                narrow=True)
    for _ in range(max_rounds):
        if _settled(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = cut(small, narrow=True)
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    return (edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct())

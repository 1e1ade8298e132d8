"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (pre-aggregated before its shuffle), one join back that AQE
can split at a hot vertex, and a distinct.  The edge list is written to the shared
checkpoint folder after every round, so a lost executor re-reads files; the number of
rounds grows with the logarithm of the longest path.  Nothing but two numbers per round
(edge count and checksum) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankline.session import cut_lineage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = (down.join(low, "u").where(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every vertex of an edge other than a root; root: the smallest vertex reachable.

    Vertices are longs.  Self loops, repeated edges and edges with a NULL end are ignored.
    """
    e = (edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
         .where(F.col("u") != F.col("v")).distinct())
    e = cut_lineage(e)
    before = None
    while True:
        now = _sum(e)
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        e = cut_lineage(_small_star(_large_star(e)))

"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, written


def _star(rows: DataFrame, n: int) -> DataFrame:
    """(u, v, m) with m the least neighbour of u; a node of very many neighbours is dealt over many tasks."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return spread_join(rows, least.select("u", "m"), ["u"], ["v"], total=n, counts=least.select("u", "n"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that occurs in an edge between two different nodes.

    The component is the smallest node reachable. Null ends are ignored, repeated edges count once, no edges give no
    rows; other columns are ignored. Each round's edges are written to the shared folder; rounds grow with the logarithm
    of the number of nodes. Minima are pre-aggregated before every shuffle and the joins split nodes of many neighbours.
    """
    u, v = F.col(a), F.col(b)
    links = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    links = written(links, "links")
    mark = None
    while True:
        seen = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == mark or not seen["n"]:
            break
        mark = (seen["n"], seen["s"])
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * seen["n"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = written(large, "large")
        small = _star(large, large.count())
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "links")
        discard(links, large)
        links = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

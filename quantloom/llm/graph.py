"""Connected components of links between numbered nodes, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that has a link and the smallest node it is linked to, over any number of links.

    Every round points the larger neighbours of each node, then the smaller ones, to its smallest neighbour; a
    component of depth d takes about log d rounds, and rounds end when one of them changes nothing. Rounds are written
    tables of no more files than their rows need, hot nodes are met by joins that adaptive execution can split, and
    nothing is gathered by node. Self-links and nulls are ignored."""
    larger, smaller = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")

    def fingerprint(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = materialise(links.where(F.col(a) != F.col(b)).select(larger, smaller).distinct(), "edges", rows=links.count())
    state = fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = materialise(small.distinct(), "edges", rows=2 * state[0])
        before, state = state, fingerprint(edges)
        if state == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

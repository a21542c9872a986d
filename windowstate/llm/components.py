"""Connected components of a links table, by alternating large-star and small-star steps on the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowstate.llm.common import table


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """links (a long, b long) -> (id, component): every id that a link names, with the smallest id it reaches.

    Each round links every node to the smallest node among its neighbours (larger neighbours first, then smaller
    ones), which keeps connectivity and ends in stars; rounds grow with the logarithm of the longest path. A node
    with very many neighbours is aggregated map-side first (min) and joined back, never gathered."""
    edges = table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
                  f"{tag}-edges")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = table(large, f"{tag}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v"))
        small = table(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                      f"{tag}-small")
        # stars: every node has one smaller neighbour, and no centre has a smaller one itself
        several = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        chained = small.select("u").join(small.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        edges = small
        if not several and not chained:
            break
    return (edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))

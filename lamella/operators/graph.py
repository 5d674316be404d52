"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.session import checkpoint

#: edges that a task gets at least: small tables are not spread over all partitions
EDGES = 100_000


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (columns a, b) with the smallest node it reaches.

    Alternating large-star and small-star steps: each is a minimum per node (combined map-side) and an equi-join, and
    the rounds grow with the logarithm of a component's size. Self-links and repeats do no harm; nulls are left out.
    """
    def tight(df: DataFrame, n: int) -> DataFrame:
        return df.coalesce(max(4, -(-n // EDGES)))

    edges = checkpoint(links.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, n = None, edges.count()
    while n:
        edges = tight(edges, n)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tight(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")), n).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = tight(large.join(least, "u"), n)
        edges = checkpoint(
            tight(
                small.select("u", F.col("m").alias("v"))
                .unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                .distinct(),
                n,
            )
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == state:
            break
        state, n = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

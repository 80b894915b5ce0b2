"""Connected components of a table of links, by rounds of joins whose results are written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.shared import stored


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, component (the smallest node that its links reach) for every node of links (a, b: not null).

    Alternating large-star and small-star steps: each node's larger neighbours move to its smallest one, then its
    smaller neighbours do. Rows never exceed the links, and rounds grow with the logarithm of a component's size.
    Raises an error if ``most_rounds`` aren't enough (2**50 nodes would do with less).
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", wave=True)
    n = edges.count()
    for _ in range(most_rounds):
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("low")).withColumn("low", F.least("n", "low"))
        large = both.filter("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()
        large = stored(large, "largestar", wave=True)
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("low").alias("v"))).distinct()
        small = stored(small, "smallstar", wave=True)
        now = small.count()
        same = now == n and not small.exceptAll(edges).take(1)
        edges, n = small, now
        if same:
            break
    else:
        raise RuntimeError(f"components are not done after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))

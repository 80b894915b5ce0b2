"""Rows whose key is in a set, where the scan itself skips what can't be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.operators.ranges import bucket_of
from rejoinder.operators.staged import written

#: Ranges of keys that a scan's filter names at most, and how many finer ones they are put together from.
RANGES, FINE = 32, 32


def _widest(bounds: list[tuple], ranges: int) -> list[tuple]:
    """At most this many ranges that cover the given ones (in order) and leave out the widest gaps, or even shares of them."""
    if len(bounds) <= ranges:
        return bounds
    try:
        gaps = [b[0] - a[1] for a, b in zip(bounds, bounds[1:], strict=False)]
        cuts = sorted(sorted(range(len(gaps)), key=lambda i: gaps[i], reverse=True)[: ranges - 1])
    except TypeError:  # keys without differences
        cuts = [len(bounds) * i // ranges - 1 for i in range(1, ranges)]
    firsts = [0, *(i + 1 for i in cuts)]
    return [(bounds[a][0], bounds[b - 1][1]) for a, b in zip(firsts, [*firsts[1:], len(bounds)], strict=True)]


def pruned_members(rows: DataFrame, key: str, members: DataFrame, ranges: int = RANGES) -> DataFrame:
    """The rows whose key is one of the members' (their first column).

    The distinct members are written once and cut into ranges, between which the widest gaps lie; the least and greatest
    of each become a filter that reaches the scan, where row groups and files whose statistics lie in a gap aren't read.
    A layout sorted by the key makes that most of them where members lie together. The semi-join that follows is exact;
    on large shuffles Spark adds a Bloom filter of its own to it. Null keys are no members.
    """
    own = written(members.select(F.col(members.columns[0]).cast(rows.schema[key].dataType).alias("member")).filter("member is not null").distinct(), "members")
    found = own.withColumn("range", bucket_of(own, ["member"], FINE * ranges, 1)).groupBy("range").agg(F.min("member").alias("least"), F.max("member").alias("most")).collect()  # at most FINE * ranges rows
    if not found:
        return rows.limit(0)
    bounds = _widest(sorted((r["least"], r["most"]) for r in found), ranges)
    inside = reduce(lambda a, b: a | b, [F.col(key).between(F.lit(a), F.lit(b)) for a, b in bounds])
    return rows.filter(inside).join(own, F.col(key) == F.col("member"), "left_semi")

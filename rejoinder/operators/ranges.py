"""Buckets of key ranges: places in a total order without one task that holds it.

Bounds are fixed by numbers and texts that the driver holds, so every evaluation of a plan, also one after a lost
executor, deals rows alike (bounds that Spark samples for itself may differ between two uses of one table).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.operators.staged import written

#: Rows sampled for each bound.
OVERSAMPLE = 32


def bucket_of(df: DataFrame, order: list[str], parts: int | None = None, oversample: int = OVERSAMPLE) -> Column:
    """The number of the range that a row's order columns lie in; ranges are in order and of about equal size.

    Bounds come from a sample of at most ``oversample`` rows for each of the parts, those with the smallest hash of their
    place in the table: rows that repeat a value are drawn each for itself, so a frequent value counts as it weighs. The
    sample is a job of its own; which rows it takes changes where ranges end, never what is computed from them.
    """
    spark = df.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = df.select(*order)
    drawn = own.withColumn("__draw", F.xxhash64(F.monotonically_increasing_id())).orderBy("__draw").limit(oversample * parts)
    rows = drawn.select(*order).orderBy(*order).collect()
    cuts = [rows[i] for i in range(oversample, len(rows), oversample)]
    cuts = [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]
    if not cuts:
        return F.lit(0)

    def bound(row) -> Column:
        return F.struct(*[F.lit(v).cast(own.schema[c].dataType).alias(c) for c, v in zip(order, row, strict=True)])

    key, step = F.struct(*order), max(1, math.isqrt(len(cuts)))
    block = F.greatest(F.lit(0), F.size(F.filter(F.array(*map(bound, cuts[::step])), lambda c: c <= key)) - 1) * step
    near = F.slice(F.array(*map(bound, cuts)), block + 1, F.lit(step))
    return block + F.size(F.filter(near, lambda c: c <= key))


def running(df: DataFrame, order: list[str], amount: str | None = None, by: list[str] | None = None, name: str = "before") -> DataFrame:
    """Adds what comes before each row in the order (rows, or the sum of amount), in all or within its ``by``.

    The input is written once; its sample, the ranges' sums and its rows are read from there.
    """
    by = by or []
    staged = written(df, "running")
    own = staged.withColumns({"__b": bucket_of(staged, [*by, *order]), "__g": F.struct(*by) if by else F.lit(0)})
    n = F.sum(amount) if amount else F.count("*")
    sizes = own.groupBy("__g", "__b").agg(n.alias("__n"))
    bases = sizes.select("__g", "__b", F.coalesce(F.sum("__n").over(W.partitionBy("__g").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # a row per range
    line = W.partitionBy("__g", "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return own.withColumn("__in", F.coalesce(n.over(line), F.lit(0))).join(bases, ["__g", "__b"]).withColumn(name, F.col("__base") + F.col("__in")).drop("__g", "__b", "__in", "__base")

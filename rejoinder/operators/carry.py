"""Nearest values along an order within keys, as a segmented scan: no task holds a key, however many rows it has.

Rows are cut into ranges of (key, order) of about equal size. In each range a window finds the nearest value of a row's
key, and an aggregate finds the range's last (or first) value with its key. Over these, one row a range, a scan carries
the last value into the ranges that follow; it counts for the rows there that have its key. So a key with all rows is
worked on by as many tasks as there are ranges, and what one task sees of a key is its range.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.operators.ranges import bucket_of
from rejoinder.operators.staged import written


@dataclass
class Nearest:
    """The nearest row before (or after) each row that has a value.

    ties: further order columns of rows that agree in the order given to ``carried``, which all lie in one range.
    """

    value: Column
    side: str = "before"
    ties: list[Column] = field(default_factory=list)


def carried(df: DataFrame, by: list[str], order: list[str], parts: int | None = None, **wanted: Nearest) -> DataFrame:
    """df with a column for each wanted value: that of the nearest row strictly before or after within ``by``.

    Rows are in order of ``order``, nulls first, then of a value's ties; together they must tell a key's rows apart for
    results that repeat. Null keys are a key. The input is written once; values go where their rows go, so that those
    of a range's border, one a range and value, are all that the scan holds.
    """
    spark = df.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    values = {name: f"__value_{name}" for name in wanted}
    staged = written(df.withColumns({values[name]: w.value for name, w in wanted.items()}), "carried")
    # explicit, so that windows, the aggregate and the join by range need no exchange of their own
    cut = staged.withColumn("__range", bucket_of(staged, [*by, *order], parts)).repartition(parts, "__range")
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("one"))
    borders = []
    for name, w in wanted.items():
        at = F.when(F.col(values[name]).isNotNull(), F.struct(key.alias("key"), *order, *[t.alias(f"__tie{i}") for i, t in enumerate(w.ties)]))
        pick = F.max_by if w.side == "before" else F.min_by
        borders.append(pick(F.struct(key.alias("key"), F.col(values[name]).alias("value")), at).alias(name))
    ends = cut.groupBy("__range").agg(*borders)  # a row for each range
    scans = {"before": W.orderBy("__range"), "after": W.orderBy(F.desc("__range"))}
    into = [F.last(name, ignorenulls=True).over(scans[w.side].rowsBetween(W.unboundedPreceding, -1)).alias(f"__into_{name}") for name, w in wanted.items()]
    rows = cut.join(ends.select("__range", *into), "__range")
    for name, w in wanted.items():
        line = W.partitionBy("__range", *by)
        if w.side == "before":
            line = line.orderBy(*order, *w.ties)
        else:  # from the last on, so that the frame only grows
            line = line.orderBy(*[F.col(c).desc() for c in order], *[t.desc() for t in w.ties])
        near = F.last(values[name], ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1))
        rows = rows.withColumn(name, F.coalesce(near, F.when(F.col(f"__into_{name}.key").eqNullSafe(key), F.col(f"__into_{name}.value"))))
    return rows.drop("__range", *values.values(), *[f"__into_{name}" for name in wanted])

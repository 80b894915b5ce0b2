"""Non-parametric statistics as lazy tables.

Ranks never come from a sort of all rows in one task. Rows are first counted by value (and group); ranks are found
over the distinct values, whose cumulative counts come from key ranges with offsets, so continuous columns with as many
values as rows stay spread out, within a group too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.functions import special
from rejoinder.functions import text as t
from rejoinder.operators.ranges import running

ALPHA = 0.05


def value_ranks(counts: DataFrame, value: str, n: str = "n", by: list[str] | None = None) -> DataFrame:
    """Of distinct values (of each by) with counts: the average rank of each value's rows."""
    return running(counts, [value], n, by, "__before").withColumn("rank", F.col("__before") + (F.col(n) + 1) / 2).drop("__before")


def quantiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Per by: n and, under each name, the exact quantile with linear interpolation. Nulls of value don't count.

    Rows are counted by value; cumulative counts over range partitions tell which values stand at the wanted places,
    so no task holds a group's values. A group without values has n 0 and null quantiles.
    """
    by = by or []
    own = df.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("__v"))
    keys = [f"__by{i}" for i in range(len(by))]
    counts = own.groupBy(*keys, "__v").agg(F.count("__v").alias("__n"))
    placed = running(counts, ["__v"], "__n", keys, "__start").withColumn("__g", F.struct(*keys) if keys else F.lit(0))
    j = placed.join(placed.groupBy("__g").agg(F.sum("__n").alias("n")), "__g")
    aggs = []
    for name, q in qs.items():
        place = (F.col("n") - 1) * F.lit(float(q))
        low, high = (F.max(F.when((F.col("__n") > 0) & (F.col("__start") <= at) & (at < F.col("__start") + F.col("__n")), F.col("__v"))) for at in (F.floor(place), F.ceil(place)))
        aggs.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    got = j.groupBy("__g", "n").agg(*aggs)
    return got.select(*[F.col("__g")[f"__by{i}"].alias(c) for i, c in enumerate(by)], "n", *qs)


def _counted(df: DataFrame, group: str, value: str, least: int, by: list[str] | None = None) -> DataFrame:
    """Counts by group and value (of each by) of the groups with ``least`` values or more, and the groups' sizes."""
    by = by or []
    own = df.select(*by, F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("g is not null and v is not null and not isnan(v)")
    counts = own.groupBy(*by, "g", "v").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(*by, "g").agg(F.sum("n").alias("size")).filter(F.col("size") >= least)
    return counts.join(sizes, [*by, "g"])


def kruskal(df: DataFrame, group: str, value: str, least: int = 3, by: list[str] | None = None) -> DataFrame:
    """One row (of each ``by``, which isn't null): h (corrected for ties), k, n, p, eta2, effect. All null where there
    are under two groups or one value. All tests by ``by`` are one pass over the rows."""
    by = by or []
    counts = _counted(df, group, value, least, by)
    values = counts.groupBy(*by, "v").agg(F.sum("n").alias("n"))
    ranked = value_ranks(values, "v", by=by).select(*by, "v", "rank")
    groups = counts.join(ranked, [*by, "v"]).groupBy(*by, "g").agg(F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum("n").alias("m"))
    ties = values.groupBy(*by).agg(F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"))
    total = groups.groupBy(*by).agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("q"), F.sum("m").alias("n"), F.count("*").alias("k"))
    total = total.join(ties, by) if by else total.crossJoin(ties)  # one row each
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    fix = 1 - F.col("ties") / (n * n * n - n)
    h = F.when((F.col("k") >= 2) & (fix > 0), raw / fix)
    out = total.select(*by, h.alias("h"), F.col("k").cast("int").alias("k"), F.col("n").cast("long").alias("n"))
    eta = F.when(F.col("n") > F.col("k"), (F.col("h") - F.col("k") + 1) / (F.col("n") - F.col("k")))
    return out.withColumn("p", special.chi2_p("h", F.col("k") - 1)).withColumn("eta2", eta).withColumn("effect", t.effect_label("eta2")).withColumn("stars", t.stars("p"))


def pairwise_mann_whitney(df: DataFrame, group: str, value: str, least: int = 3, alpha: float = ALPHA) -> DataFrame:
    """A row per pair of groups a < b: u of a, z (tie-corrected, continuity 0.5), p, p_bonferroni, significant."""
    counts = _counted(df, group, value, least)
    names = counts.select("g").distinct()
    pairs = names.alias("x").join(names.alias("y"), F.col("x.g") < F.col("y.g")).select(F.col("x.g").alias("a"), F.col("y.g").alias("b"))  # groups, not rows
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("g"))
    values = counts.join(sides, "g").groupBy("a", "b", "v").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("g") == F.col("a"), F.col("n")).otherwise(0)).alias("n_a"))
    ranked = value_ranks(values, "v", by=["a", "b"])
    s = ranked.groupBy("a", "b").agg(F.sum(F.col("n_a") * F.col("rank")).alias("r"), F.sum("n_a").alias("na"), F.sum("n").alias("n"), F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"))
    s = s.withColumn("n_pairs", F.count("*").over(W.partitionBy(F.lit(1))))  # a row per pair
    na, n = F.col("na").cast("double"), F.col("n").cast("double")
    nb = n - na
    u = F.col("r") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.when(sd > 0, (F.greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sd)
    out = s.select("a", "b", na.cast("long").alias("n_a"), nb.cast("long").alias("n_b"), u.alias("u"), z.alias("z"), "n_pairs")
    out = out.withColumn("p", special.normal_p("z"))
    return out.withColumn("p_bonferroni", F.least(F.col("p") * F.col("n_pairs"), F.lit(1.0))).withColumn("significant", F.col("p_bonferroni") < alpha).drop("n_pairs")


def spearman(df: DataFrame, x: str, y: str, least: int = 5) -> DataFrame:
    """One row: rho, n, p. Null where under ``least`` pairs are complete or a side is constant."""
    own = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    pairs = own.groupBy("x", "y").agg(F.count("*").alias("n"))
    rx, ry = (value_ranks(pairs.groupBy(c).agg(F.sum("n").alias("n")), c).select(c, F.col("rank").alias(f"r{c}")) for c in ("x", "y"))
    j = pairs.join(rx, "x").join(ry, "y")
    s = j.agg(F.sum("n").cast("double").alias("n"), *[F.sum(F.col("n") * e).alias(k) for k, e in {"sx": F.col("rx"), "sy": F.col("ry"), "sxy": F.col("rx") * F.col("ry"), "sxx": F.col("rx") * F.col("rx"), "syy": F.col("ry") * F.col("ry")}.items()])
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    rho = F.when((n >= least) & (vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))
    out = s.select(rho.alias("rho"), n.cast("long").alias("n"))
    t_ = F.when(F.abs("rho") < 1, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))).otherwise(F.when(F.col("rho").isNotNull(), F.lit(float("inf"))))
    return out.withColumn("p", special.student_p(t_, (F.col("n") - 2).cast("double")))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per pair of columns: a, b, r over rows where both are known; one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    wide = df.agg(*[(F.corr(F.col(a).cast("double"), F.col(b).cast("double")) if a != b else F.lit(1.0)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.expr(f"stack({len(pairs)}, " + ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs)) + ") as (a, b, r)"))


def pca(df: DataFrame, columns: list[str]) -> DataFrame:
    """Principal components of the standardised columns over complete rows: component, explained, loadings by column.

    The correlation matrix, a handful of numbers, is decomposed on the driver; signs make the largest loading positive.
    """
    import numpy as np

    r = pearson_matrix(df.na.drop(subset=columns), columns).collect()
    k = len(columns)
    m = np.array([x["r"] if x["r"] is not None else 0.0 for x in r], dtype=float).reshape(k, k)
    return _components(df.sparkSession, m, columns)


def _components(spark, matrix, columns):
    import numpy as np

    values, vectors = np.linalg.eigh(matrix)
    rows = []
    for i, j in enumerate(np.argsort(-values)):
        v = vectors[:, j] * np.sign(vectors[np.argmax(np.abs(vectors[:, j])), j])
        rows.append((f"PC{i + 1}", float(values[j] / len(columns)), bool(i == 0 and values[j] / len(columns) > 0.70), *map(float, v)))
    return spark.createDataFrame(rows, "component string, explained double, single_factor boolean, " + ", ".join(f"`{c}` double" for c in columns))


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """column, count, mean, std, min, quartiles (exact, linear), max."""
    long, keys = unpivoted(df, columns, by), [*(by or []), "column"]
    plain = long.groupBy(F.struct(*keys).alias("g")).agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    placed = quantiles(long, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, keys)
    return plain.join(placed.select(F.struct(*keys).alias("g"), "p25", "p50", "p75"), "g").select("g.*", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def unpivoted(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Long form: keep, column, value (double)."""
    keep = keep or []
    return df.select(*keep, F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', cast({c} as double)" for c in columns) + ") as (column, value)"))


def percentiles(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    return quantiles(df, value, {f"p{int(q)}": q / 100 for q in qs}, by)


def descriptive(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Rows, means and standard deviations by group, in one aggregate; null groups are left out."""
    aggs = [F.count("*").alias("n")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd")]
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(*aggs)


def crosstab(df: DataFrame, rows: str, columns: str, value: str) -> DataFrame:
    return df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows, columns).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    return quantiles(df.filter(F.col(group).isNotNull()), value, {"median": 0.5}, [group]).drop("n")


def buckets(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts in [edge, next edge); buckets without rows count 0. One pass."""
    pairs = list(zip(edges[:-1], edges[1:], strict=True))
    wide = df.agg(*[F.count_if((F.col(value) >= a) & (F.col(value) < b)).alias(f"b{i}") for i, (a, b) in enumerate(pairs)], F.count(value).alias("total"))
    return wide.select(F.expr(f"stack({len(pairs)}, " + ", ".join(f"{i}, cast({a} as double), cast({b} as double), b{i}" for i, (a, b) in enumerate(pairs)) + ") as (bucket, low, high, n)"), "total")


def interval_95(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean with its 95% t-interval by group."""
    s = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = special.student_975((F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt("n")
    return s.withColumn("half", half).select(group, "n", "mean", (F.col("mean") - F.col("half")).alias("low"), (F.col("mean") + F.col("half")).alias("high"))

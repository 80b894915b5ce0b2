"""Quality filters with their funnel, deterministic stratified samples and disjoint splits.

Draws are by the md5 of seed and id, so they are the same in any engine and on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.functions import text as t

MIN_PRE, MIN_MID, MIN_POST, MAX_TEXT, MAX_MINUTES = 50, 30, 30, 5000, 525_600
RICH_PRE, RICH_POST = 200, 100
#: Stratum targets (fixed values).
TARGETS = {
    ("reddit", "positive_reinforcement"): 500, ("reddit", "reframe"): 500, ("stackexchange", "reframe"): 1000, ("wikipedia", "warning"): 250,
    ("wikipedia", "restriction"): 250, ("wikipedia", "positive_reinforcement"): 150, ("wikipedia", "reframe"): 350,
}


def lengths_ok(pre="pre_intervention_text", mid="intervention_text", post="post_intervention_text") -> Column:
    def between(x, least):
        return F.coalesce(F.length(x).between(least, MAX_TEXT), F.lit(False))

    return between(pre, MIN_PRE) & between(mid, MIN_MID) & between(post, MIN_POST)


def response_ok(minutes="response_time_minutes") -> Column:
    return F.coalesce((F.col(minutes) > 0) & (F.col(minutes) <= MAX_MINUTES), F.lit(False))


def stages() -> dict[str, Column]:
    texts = ("pre_intervention_text", "intervention_text", "post_intervention_text")
    free = ~t.is_placeholder(texts[0]) & ~t.is_placeholder(texts[1]) & ~t.is_placeholder(texts[2])
    return {"response_time": response_ok(), "no_placeholder": free, "no_bot": ~t.is_bot("user_id"), "lengths": lengths_ok()}


def funnel(df: DataFrame, steps: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Rows left after each filter, in one pass: stage_no, stage, n."""
    passed, aggs = F.lit(True), [F.count("*").alias("n0")]
    for i, step in enumerate(steps.values(), 1):
        passed = passed & step
        aggs.append(F.count_if(passed).alias(f"n{i}"))
    wide = df.groupBy(*(by or [])).agg(*aggs)
    names = ["all", *steps]
    pairs = ", ".join(f"{i}, '{name}', n{i}" for i, name in enumerate(names))
    return wide.select(*(by or []), F.expr(f"stack({len(names)}, {pairs}) as (stage_no, stage, n)"))


def quality_filter(df: DataFrame) -> DataFrame:
    for step in stages().values():
        df = df.filter(step)
    return df


def draw(key: Column | str, seed: str | int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), t.col(key).cast("string")))


def first_rows(df: DataFrame, strata: list[str], key: str, seed: str | int = 42, first: Column | None = None, **ranks: Column) -> DataFrame:
    """Adds __n, a stratum's size, and for each name whether a row is among its stratum's first so many rows.

    Rows of a stratum are in order of first, draw and key. ranks: numbers of rows, from __n and columns that are alike in
    a stratum. Only ids are ranked: draws are uniform, so counts by stratum and the first digits of the draw (4,096 a
    stratum at most, or twice with ``first``) tell in which of these a wanted place lies, and there the row that has it is
    found. Its order is the stratum's cut-off, to which every row is then compared; rows aren't dealt by stratum at all.
    Cut-offs are a row for each stratum. Rows that share a key stand or fall together.
    """
    order = F.struct((first if first is not None else F.lit(0)).alias("f"), draw(key, seed).alias("d"), F.col(key).alias("k"))
    own = df.withColumns({"__s": F.struct(*strata), "__at": order})
    ids = own.select("__s", "__at", F.substring("__at.d", 1, 3).alias("__b"), F.col("__at.f").alias("__f"))
    counts = ids.groupBy("__s", "__f", "__b").agg(F.count("*").alias("__m"))
    every = W.partitionBy("__s")
    before = F.coalesce(F.sum("__m").over(every.orderBy("__f", "__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__s", "__f", "__b", "__m", before.alias("__before"), F.sum("__m").over(every).alias("__n"))
    alike = [c for c in df.columns if c in ("target",)]
    if alike:
        counts = counts.join(own.groupBy("__s").agg(*[F.max(c).alias(c) for c in alike]), "__s")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])).alias("__w")
    wanted = counts.select("*", each).select("__s", "__f", "__b", "__n", F.col("__w.name").alias("__name"), F.col("__w.rank").alias("__rank"), F.col("__before"), F.col("__m"))
    places = wanted.filter((F.col("__rank") > F.col("__before")) & (F.col("__rank") <= F.col("__before") + F.col("__m"))).select("__s", "__f", "__b", "__name", (F.col("__rank") - F.col("__before")).alias("__need"))
    line = W.partitionBy("__s", "__f", "__b", "__name").orderBy("__at")
    found = ids.join(places, ["__s", "__f", "__b"]).withColumn("__here", F.row_number().over(line)).filter("__here = __need")
    ends = found.groupBy("__s").agg(*[F.max(F.when(F.col("__name") == name, F.col("__at"))).alias(f"__end_{name}") for name in ranks])
    sizes = wanted.groupBy("__s").agg(F.first("__n").alias("__n"), *[F.max(F.when(F.col("__name") == name, F.col("__rank"))).alias(f"__rank_{name}") for name in ranks])
    cuts = sizes.join(ends, "__s", "left")
    out = own.join(cuts, "__s")
    inside = {name: (F.col(f"__rank_{name}") >= F.col("__n")) | F.coalesce(F.col("__at") <= F.col(f"__end_{name}"), F.lit(False)) for name in ranks}
    return out.withColumns(inside).drop("__s", "__at", *[f"__{kind}_{name}" for name in ranks for kind in ("rank", "end")])


def shuffled(df: DataFrame, key: str, seed: str | int = 42) -> DataFrame:
    return df.orderBy(draw(key, seed), key)


def sample_n(df: DataFrame, strata: list[str], n: int | Column, key: str, seed: str | int = 42) -> DataFrame:
    return first_rows(df, strata, key, seed, __in=F.lit(n) if isinstance(n, int) else n).filter("__in").drop("__in", "__n")


def rich() -> Column:
    return (F.length("pre_intervention_text") >= RICH_PRE) & (F.length("post_intervention_text") >= RICH_POST)


def quota_sample(df: DataFrame, targets: DataFrame, strata: list[str], key: str, preferred: Column, seed: str | int = 42) -> DataFrame:
    """Up to each stratum's target (columns strata, target): preferred rows first, others to fill up."""
    known = df.join(F.broadcast(targets), strata)  # a row per listed stratum
    order = F.when(F.coalesce(preferred, F.lit(False)), 0).otherwise(1)
    return first_rows(known, strata, key, seed, order, __in=F.col("target")).filter("__in").drop("__in", "__n", "target")


def target_table(spark, targets: dict = TARGETS, names=("platform", "intervention_type")) -> DataFrame:
    return spark.createDataFrame([(*k, n) for k, n in targets.items()], ", ".join(f"{x} string" for x in names) + ", target int")


def proportional_targets(counts: DataFrame, strata: list[str], total: int) -> DataFrame:
    """Shares of total by stratum size, halves to even; what rounding leaves goes to the first largest stratum.

    counts: strata and n, a row per stratum.
    """
    every = W.partitionBy(F.lit(1))
    rows = counts.withColumn("target", F.bround(F.col("n") / F.sum("n").over(every) * total).cast("long"))
    rows = rows.withColumn("__left", F.lit(total) - F.sum("target").over(every)).withColumn("__first", F.row_number().over(every.orderBy(F.desc("n"), *strata)) == 1)
    return rows.withColumn("target", F.col("target") + F.when(F.col("__first"), F.col("__left")).otherwise(0)).drop("__left", "__first", "n")


def proportional_sample(df: DataFrame, strata: list[str], total: int, key: str, seed: str | int = 42) -> DataFrame:
    targets = proportional_targets(df.groupBy(*strata).agg(F.count("*").alias("n")), strata, total)
    return first_rows(df.join(targets, strata), strata, key, seed, __in=F.col("target")).filter("__in").drop("__in", "__n", "target")


def holdout(df: DataFrame, strata: list[str], share: float, key: str, seed: str | int = 42, least: int = 5) -> DataFrame:
    """Adds is_holdout: round(n * share) rows of each stratum, halves to even; none of strata under ``least`` rows."""
    n = F.col("__n")
    take = F.when(n >= least, F.bround(n * share)).otherwise(0)
    return first_rows(df, strata, key, seed, is_holdout=take).drop("__n")


def split_801010(df: DataFrame, strata: list[str], key: str, seed: str | int = 42) -> DataFrame:
    """Adds split: a tenth each for val and test, one at least; strata under three rows are all train."""
    n = F.col("__n")
    tenth = F.greatest(F.lit(1), F.bround(n * 0.1)).cast("long")
    tight = tenth * 2 >= n
    val = F.when(tight, F.greatest(F.lit(1), F.floor((n - 1) / 2))).otherwise(tenth)
    test = F.when(tight, F.greatest(F.lit(1), n - 1 - val)).otherwise(tenth)
    cut = first_rows(df, strata, key, seed, __val=val, __both=val + test)
    return cut.withColumn("split", F.when(n < 3, "train").when(F.col("__val"), "val").when(F.col("__both"), "test").otherwise("train")).drop("__val", "__both", "__n")


def split_8020(df: DataFrame, strata: list[str], key: str, seed: str | int = 42) -> DataFrame:
    n = F.col("__n")
    take = F.greatest(F.lit(1), F.bround(n * 0.2))
    cut = first_rows(df, strata, key, seed, __val=take)
    return cut.withColumn("split", F.when(n < 3, "train").when(F.col("__val"), "val").otherwise("train")).drop("__val", "__n")


def overlaps(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that lie in two splits or more; empty if splits are disjoint."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")

"""Agreement between raters, consensus, and a model's agreement with it. Long form: record_id, rater, dim, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.functions import text as t

DIMS = ["empathy", "constructiveness", "respect", "social_cohesion"]
STYLES = ["punitive", "educative", "suggestive", "positive", "structural"]
DISAGREE = 1.5


def long_form(df: DataFrame, subject: str, rater: str, dims: list[str]) -> DataFrame:
    return df.select(F.col(subject).alias("record_id"), F.col(rater).alias("rater"), F.expr(f"stack({len(dims)}, " + ", ".join(f"'{d}', cast({d} as double)" for d in dims) + ") as (dim, score)"))


def icc(ratings: DataFrame, k: int, by: list[str] | None = None, least: int = 3) -> DataFrame:
    """ICC(2,1) and ICC(2,k) of complete subjects per by. ratings: by, record_id, rater, score."""
    by = by or []
    subjects = ratings.filter("score is not null").groupBy(*by, "record_id").agg(F.count("*").alias("have"), F.sum("score").alias("total"), F.sum(F.col("score") * F.col("score")).alias("squares"), F.collect_list(F.struct("rater", "score")).alias("own")).filter(F.col("have") == k)
    base = subjects.groupBy(*by).agg(F.count("*").alias("n"), F.sum("total").alias("t"), F.sum(F.col("total") * F.col("total")).alias("tt"), F.sum("squares").alias("ss"))
    raters = subjects.select(*by, F.inline("own")).groupBy(*by, "rater").agg(F.sum("score").alias("c")).groupBy(*by).agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    j = base.join(raters, by) if by else base.crossJoin(raters)  # one row each
    n, t_ = F.col("n").cast("double"), F.col("t")
    c = t_ * t_ / (n * k)
    s_subjects, s_raters, s_all = F.col("tt") / k - c, F.col("cc") / n - c, F.col("ss") - c
    ms, mr = s_subjects / (n - 1), s_raters / (k - 1)
    me = (s_all - s_subjects - s_raters) / ((n - 1) * (k - 1))
    j = j.filter(n >= least).select(*by, "n", ms.alias("ms"), mr.alias("mr"), me.alias("me"))
    ms, mr, me = F.col("ms"), F.col("mr"), F.col("me")
    d1, dk = ms + (k - 1) * me + k * (mr - me) / F.col("n"), ms + (mr - me) / F.col("n")
    return j.select(*by, "n", F.when(F.abs(d1) > 1e-12, (ms - me) / d1).alias("icc_2_1"), F.when(F.abs(dk) > 1e-12, (ms - me) / dk).alias("icc_2_k"))


def fleiss_kappa(ratings: DataFrame, k: int, categories: list[str] | None = None, least: int = 3) -> DataFrame:
    """One row: kappa, n over subjects that all k raters gave a (listed) category. ratings: record_id, category."""
    own = ratings.filter("category is not null")
    own = own.filter(F.col("category").isin(*categories)) if categories else own
    cells = own.groupBy("record_id", "category").agg(F.count("*").alias("m"))
    subjects = cells.groupBy("record_id").agg(F.sum("m").alias("have"), F.sum(F.col("m") * F.col("m")).alias("mm")).filter(F.col("have") == k)
    shares = cells.join(subjects.select("record_id"), "record_id", "left_semi").groupBy("category").agg(F.sum("m").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("qq"))
    one = subjects.agg(F.count("*").alias("n"), F.avg((F.col("mm") - k) / (k * (k - 1))).alias("po")).crossJoin(shares)  # one row each
    pe = F.col("qq") / (F.col("n") * F.col("n") * k * k)
    return one.select("n", F.when((F.col("n") >= least) & (pe < 1), (F.col("po") - pe) / (1 - pe)).alias("kappa"))


def pairwise_agreement(ratings: DataFrame) -> DataFrame:
    """Per pair of raters: share of equal scores and of scores within 1, averaged over dims."""
    a = ratings.filter("score is not null")
    j = a.alias("a").join(a.alias("b"), (F.col("a.record_id") == F.col("b.record_id")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.rater") < F.col("b.rater")))
    d = F.abs(F.col("a.score") - F.col("b.score"))
    dims = j.groupBy(F.col("a.rater").alias("rater_a"), F.col("b.rater").alias("rater_b"), F.col("a.dim").alias("dim")).agg(F.avg((d == 0).cast("double")).alias("exact"), F.avg((d <= 1).cast("double")).alias("within_1"))
    return dims.groupBy("rater_a", "rater_b").agg(F.avg("exact").alias("exact"), F.avg("within_1").alias("within_1"))


def disagreements(ratings: DataFrame, threshold: float = DISAGREE) -> DataFrame:
    """record_id, flagged: two raters differ by more than the threshold in some dim."""
    spread = ratings.groupBy("record_id", "dim").agg((F.max("score") - F.min("score")).alias("d"))
    return spread.groupBy("record_id").agg(F.coalesce(F.max(F.col("d") > threshold), F.lit(False)).alias("flagged"))


def plurality(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The commonest value per key, ties by the alphabet; null values don't vote."""
    votes = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("votes"))
    return votes.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("votes"), value))).filter("__n = 1").drop("__n")


def consensus(ratings: DataFrame, styles: DataFrame, adjudicated: DataFrame | None = None, threshold: float = DISAGREE) -> DataFrame:
    """record_id, flagged, dims (mean on the half-point grid), intervention_style_consensus; flagged rows take adj_ values.

    styles: record_id, rater, style. adjudicated: record_id, adj_<dim>, adj_intervention_style.
    """
    means = ratings.groupBy("record_id").pivot("dim", DIMS).agg(t.round_half(F.avg("score")))
    votes = plurality(styles.filter(F.col("style").isin(*STYLES)), ["record_id"], "style").select("record_id", F.col("style").alias("intervention_style_consensus"))
    out = means.join(disagreements(ratings, threshold), "record_id").join(votes, "record_id", "left")
    if adjudicated is not None:
        out = out.join(adjudicated, "record_id", "left")
        for d in DIMS:
            out = out.withColumn(d, F.when(F.col("flagged"), F.coalesce(F.expr(f"try_cast(adj_{d} as double)"), F.col(d))).otherwise(F.col(d)))
        style = F.lower(F.trim("adj_intervention_style"))
        out = out.withColumn("intervention_style_consensus", F.when(F.col("flagged") & style.isin(*STYLES), style).otherwise(F.col("intervention_style_consensus")))
    return out.select("record_id", "flagged", *DIMS, "intervention_style_consensus")


def model_agreement(pairs: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Per by: n, mae, bias, sd, limits of agreement, shares within 0.5 and 1, pearson. pairs: model, human."""
    d = F.col("model") - F.col("human")
    own = pairs.filter("model is not null and human is not null")
    return own.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"), (F.avg(d) - 1.96 * F.stddev_samp(d)).alias("loa_low"), (F.avg(d) + 1.96 * F.stddev_samp(d)).alias("loa_high"),
        F.avg((F.abs(d) <= 0.5).cast("double")).alias("within_half"), F.avg((F.abs(d) <= 1.0).cast("double")).alias("within_1"), F.corr("model", "human").alias("pearson"),
    ).filter(F.col("n") >= least)


def model_icc(pairs: DataFrame, by: list[str]) -> DataFrame:
    long = pairs.filter("model is not null and human is not null").select(*by, "record_id", F.expr("stack(2, 'model', model, 'human', human) as (rater, score)"))
    return icc(long, 2, by)


def bland_altman(pairs: DataFrame, keep: list[str]) -> DataFrame:
    return pairs.select(*keep, ((F.col("model") + F.col("human")) / 2).alias("mean"), (F.col("model") - F.col("human")).alias("diff"))


def verdict(iccs: DataFrame) -> DataFrame:
    """One row of icc_2_k values: verdict, min_icc, mean_icc."""
    s = iccs.agg(F.min("icc_2_k").alias("min_icc"), F.avg("icc_2_k").alias("mean_icc"))
    m, a = F.col("min_icc"), F.col("mean_icc")
    code = F.when(m.isNull(), "UNKNOWN").when(m >= 0.70, "GOOD").when((m >= 0.60) & (a >= 0.70), "ACCEPTABLE").when(m < 0.60, "POOR").otherwise("ACCEPTABLE")
    return s.withColumn("verdict", code)


def without_flagged(df: DataFrame, flag: str, yes: tuple[str, ...] = ("true", "1", "yes")) -> DataFrame:
    """Rows whose flag, as a text of any case, isn't one of ``yes``; a null flag isn't."""
    return df.filter(~F.coalesce(F.lower(F.trim(F.col(flag).cast("string"))).isin(*yes), F.lit(False)))

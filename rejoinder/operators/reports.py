"""Features of the analysis set and the tables of each report, which are made when they are asked for."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.functions import text as t
from rejoinder.operators import sampling, stats
from rejoinder.operators.agreement import DIMS

RATERS = ["r1", "r2", "r3"]
TEXTS = ["pre_intervention_text", "intervention_text", "post_intervention_text"]


def user_history(df: DataFrame, user: str = "user_id", at: str = "timestamp", tie: str = "record_id") -> DataFrame:
    """Adds each row's count of the user's rows, of earlier ones, and the user's tenure by the span of days."""
    every, line = W.partitionBy(user), W.partitionBy(user).orderBy(at, tie)
    days = F.floor((F.unix_micros(F.max(F.col(at).cast("timestamp")).over(every)) - F.unix_micros(F.min(F.col(at).cast("timestamp")).over(every))) / F.lit(86_400_000_000))
    return df.withColumns({"user_n_interventions_in_sample": F.count("*").over(every), "user_prior_interventions_in_sample": F.row_number().over(line) - 1, "user_tenure_estimate_category": t.tenure(days)})


def features(sample: DataFrame, scores: DataFrame, include_malformed: bool = False) -> DataFrame:
    """The analysis set: valid scored records with composite, text, intervention, platform and user features, no texts."""
    df = sample.join(scores, "record_id").filter(~F.coalesce("invalid_triple", F.lit(False)))
    if not include_malformed:
        bad = F.lit(False)
        for d in DIMS:
            bad = bad | F.coalesce(F.col(d) == -1, F.lit(True))
        df = df.filter(~bad)
    pre, mid, post = TEXTS
    meta = "platform_metadata"
    df = df.withColumns({f"__{k}": t.words(x) for k, x in zip(("pre", "mid", "post"), TEXTS, strict=True)})  # once, as a projection of their own
    df = df.withColumns({
        "prosociality_composite": F.bround(t.row_mean(*DIMS), 4), "pre_text_length": t.char_count(pre), "pre_word_count": t.count_of("__pre"), "pre_has_caps_abuse": t.caps_abuse_of("__pre"), "intervention_length": t.count_of("__mid"),
        "intervention_has_question": t.has_question(mid), "post_text_length": t.char_count(post), "post_word_count": t.count_of("__post"), "scoring_mode": F.when(F.length(t.strip(F.coalesce(post, F.lit("")))) > 0, "text_scored").otherwise("outcome_only"),
        "intervention_severity": t.severity("intervention_type"), "intervention_visibility": t.visibility("platform"), "intervention_timing": t.timing("response_time_minutes"), "response_time_category": t.timing("response_time_minutes"),
        "reddit_delta_awarded": F.when(F.col("platform") == "reddit", F.col("intervention_type") == "positive_reinforcement"), "se_post_score": F.expr(f"try_cast(get_json_object({meta}, '$.post_score') as double)"), "se_accepted_answer": F.get_json_object(meta, "$.accepted_answer_id").isNotNull(),
    }).drop("__pre", "__mid", "__post")
    if "intervener_role" not in sample.columns:
        df = df.withColumn("intervener_role", t.strict_role("platform", "intervention_type"))
    return user_history(df).drop(*TEXTS, meta, "rationale", "raw_response")


def main_and_wikipedia(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("platform") != "wikipedia"), df.filter(F.col("platform") == "wikipedia")


class Tables(Mapping):
    """Result tables by name; one that is given as a function is made when it is first asked for."""

    def __init__(self, given: dict):
        self.given, self.made = given, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            x = self.given[name]
            self.made[name] = x() if callable(x) else x
        return self.made[name]

    def __iter__(self):
        return iter(self.given)

    def __len__(self) -> int:
        return len(self.given)


def unpivoted(df: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """A row for each row and dimension: keys, dim, value."""
    parts = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("value")) for d in dims])).alias("x")
    return df.select(*keys, parts).select(*keys, "x.dim", "x.value")


def question(df: DataFrame, group: str, value: str = "prosociality_composite", dims: list[str] = DIMS) -> Mapping[str, DataFrame]:
    """A group's effect on a value: test, test per dimension, pairs, descriptives and medians."""
    return Tables({
        "kruskal": lambda: stats.kruskal(df, group, value), "kruskal_by_dim": lambda: stats.kruskal(unpivoted(df, [group], dims), group, "value", by=["dim"]).select("h", "k", "n", "p", "eta2", "effect", "stars", "dim"),
        "pairs": lambda: stats.pairwise_mann_whitney(df, group, value), "descriptive": lambda: stats.descriptive(df, group, [value, *dims]), "medians": lambda: stats.medians(df, group, value),
    })


def research_questions(df: DataFrame) -> Mapping[str, DataFrame]:
    """All tables of the six questions: type, history, role, timing, platform, dimensions."""
    value, out = "prosociality_composite", {}
    timed = df.filter(F.col("response_time_minutes") > 0)
    for name, rows, group in (("rq1_type", df, "intervention_type"), ("rq2_tenure", df, "user_tenure_estimate_category"), ("rq2b_role", df, "intervener_role"), ("rq3_timing", timed, "response_time_category"), ("rq4_platform", df, "platform")):
        if group in df.columns:
            found = question(rows, group)
            out |= {f"{name}_{k}": (lambda found=found, k=k: found[k]) for k in found}
    for d in (value, *DIMS):
        out[f"rq2_prior_spearman_{d}"] = lambda d=d: stats.spearman(df, "user_prior_interventions_in_sample", d)
    out["rq3_response_spearman"] = lambda: stats.spearman(timed, "response_time_minutes", value)
    if "intervener_role" in df.columns:
        out["rq2b_role_by_type"] = lambda: stats.crosstab(df, "intervener_role", "intervention_type", value)
    out["rq4_platform_by_type"] = lambda: stats.crosstab(df, "platform", "intervention_type", value)
    out["rq5_correlations"], out["rq5_pca"] = lambda: stats.pearson_matrix(df, DIMS), lambda: stats.pca(df, DIMS)
    return Tables(out)


def sensitivity(df: DataFrame, groups: list[str], four: list[str] = DIMS, dropped: str = "respect") -> DataFrame:
    """Kruskal-Wallis of the composite with and without a dimension, and what changes."""
    df = df.withColumns({"__four": t.row_mean(*four), "__three": t.row_mean(*[d for d in four if d != dropped])})
    out = None
    for g in groups:
        a, b = (stats.kruskal(df, g, c).select(F.col("h").alias(f"h{i}"), F.col("p").alias(f"p{i}"), F.col("eta2").alias(f"eta2_{i}"), F.col("effect").alias(f"effect{i}")) for i, c in ((4, "__four"), (3, "__three")))
        change = F.when(F.col("h4").isNull() | F.col("h3").isNull(), "insufficient groups").when((F.col("p4") < stats.ALPHA) != (F.col("p3") < stats.ALPHA), "significance changes").when(F.col("effect4") != F.col("effect3"), "effect label changes").otherwise("unchanged")
        row = a.crossJoin(b).select(F.lit(g).alias("group"), "*", change.alias("change"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def tier_d(df: DataFrame) -> DataFrame:
    """Adds stage flags and is_tier_d: a fit record by no bot whose author gave no answer."""
    pre, mid, post = TEXTS

    def fit(x, least):
        return ~t.is_placeholder(x) & F.coalesce(F.length(x).between(least, sampling.MAX_TEXT), F.lit(False))

    ok = fit(pre, sampling.MIN_PRE) & fit(mid, sampling.MIN_MID)
    silent = t.is_placeholder(post) | F.coalesce(F.length(post) < sampling.MIN_POST, F.lit(True))
    return df.withColumns({"not_bot": ~t.is_bot("user_id"), "texts_ok": ok, "no_answer": silent}).withColumn("is_tier_d", F.col("not_bot") & F.col("texts_ok") & F.col("no_answer"))


def tier_d_report(df: DataFrame, known: DataFrame | None = None) -> Mapping[str, DataFrame]:
    d = tier_d(df)
    fit = d.filter("not_bot and texts_ok")
    out = {
        "funnel": sampling.funnel(d, {"not_bot": F.col("not_bot"), "texts_ok": F.col("texts_ok"), "no_answer": F.col("no_answer")}),
        "rates": rates_by_sets(fit, ["platform", "intervention_type"], {"tier_d": F.col("is_tier_d")}),
        "pre_lengths": lambda: stats.percentiles(fit.withColumn("len", F.length(TEXTS[0])), "len", [10, 25, 50, 75, 90], ["is_tier_d"]),
        "caps": fit.withColumn("caps", t.caps_share(TEXTS[0])).groupBy("is_tier_d").agg(F.avg("caps").alias("mean_caps"), F.avg(t.word_count(TEXTS[0], 0)).alias("mean_words")),
        "response_minutes": lambda: stats.percentiles(fit.filter(sampling.response_ok()), "response_time_minutes", [10, 25, 50, 75, 90], ["platform"]),
    }
    if known is not None:
        out["known"] = marked(fit.filter("is_tier_d"), known, "record_id", "is_known").agg(F.count_if("is_known").alias("n_known"), F.count("*").alias("n"))
    return Tables(out)


def rates_by_sets(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Counts and percentages of flags over all, each key, and all keys together, from one grouping-sets aggregate."""
    flagged = df.withColumns({f"__{k}": v for k, v in flags.items()})
    sets = [[], *[[F.col(k)] for k in keys], *([[F.col(k) for k in keys]] if len(keys) > 1 else [])]
    grouped = flagged.groupingSets(sets, *keys)
    aggs = [F.count("*").alias("n"), *[F.count_if(F.col(f"__{k}")).alias(f"n_{k}") for k in flags]]
    out = grouped.agg(F.grouping_id().alias("level"), *aggs)
    return out.select(*keys, "level", "n", *[f"n_{k}" for k in flags], *[(100.0 * F.col(f"n_{k}") / F.col("n")).alias(f"pct_{k}") for k in flags])


def matched(sample: DataFrame, labels: DataFrame, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """The sample with its labels, and the labels that no row of the sample has: to be reported, as they get lost."""
    return sample.join(labels, key), labels.join(sample.select(key), key, "left_anti")


def marked(df: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    """Adds whether the key is in known."""
    own = known.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(own, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def audit(scores: DataFrame, sample: DataFrame, dims: list[str]) -> Mapping[str, DataFrame]:
    """Counts of malformed, invalid and valid scores, their spread, and whether to go on. Null keys are kept."""
    bad = F.lit(False)
    for d in dims:
        bad = bad | F.coalesce(F.col(d) == -1, F.lit(True))
    j = scores.join(sample.select("record_id", "platform", "intervention_type"), "record_id", "left").withColumns({"malformed": bad, "invalid": ~bad & F.coalesce("invalid_triple", F.lit(False))})
    flags = {"malformed": F.col("malformed"), "invalid": F.col("invalid"), "valid": ~F.col("malformed") & ~F.col("invalid")}
    valid = j.filter("not malformed and not invalid")
    long = stats.unpivoted(j, dims).filter("value >= 1")
    spread = long.groupBy("column").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (100 * F.avg((F.col("value") == 1).cast("double"))).alias("pct_floor"), (100 * F.avg((F.col("value") == 5).cast("double"))).alias("pct_ceiling"))
    spread = spread.join(stats.percentiles(long, "value", [5, 10, 25, 50, 75, 90, 95], ["column"]).drop("n"), "column")
    s = j.agg(F.count("*").alias("n"), F.count_if("malformed").alias("n_malformed"), F.count_if("invalid").alias("n_invalid"), F.count_if(~F.col("malformed") & ~F.col("invalid")).alias("n_valid"), F.count_if(~F.col("malformed") & ~F.col("invalid") & (F.col("confidence") < 0.5)).alias("n_low"))
    issues = F.array_compact(F.array(F.when(F.col("n_malformed") > 0.02 * F.col("n"), "malformed over 2%"), F.when(F.col("n_invalid") > 0.10 * F.col("n"), "invalid over 10%"), F.when(F.col("n_valid") < 50_000, "under 50000 valid"), F.when(F.col("n_low") > 0.10 * F.col("n_valid"), "low confidence over 10%")))
    return {"rates": rates_by_sets(j, ["platform", "intervention_type"], flags), "distribution": spread, "confidence": stats.buckets(valid, "confidence", [0, 0.5, 0.7, 0.9, 1.001]), "gate": s.withColumn("issues", issues).withColumn("go", F.size("issues") == 0)}


def label_checks(labelled: DataFrame, dims: list[str] = DIMS) -> Mapping[str, DataFrame]:
    """Rates of invalid rows, histograms and correlations, and the rows to review."""
    mean = t.row_mean(*dims)
    ones = F.lit(True)
    for d in dims:
        ones = ones & (F.col(d) == 1.0)
    valid = labelled.filter(~F.coalesce("invalid_triple", F.lit(False)) & F.col("label_error").isNull()).withColumn("mean_score", mean)
    return Tables({
        "invalid": labelled.groupBy("platform", "intervention_type").agg(F.count("invalid_triple").alias("total"), F.sum(F.col("invalid_triple").cast("int")).alias("n_invalid")).withColumn("pct", 100.0 * F.col("n_invalid") / F.col("total")),
        "values": stats.unpivoted(valid, dims).groupBy("column", "value").count(), "correlations": stats.pearson_matrix(valid, dims), "confidence": stats.buckets(valid, "confidence", [0, 0.6, 0.7, 0.8, 0.9, 1.01]),
        "low_confidence": valid.filter("confidence < 0.65").orderBy("confidence", "record_id").limit(10), "respect_without_empathy": valid.filter("respect >= 4 and empathy <= 1.5").orderBy("record_id").limit(10),
        "high": valid.filter("mean_score >= 4.5").orderBy(F.desc("mean_score"), "record_id").limit(10), "all_ones": valid.filter(ones).agg(F.count("*").alias("n")),
    })


def wide_ratings(long: DataFrame, values: list[str]) -> DataFrame:
    """A row per record and a column rater_value for each rater and value; the first non-null of repeats."""
    return long.groupBy("record_id").pivot("rater", RATERS).agg(*[F.min(v).alias(v) for v in values])


def confidence_report(long: DataFrame) -> Mapping[str, DataFrame]:
    """Raters' confidence: by rater, against deviation, consensus, platform and style; and a row per record.

    long: record_id, rater, platform, intervention_style, dims, confidence_tier1, confidence_style.
    """
    c = long.withColumns({k: t.confidence_level(k) for k in ("confidence_tier1", "confidence_style")}).withColumns({"level": t.confidence_rank("confidence_tier1"), "style_level": t.confidence_rank("confidence_style"), "composite": t.row_mean(*DIMS)})

    def counted(by, level, rows=c):
        return rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col(level) == i).alias(k) for i, k in enumerate(("low", "medium", "high"), 1)], F.avg(level).alias("mean_level"))

    others = W.partitionBy("record_id")
    n, s = F.count("composite").over(others), F.sum("composite").over(others)
    deviation = F.when((n > 1) & F.col("composite").isNotNull(), F.abs(F.col("composite") - (s - F.col("composite")) / (n - 1)))
    dev = c.withColumn("deviation", deviation)
    per = c.groupBy("record_id").agg(F.first("platform", True).alias("platform"), F.count("*").alias("raters"), F.avg("level").alias("mean_conf_tier1_num"), F.min("level").alias("min_conf_tier1"), F.max("level").alias("max_conf"), F.stddev_pop("composite").alias("cross_rater_composite_sd"), *[F.stddev_samp(d).alias(f"sd_{d}") for d in DIMS])
    complete = F.col("raters") == len(RATERS)  # an absent rater counts as sure
    sure = F.when(complete & (F.col("max_conf") == 1), "all_low").when(complete & (F.col("max_conf") < 3), "all_not_high").otherwise("any_high")
    label = per.withColumn("group", sure)
    groups = label.unionByName(label.filter("group = 'all_low'").withColumn("group", F.lit("all_not_high")))
    style = c.withColumn("style", F.lower(F.trim("intervention_style")))
    return Tables({
        "by_rater": counted("rater", "level"), "style_by_rater": counted("rater", "style_level"), "rater_test": lambda: stats.kruskal(c, "rater", "level"), "deviation": dev.groupBy("confidence_tier1").agg(F.avg("deviation").alias("mean_deviation"), F.count("deviation").alias("n")),
        "deviation_test": lambda: stats.spearman(dev, "level", "deviation"), "consensus": groups.groupBy("group").agg(F.count("*").alias("n"), *[F.avg(f"sd_{d}").alias(f"sd_{d}") for d in DIMS]), "by_platform": counted("platform", "level"), "platform_test": lambda: stats.kruskal(c, "platform", "level"),
        "by_style": counted("style", "style_level", style), "style_test": lambda: stats.kruskal(style, "style", "style_level"), "records": per.select("record_id", "platform", "mean_conf_tier1_num", "min_conf_tier1", "cross_rater_composite_sd").orderBy("mean_conf_tier1_num", "record_id"),
    })


def densities(df: DataFrame, group: str, value: str, points: int = 100) -> DataFrame:
    """Each group's Gaussian kernel density at evenly spaced points from its least to its greatest value: group, x, density.

    The bandwidth is Scott's: the sample deviation times n ** (-1/5). Values are counted first, so each distinct one is
    met with the points once. A group of one value has density 1 there.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    n, s1 = F.sum("n"), F.sum(F.col("n") * F.col("v"))
    of = counts.groupBy(group).agg(n.alias("size"), F.min("v").alias("least"), F.max("v").alias("most"), (s1 / n).alias("mean"))  # a row for each group
    spread = counts.join(of, group).groupBy(group, "size", "least", "most").agg(F.sum(F.col("n") * F.pow(F.col("v") - F.col("mean"), 2)).alias("ss"))
    spread = spread.withColumn("h2", F.when(F.col("size") > 1, F.col("ss") / (F.col("size") - 1) * F.pow("size", F.lit(-0.4))))
    place = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    kernel = F.exp(-F.pow(F.col("x") - F.col("v"), 2) / (2 * F.col("h2"))) / F.sqrt(2 * F.lit(math.pi) * F.col("h2"))
    met = counts.join(spread, group).select("*", place).withColumn("x", F.col("least") + (F.col("most") - F.col("least")) * F.col("k") / (points - 1))
    one = F.col("least") == F.col("most")
    return met.groupBy(group, "k", "x", "size", one.alias("one")).agg(F.sum(F.col("n") * F.when(~one, kernel)).alias("sum")).select(group, "k", "x", F.when(F.col("one"), 1.0).otherwise(F.col("sum") / F.col("size")).alias("density"))


def figure_tables(df: DataFrame, pairs: DataFrame) -> Mapping[str, DataFrame]:
    """What the figures plot: densities and quantiles per platform, intervals per type and role, and Bland-Altman points."""
    from rejoinder.operators.agreement import bland_altman

    return Tables({
        "densities": densities(df, "platform", "prosociality_composite"), "violins": lambda: stats.percentiles(df, "prosociality_composite", [5, 25, 50, 75, 95], ["platform"]), "type_intervals": stats.interval_95(df, "intervention_type", "prosociality_composite"),
        "role_intervals": stats.interval_95(df, "intervener_role", "prosociality_composite"), "bland_altman": bland_altman(pairs, ["record_id", "dim"]),
    })

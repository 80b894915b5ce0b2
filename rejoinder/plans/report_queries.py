"""Queries of whole reports on stand-in records, with DuckDB equivalents; they are added to the catalogue's.

Records are made of ``documents`` (texts, scores, platforms) and ratings of ``lineitem``, by the same rules on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.functions import text as t
from rejoinder.operators import agreement, reports, sampling, scoring, stats
from rejoinder.plans.catalogue import CLEAN, RATINGS, _kruskal_sql, _ratings, query

DIMS = agreement.DIMS
PLATFORMS = ["reddit", "stackexchange", "wikipedia"]
KINDS = ["warning", "restriction", "positive_reinforcement", "reframe"]

# Tail probabilities in SQL ----------------------------------------------------------------------------------------


def chi2_p(h: str, df: str) -> str:
    """P(chi-squared > h): one less the series of the lower incomplete gamma function."""
    return f"(CASE WHEN {h} IS NULL THEN NULL WHEN {h} <= 0 THEN 1.0 WHEN {h} > 1500 THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 1500), lambda j: exp(-({h}) / 2 + (({df}) / 2.0 + j) * ln(({h}) / 2) - lgamma(({df}) / 2.0 + j + 1))))) END)"


def normal_p(z: str) -> str:
    return chi2_p(f"(({z}) * ({z}))", "1")


def student_p(x: str, df: str) -> str:
    """Two-sided: one less the series of the incomplete beta function."""
    y = f"(({x}) * ({x}) / (({df}) + ({x}) * ({x})))"
    return f"(CASE WHEN {x} = 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 3000), lambda j: exp((0.5 + j) * ln({y}) + ({df}) / 2.0 * ln(1 - {y}) + lgamma(0.5 + ({df}) / 2.0 + j) - lgamma(1.5 + j) - lgamma(({df}) / 2.0))))) END)"


EFFECT = "CASE WHEN {0} < 0.01 THEN 'negligible' WHEN {0} < 0.06 THEN 'small' WHEN {0} < 0.14 THEN 'medium' ELSE 'large' END"
STARS = "CASE WHEN {0} < 0.001 THEN '***' WHEN {0} < 0.01 THEN '**' WHEN {0} < 0.05 THEN '*' ELSE 'ns' END"


def kruskal_row(table: str, group: str, value: str, lead: str) -> str:
    """lead, h, k, n, p, eta2, effect, stars."""
    return f"SELECT {lead}, round(h, 4) AS h, k::INT AS k, n::BIGINT AS n, round(p, 6) AS p, round(e, 6) AS eta2, {EFFECT.format('e')} AS effect, {STARS.format('p')} AS stars FROM (SELECT *, (h - k + 1) / (n - k) AS e, {chi2_p('h', '(k - 1)')} AS p FROM {_kruskal_sql(table, group, value)})"


def kruskal_columns(df: DataFrame, **lead: str) -> DataFrame:
    return df.select(*[F.lit(v).alias(k) for k, v in lead.items()], F.round("h", 4).alias("h"), "k", "n", F.round("p", 6).alias("p"), F.round("eta2", 6).alias("eta2"), "effect", "stars")


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Stand-in records -------------------------------------------------------------------------------------------------

RECORDS = """(SELECT ['reddit', 'stackexchange', 'wikipedia'][doc_id % 3 + 1] AS platform, printf('%s_%06d', ['reddit', 'stackexchange', 'wikipedia'][doc_id % 3 + 1], doc_id) AS record_id, CASE WHEN doc_id % 29 = 0 THEN 'AutoModerator' WHEN doc_id % 4 = 0 THEN 'u' || (doc_id // 40) ELSE source || '-' || (doc_id % 5) END AS user_id,
 ['warning', 'restriction', 'positive_reinforcement', 'reframe'][doc_id // 3 % 4 + 1] AS intervention_type, doc_id * 90000 AS seconds, ((doc_id * 37) % 3000 - 20)::DOUBLE AS response_time_minutes,
 substr(text, 1, length(text) // 3) AS pre, substr(text, length(text) // 3 + 1, length(text) // 3) AS mid, CASE WHEN doc_id % 11 = 0 THEN ' [Deleted] ' ELSE substr(text, 2 * (length(text) // 3) + 1) END AS post, doc_id % 50 AS post_score,
 CASE WHEN doc_id % 50 = 7 THEN -1 ELSE 1 + (n_chars % 9) / 2.0 END::DOUBLE AS empathy, CASE WHEN doc_id % 50 = 7 THEN -1 ELSE 1 + (n_chars // 9 % 9) / 2.0 END::DOUBLE AS constructiveness, CASE WHEN doc_id % 50 = 7 THEN -1 ELSE 1 + (doc_id * 5 % 9) / 2.0 END::DOUBLE AS respect,
 CASE WHEN doc_id % 50 = 7 THEN -1 ELSE 1 + ((n_chars + doc_id) % 9) / 2.0 END::DOUBLE AS social_cohesion, doc_id % 40 = 3 AS invalid_triple, (doc_id % 101) / 100.0::DOUBLE AS confidence, doc_id FROM documents)"""


def records(tab) -> DataFrame:
    """RECORDS under the names that reports expect."""
    d, i, n = tab("documents"), F.col("doc_id"), F.col("n_chars")
    platform, kind = F.array(*map(F.lit, PLATFORMS)), F.array(*map(F.lit, KINDS))
    broken, third = i % 50 == 7, F.floor(F.length("text") / 3).cast("int")  # each part is a third of the text, the last with the rest

    def score(x):
        return F.when(broken, F.lit(-1.0)).otherwise(1 + x / 2.0).cast("double")

    d = d.withColumn("platform", F.get(platform, (i % 3).cast("int")))
    return d.select(
        "platform", F.format_string("%s_%06d", "platform", i).alias("record_id"), F.when(i % 29 == 0, "AutoModerator").when(i % 4 == 0, F.concat(F.lit("u"), F.floor(i / 40).cast("string"))).otherwise(F.concat("source", F.lit("-"), (i % 5).cast("string"))).alias("user_id"),
        F.get(kind, (F.floor(i / 3) % 4).cast("int")).alias("intervention_type"), F.timestamp_seconds(i * 90000).alias("timestamp"), ((i * 37) % 3000 - 20).cast("double").alias("response_time_minutes"),
        F.substring("text", F.lit(1), third).alias("pre_intervention_text"), F.substring("text", third + 1, third).alias("intervention_text"), F.when(i % 11 == 0, " [Deleted] ").otherwise(F.substring("text", 2 * third + 1, F.length("text"))).alias("post_intervention_text"),
        F.concat(F.lit('{"post_score": "'), (i % 50).cast("string"), F.lit('", "accepted_answer_id": null}')).alias("platform_metadata"), score(n % 9).alias("empathy"), score(F.floor(n / 9) % 9).alias("constructiveness"), score(i * 5 % 9).alias("respect"), score((n + i) % 9).alias("social_cohesion"),
        (i % 40 == 3).alias("invalid_triple"), ((i % 101) / 100.0).cast("double").alias("confidence"), F.lit(None).cast("string").alias("label_error"), "doc_id",
    )


SCORED = ["record_id", *DIMS, "invalid_triple", "confidence"]


def analysis(tab) -> DataFrame:
    r = records(tab)
    sample = r.drop(*SCORED[1:], "label_error").withColumn("intervener_role", t.role("platform", "intervention_type"))
    return reports.features(sample, r.select(*SCORED, F.lit("").alias("rationale"), F.lit("").alias("raw_response")))


WORDS = "list_filter(string_split(" + CLEAN + ", ' '), lambda x: x <> '')"
CAPS = "coalesce(len(list_filter({0}, lambda x: x = upper(x) AND x <> lower(x) AND length(x) >= 2)) / nullif(len(list_filter({0}, lambda x: length(x) >= 2)), 0) > 0.30, false)"
TIMING = "CASE WHEN response_time_minutes <= 60 THEN 'immediate' WHEN response_time_minutes <= 1440 THEN 'same_day' ELSE 'delayed' END"
ANALYSIS = f"""(SELECT *, round_even((empathy + constructiveness + respect + social_cohesion) / 4, 4) AS composite, {TIMING} AS timing,
 CASE WHEN platform = 'reddit' THEN 'peer' WHEN platform = 'stackexchange' THEN 'domain_expert' WHEN intervention_type IN ('warning', 'restriction') THEN 'formal_authority' ELSE 'peer_editor' END AS role,
 count(*) OVER (PARTITION BY user_id) AS of_user, row_number() OVER (PARTITION BY user_id ORDER BY seconds, record_id) - 1 AS prior,
 CASE WHEN (max(seconds) OVER (PARTITION BY user_id) - min(seconds) OVER (PARTITION BY user_id)) // 86400 <= 30 THEN 'newcomer' WHEN (max(seconds) OVER (PARTITION BY user_id) - min(seconds) OVER (PARTITION BY user_id)) // 86400 <= 365 THEN 'regular' ELSE 'veteran' END AS tenure
 FROM {RECORDS} WHERE NOT invalid_triple AND empathy <> -1)"""
TIMED = f"(SELECT * FROM {ANALYSIS} WHERE response_time_minutes > 0)"


@query(rf"""
SELECT record_id, platform, user_id, intervention_type, composite AS prosociality_composite, CASE WHEN length(trim(pre)) > 0 THEN length(pre) END AS pre_text_length, nullif(len({WORDS.format("pre")}), 0) AS pre_word_count,
 {CAPS.format(WORDS.format("pre"))} AS pre_has_caps_abuse, nullif(len({WORDS.format("mid")}), 0) AS intervention_length, coalesce(contains(mid, '?'), false) AS intervention_has_question, CASE WHEN length(trim(regexp_replace(post, '^\s+|\s+$', '', 'g'))) > 0 THEN length(post) END AS post_text_length, nullif(len({WORDS.format("post")}), 0) AS post_word_count,
 CASE WHEN length(trim(regexp_replace(coalesce(post, ''), '^\s+|\s+$', '', 'g'))) > 0 THEN 'text_scored' ELSE 'outcome_only' END AS scoring_mode, CASE WHEN intervention_type IN ('warning', 'restriction') THEN 3 WHEN intervention_type = 'positive_reinforcement' THEN 1 ELSE 2 END AS intervention_severity,
 CASE WHEN platform = 'wikipedia' THEN 'semi_public' ELSE 'public' END AS intervention_visibility, timing AS response_time_category, CASE WHEN platform = 'reddit' THEN intervention_type = 'positive_reinforcement' END AS reddit_delta_awarded, post_score::DOUBLE AS se_post_score, false AS se_accepted_answer,
 of_user AS user_n_interventions_in_sample, prior AS user_prior_interventions_in_sample, tenure AS user_tenure_estimate_category, role AS intervener_role FROM {ANALYSIS}""")
def features_set(tab):
    a = analysis(tab).withColumn("user_prior_interventions_in_sample", F.col("user_prior_interventions_in_sample").cast("long"))
    return a.select("record_id", "platform", "user_id", "intervention_type", "prosociality_composite", "pre_text_length", "pre_word_count", "pre_has_caps_abuse", "intervention_length", "intervention_has_question", "post_text_length", "post_word_count", "scoring_mode", "intervention_severity", "intervention_visibility", "response_time_category", "reddit_delta_awarded", "se_post_score", "se_accepted_answer", "user_n_interventions_in_sample", "user_prior_interventions_in_sample", "user_tenure_estimate_category", "intervener_role")


# The research questions -------------------------------------------------------------------------------------------

QUESTIONS = {"rq1_type": ("intervention_type", "intervention_type", ANALYSIS), "rq2_tenure": ("user_tenure_estimate_category", "tenure", ANALYSIS), "rq2b_role": ("intervener_role", "role", ANALYSIS), "rq3_timing": ("response_time_category", "timing", TIMED), "rq4_platform": ("platform", "platform", ANALYSIS)}


def _question(name: str):
    sql = kruskal_row(QUESTIONS[name][2], QUESTIONS[name][1], "composite", "'composite' AS value") + "".join(" UNION ALL " + kruskal_row(QUESTIONS[name][2], QUESTIONS[name][1], d, f"'{d}' AS value") for d in DIMS)

    def run(tab):
        df = analysis(tab)
        found = reports.question(df.filter(F.col("response_time_minutes") > 0) if name == "rq3_timing" else df, QUESTIONS[name][0])
        per_dim = found["kruskal_by_dim"]
        return kruskal_columns(found["kruskal"], value="composite").unionByName(per_dim.select(F.col("dim").alias("value"), F.round("h", 4).alias("h"), "k", "n", F.round("p", 6).alias("p"), F.round("eta2", 6).alias("eta2"), "effect", "stars"))

    run.__name__ = f"{name}_tests"
    query(sql)(run)


def _pairs(name: str):
    group, own, table = QUESTIONS[name]
    sql = f"""
WITH e AS MATERIALIZED (SELECT {own} AS g, composite AS v FROM {table}), p AS (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT g FROM e) a, (SELECT DISTINCT g FROM e) b WHERE a.g < b.g),
x AS (SELECT a, b, g = a AS is_a, v FROM p JOIN e ON g = a OR g = b), r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0 AS r FROM x),
s AS (SELECT a, b, sum(CASE WHEN is_a THEN r END) AS ra, count(*) FILTER (is_a)::DOUBLE AS na, count(*)::DOUBLE AS n FROM r GROUP BY a, b),
t AS (SELECT a, b, sum(c * c * c - c) AS t FROM (SELECT a, b, v, count(*)::DOUBLE AS c FROM x GROUP BY a, b, v) GROUP BY a, b),
z AS (SELECT a, b, na::BIGINT AS n_a, (n - na)::BIGINT AS n_b, ra - na * (na + 1) / 2 AS u, (greatest(ra - na * (na + 1) / 2, na * (n - na) - (ra - na * (na + 1) / 2)) - na * (n - na) / 2 - 0.5) / sqrt(na * (n - na) / 12 * ((n + 1) - t / (n * (n - 1)))) AS z FROM s JOIN t USING (a, b)),
q AS (SELECT *, {normal_p('z')} AS p, count(*) OVER () AS m FROM z)
SELECT a, b, n_a, n_b, round(u, 1) AS u, round(p, 6) AS p, round(least(p * m, 1.0), 6) AS p_bonferroni, least(p * m, 1.0) < 0.05 AS significant FROM q"""

    def run(tab):
        df = analysis(tab)
        df = df.filter(F.col("response_time_minutes") > 0) if name == "rq3_timing" else df
        m = stats.pairwise_mann_whitney(df, group, "prosociality_composite")
        return m.select("a", "b", "n_a", "n_b", F.round("u", 1).alias("u"), F.round("p", 6).alias("p"), F.round("p_bonferroni", 6).alias("p_bonferroni"), "significant")

    run.__name__ = f"{name}_pairs"
    query(sql)(run)


def _tables(name: str):
    group, own, table = QUESTIONS[name]
    shown = [f"round({f}({v}), 6) AS {c}_{k}" for v, c in (("composite", "prosociality_composite"), *((d, d) for d in DIMS)) for f, k in (("avg", "mean"), ("stddev_samp", "sd"))]

    def run(tab):
        df = analysis(tab)
        found = reports.question(df.filter(F.col("response_time_minutes") > 0) if name == "rq3_timing" else df, group)
        d = found["descriptive"].join(found["medians"], group)
        return d.select(F.col(group).alias("g"), "n", *[F.round(c, 6).alias(c) for c in d.columns if c.endswith(("_mean", "_sd"))], "median")

    run.__name__ = f"{name}_descriptives"
    query(f"SELECT {own} AS g, count(*) AS n, {', '.join(shown)}, median(composite) AS median FROM {table} GROUP BY 1")(run)


for _name in QUESTIONS:
    _question(_name)
    _pairs(_name)
    _tables(_name)


def _spearman_sql(table: str, x: str, y: str, lead: str) -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {k}" for c, k in ((x, "x"), (y, "y")))
    return f"SELECT {lead}, round(rho, 6) AS rho, n, round({student_p('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)')}, 6) AS p FROM (SELECT corr(x, y) AS rho, count(*) AS n FROM (SELECT {ranks} FROM {table}))"


@query(" UNION ALL ".join(_spearman_sql(ANALYSIS, "prior", v, f"'{c}' AS value") for v, c in (("composite", "prosociality_composite"), *((d, d) for d in DIMS))))
def rq2_prior_spearman(tab):
    df = analysis(tab)
    return together([stats.spearman(df, "user_prior_interventions_in_sample", c).select(F.lit(c).alias("value"), F.round("rho", 6).alias("rho"), "n", F.round("p", 6).alias("p")) for c in ("prosociality_composite", *DIMS)])


@query(_spearman_sql(TIMED, "response_time_minutes", "composite", "'minutes' AS value"))
def rq3_response_spearman(tab):
    found = stats.spearman(analysis(tab).filter(F.col("response_time_minutes") > 0), "response_time_minutes", "prosociality_composite")
    return found.select(F.lit("minutes").alias("value"), F.round("rho", 6).alias("rho"), "n", F.round("p", 6).alias("p"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS rows, {k} AS a, intervention_type AS b, round(avg(composite), 6) AS mean, round(stddev_samp(composite), 6) AS std, count(composite) AS count FROM {ANALYSIS} GROUP BY 2, 3" for k in ("role", "platform")))
def rq_crosstabs(tab):
    df = analysis(tab)
    parts = [stats.crosstab(df, c, "intervention_type", "prosociality_composite").select(F.lit(k).alias("rows"), F.col(c).alias("a"), F.col("intervention_type").alias("b"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "count") for k, c in (("role", "intervener_role"), ("platform", "platform"))]
    return together(parts)


CORRELATIONS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {ANALYSIS}" if a != b else f"SELECT '{a}' AS a, '{a}' AS b, 1.0::DOUBLE AS r" for a in DIMS for b in DIMS)


@query(f"SELECT a, b, round(r, 6) AS r FROM ({CORRELATIONS})")
def rq5_correlations(tab):
    return stats.pearson_matrix(analysis(tab), DIMS).withColumn("r", F.round("r", 6))


@query(f"SELECT 4::BIGINT AS components, 1.0::DOUBLE AS whole, round(sum(r * r), 5) AS squares FROM ({CORRELATIONS})")
def rq5_pca_moments(tab):
    """What the components must have in common with the correlations whatever their signs: trace and sum of squares."""
    p = stats.pca(analysis(tab), DIMS)
    return p.agg(F.count("*").alias("components"), F.round(F.sum("explained"), 6).alias("whole"), F.round(F.sum(F.col("explained") * F.col("explained")) * 16, 5).alias("squares"))


@query("SELECT component, round(explained, 6) AS explained, explained > 0.70 AND component = 'PC1' AS single_factor, round(sqrt(0.5), 6) AS loading FROM (SELECT unnest(['PC1', 'PC2']) AS component, unnest([(1 + abs(r)) / 2, (1 - abs(r)) / 2]) AS explained FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem))")
def pca_of_two(tab):
    """Two columns have components in closed form."""
    return stats.pca(tab("lineitem"), ["l_quantity", "l_extendedprice"]).select("component", F.round("explained", 6).alias("explained"), "single_factor", F.round(F.abs("l_quantity"), 6).alias("loading"))


CHANGE = "CASE WHEN (p4 < 0.05) <> (p3 < 0.05) THEN 'significance changes' WHEN f4 <> f3 THEN 'effect label changes' ELSE 'unchanged' END"


def _sensitivity_sql(own: str, shown: str) -> str:
    four, three = "(empathy + constructiveness + respect + social_cohesion) / 4", "(empathy + constructiveness + social_cohesion) / 3"
    return f"""SELECT "group", round(h4, 4) AS h4, round(h3, 4) AS h3, round(p4, 6) AS p4, round(p3, 6) AS p3, f4 AS effect4, f3 AS effect3, {CHANGE} AS change FROM (
 SELECT '{shown}' AS "group", a.h AS h4, b.h AS h3, {chi2_p('a.h', '(a.k - 1)')} AS p4, {chi2_p('b.h', '(b.k - 1)')} AS p3, {EFFECT.format('((a.h - a.k + 1) / (a.n - a.k))')} AS f4, {EFFECT.format('((b.h - b.k + 1) / (b.n - b.k))')} AS f3
 FROM {_kruskal_sql(ANALYSIS, own, f'round({four}, 9)')} a, {_kruskal_sql(ANALYSIS, own, f'round({three}, 9)')} b)"""


@query(_sensitivity_sql("intervention_type", "intervention_type") + " UNION ALL " + _sensitivity_sql("platform", "platform"))
def sensitivity_changes(tab):
    s = reports.sensitivity(analysis(tab), ["intervention_type", "platform"])
    return s.select("group", *[F.round(c, k).alias(c) for c, k in (("h4", 4), ("h3", 4), ("p4", 6), ("p3", 6))], "effect4", "effect3", "change")


_T = "(1.959963984540054 + (1.959963984540054 ** 3 + 1.959963984540054) / (4 * v) + (5 * 1.959963984540054 ** 5 + 16 * 1.959963984540054 ** 3 + 3 * 1.959963984540054) / (96 * v ** 2) + (3 * 1.959963984540054 ** 7 + 19 * 1.959963984540054 ** 5 + 17 * 1.959963984540054 ** 3 - 15 * 1.959963984540054) / (384 * v ** 3))"


def _interval_sql(table: str, group: str, value: str) -> str:
    return f"SELECT g, n, round(mean, 4) AS mean, round(mean - {_T} * sd / sqrt(n), 4) AS low, round(mean + {_T} * sd / sqrt(n), 4) AS high FROM (SELECT *, (n - 1)::DOUBLE AS v FROM (SELECT {group} AS g, count(*) AS n, avg({value}) AS mean, stddev_samp({value}) AS sd FROM {table} GROUP BY 1))"


@query(_interval_sql("events", "event_type", "value"))
def t_intervals(tab):
    """The quantile's expansion in SQL is exact to 1e-6 from some tens of rows a group on."""
    return stats.interval_95(tab("events"), "event_type", "value").select(F.col("event_type").alias("g"), "n", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


@query(f"SELECT 'violin' AS what, platform AS g, count(composite) AS n, round(quantile_cont(composite, 0.05), 4) AS a, round(quantile_cont(composite, 0.5), 4) AS b, round(quantile_cont(composite, 0.95), 4) AS c FROM {ANALYSIS} GROUP BY 2 UNION ALL SELECT 'type' AS what, g, n, low AS a, mean AS b, high AS c FROM ({_interval_sql(ANALYSIS, 'intervention_type', 'composite')}) UNION ALL SELECT 'role' AS what, g, n, low AS a, mean AS b, high AS c FROM ({_interval_sql(ANALYSIS, 'role', 'composite')})")
def figure_data(tab):
    df = analysis(tab)
    empty = df.select("record_id", F.lit("x").alias("dim"), F.lit(1.0).alias("model"), F.lit(1.0).alias("human"))
    f = reports.figure_tables(df, empty)
    parts = [f["violins"].select(F.lit("violin").alias("what"), F.col("platform").alias("g"), "n", *[F.round(c, 4).alias(k) for k, c in zip("abc", ("p5", "p50", "p95"), strict=True)])]
    parts += [f[table].select(F.lit(what).alias("what"), F.col(c).alias("g"), "n", *[F.round(x, 4).alias(k) for k, x in zip("abc", ("low", "mean", "high"), strict=True)]) for what, table, c in (("type", "type_intervals", "intervention_type"), ("role", "role_intervals", "intervener_role"))]
    return together(parts)


# Departures, audit, label checks ----------------------------------------------------------------------------------

_PLACE = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g')) IN ('[deleted]', '[removed]', '')"
DEPARTED = rf"""(SELECT *, not_bot AND texts_ok AND no_answer AS is_tier_d FROM (SELECT *, NOT regexp_matches(lower(user_id), 'bot|automoderator|spam|moderationbot') AS not_bot,
 NOT {_PLACE.format('pre')} AND length(pre) BETWEEN 50 AND 5000 AND NOT {_PLACE.format('mid')} AND length(mid) BETWEEN 30 AND 5000 AS texts_ok, {_PLACE.format('post')} OR length(post) < 30 AS no_answer FROM {RECORDS}))"""
FIT = f"(SELECT * FROM {DEPARTED} WHERE not_bot AND texts_ok)"


def _departures(tab) -> dict[str, DataFrame]:
    r = records(tab)
    return reports.tier_d_report(r, r.filter(F.col("doc_id") % 2 == 0))


@query(f"SELECT unnest([0, 1, 2, 3]) AS stage_no, unnest(['all', 'not_bot', 'texts_ok', 'no_answer']) AS stage, unnest([count(*), count(*) FILTER (not_bot), count(*) FILTER (not_bot AND texts_ok), count(*) FILTER (not_bot AND texts_ok AND no_answer)]) AS n FROM {DEPARTED}")
def departures_funnel(tab):
    return _departures(tab)["funnel"]


@query(f"SELECT platform, intervention_type, GROUPING(platform, intervention_type) AS level, count(*) AS n, count(*) FILTER (is_tier_d) AS n_tier_d, round(100.0 * count(*) FILTER (is_tier_d) / count(*), 6) AS pct_tier_d FROM {FIT} GROUP BY GROUPING SETS ((), (platform), (intervention_type), (platform, intervention_type))")
def departures_rates(tab):
    return _departures(tab)["rates"].withColumn("pct_tier_d", F.round("pct_tier_d", 6))


@query(f"SELECT is_tier_d, count(*) AS n, {', '.join(f'round(quantile_cont(length(pre), {q / 100}), 6) AS p{q}' for q in (10, 25, 50, 75, 90))} FROM {FIT} GROUP BY 1")
def departures_lengths(tab):
    p = _departures(tab)["pre_lengths"]
    return p.select("is_tier_d", "n", *[F.round(f"p{q}", 6).alias(f"p{q}") for q in (10, 25, 50, 75, 90)])


@query(f"SELECT is_tier_d, round(avg(coalesce(len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x) AND length(x) >= 2)) / nullif(len(w), 0), 0)), 6) AS mean_caps, round(avg(len(w)), 6) AS mean_words FROM (SELECT is_tier_d, {WORDS.format('pre')} AS w FROM {FIT}) GROUP BY 1")
def departures_caps(tab):
    return _departures(tab)["caps"].select("is_tier_d", F.round("mean_caps", 6).alias("mean_caps"), F.round("mean_words", 6).alias("mean_words"))


@query(f"SELECT platform, count(*) AS n, {', '.join(f'round(quantile_cont(response_time_minutes, {q / 100}), 6) AS p{q}' for q in (10, 25, 50, 75, 90))} FROM {FIT} WHERE response_time_minutes > 0 AND response_time_minutes <= 525600 GROUP BY 1")
def departures_response(tab):
    p = _departures(tab)["response_minutes"]
    return p.select("platform", "n", *[F.round(f"p{q}", 6).alias(f"p{q}") for q in (10, 25, 50, 75, 90)])


@query(f"SELECT count(*) FILTER (doc_id % 2 = 0) AS n_known, count(*) AS n FROM {FIT} WHERE is_tier_d")
def departures_known(tab):
    return _departures(tab)["known"]


@query(rf"""SELECT record_id FROM {RECORDS} WHERE response_time_minutes > 0 AND response_time_minutes <= 525600 AND NOT {_PLACE.format('pre')} AND NOT {_PLACE.format('mid')} AND NOT {_PLACE.format('post')}
 AND NOT regexp_matches(lower(user_id), 'bot|automoderator|spam|moderationbot') AND length(pre) BETWEEN 50 AND 5000 AND length(mid) BETWEEN 30 AND 5000 AND length(post) BETWEEN 30 AND 5000""")
def quality_filtered(tab):
    return sampling.quality_filter(records(tab)).select("record_id")


AUDITED = f"(SELECT *, empathy = -1 AS malformed, empathy <> -1 AND invalid_triple AS invalid FROM {RECORDS})"


def _audit(tab) -> dict[str, DataFrame]:
    r = records(tab)
    return reports.audit(r.select(*SCORED), r.select("record_id", "platform", "intervention_type"), DIMS)


@query(f"SELECT platform, intervention_type, GROUPING(platform, intervention_type) AS level, count(*) AS n, count(*) FILTER (malformed) AS n_malformed, count(*) FILTER (invalid) AS n_invalid, count(*) FILTER (NOT malformed AND NOT invalid) AS n_valid FROM {AUDITED} GROUP BY GROUPING SETS ((), (platform), (intervention_type), (platform, intervention_type))")
def audit_rates(tab):
    return _audit(tab)["rates"].select("platform", "intervention_type", "level", "n", "n_malformed", "n_invalid", "n_valid")


@query(" UNION ALL ".join(f"SELECT '{d}' AS column, count(*) AS n, round(avg({d}), 6) AS mean, round(stddev_samp({d}), 6) AS sd, {', '.join(f'quantile_cont({d}, {q / 100}) AS p{q}' for q in (5, 10, 25, 50, 75, 90, 95))}, round(100.0 * count(*) FILTER ({d} = 1) / count(*), 6) AS pct_floor, round(100.0 * count(*) FILTER ({d} = 5) / count(*), 6) AS pct_ceiling FROM {RECORDS} WHERE {d} >= 1" for d in DIMS))
def audit_distribution(tab):
    d = _audit(tab)["distribution"]
    return d.select("column", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), *[f"p{q}" for q in (5, 10, 25, 50, 75, 90, 95)], F.round("pct_floor", 6).alias("pct_floor"), F.round("pct_ceiling", 6).alias("pct_ceiling"))


def _buckets_sql(table: str, value: str, edges: list[float]) -> str:
    rows = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
    return f"WITH v AS MATERIALIZED (SELECT {value} AS v FROM {table}), b(bucket, low, high) AS (VALUES {rows}) SELECT bucket, low, high, count(v) AS n, (SELECT count(v) FROM v) AS total FROM b LEFT JOIN v ON v >= low AND v < high GROUP BY ALL"


@query(_buckets_sql(f"{AUDITED} WHERE NOT malformed AND NOT invalid", "confidence", [0, 0.5, 0.7, 0.9, 1.001]))
def audit_confidence(tab):
    return _audit(tab)["confidence"]


@query(f"""
WITH s AS (SELECT count(*) AS n, count(*) FILTER (malformed) AS n_malformed, count(*) FILTER (invalid) AS n_invalid, count(*) FILTER (NOT malformed AND NOT invalid) AS n_valid, count(*) FILTER (NOT malformed AND NOT invalid AND confidence < 0.5) AS n_low FROM {AUDITED}),
i AS (SELECT *, list_filter([CASE WHEN n_malformed > 0.02 * n THEN 'malformed over 2%' END, CASE WHEN n_invalid > 0.10 * n THEN 'invalid over 10%' END, CASE WHEN n_valid < 50000 THEN 'under 50000 valid' END, CASE WHEN n_low > 0.10 * n_valid THEN 'low confidence over 10%' END], lambda x: x IS NOT NULL) AS issues FROM s)
SELECT n, n_malformed, n_invalid, n_valid, n_low, array_to_string(issues, '; ') AS issues, len(issues) = 0 AS go FROM i""")
def audit_gate(tab):
    return _audit(tab)["gate"].withColumn("issues", F.array_join("issues", "; "))


VALID = f"(SELECT *, (empathy + constructiveness + respect + social_cohesion) / 4 AS mean_score FROM {RECORDS} WHERE NOT invalid_triple)"


@query(f"SELECT platform, intervention_type, count(*) AS total, (count(*) FILTER (invalid_triple))::BIGINT AS n_invalid, round(100.0 * count(*) FILTER (invalid_triple) / count(*), 6) AS pct FROM {RECORDS} GROUP BY 1, 2")
def label_invalid(tab):
    return reports.label_checks(records(tab))["invalid"].withColumn("pct", F.round("pct", 6))


@query(" UNION ALL ".join(f"SELECT '{d}' AS column, {d} AS value, count(*) AS count FROM {VALID} GROUP BY 2" for d in DIMS))
def label_values(tab):
    return reports.label_checks(records(tab))["values"]


@query(_buckets_sql(VALID, "confidence", [0, 0.6, 0.7, 0.8, 0.9, 1.01]))
def label_confidence(tab):
    return reports.label_checks(records(tab))["confidence"]


@query(f"""(SELECT 'low_confidence' AS what, record_id FROM {VALID} WHERE confidence < 0.65 ORDER BY confidence, record_id LIMIT 10) UNION ALL (SELECT 'respect_without_empathy' AS what, record_id FROM {VALID} WHERE respect >= 4 AND empathy <= 1.5 ORDER BY record_id LIMIT 10)
 UNION ALL (SELECT 'high' AS what, record_id FROM {VALID} WHERE mean_score >= 4.5 ORDER BY mean_score DESC, record_id LIMIT 10) UNION ALL SELECT 'all_ones' AS what, count(*) FILTER (empathy = 1 AND constructiveness = 1 AND respect = 1 AND social_cohesion = 1)::VARCHAR AS record_id FROM {VALID}""")
def label_reviews(tab):
    c = reports.label_checks(records(tab))
    parts = [c[k].select(F.lit(k).alias("what"), "record_id") for k in ("low_confidence", "respect_without_empathy", "high")]
    return together([*parts, c["all_ones"].select(F.lit("all_ones").alias("what"), F.col("n").cast("string").alias("record_id"))])


# Raters -----------------------------------------------------------------------------------------------------------

LEVELS = ["low", "medium", "high"]
RATED = f"""(SELECT *, (s + s2 + respect + social_cohesion) / 4 AS composite, CASE level WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS c1 FROM (SELECT record_id, 'r' || rater AS rater, ['reddit', 'stackexchange', 'wikipedia'][record_id % 3 + 1] AS platform, ['punitive', 'educative', 'positive'][record_id % 7 % 3 + 1] AS style, s, s2, 1.0 + rater AS respect, 1.0 + record_id % 5 AS social_cohesion,
 (record_id + rater) % 3 + 1 AS level, (record_id + 2 * rater) % 3 + 1 AS style_level FROM {RATINGS}))"""


def rated(tab) -> DataFrame:
    r, i = _ratings(tab), F.col("record_id")
    levels = F.array(*map(F.lit, LEVELS))
    return r.select(
        "record_id", F.concat(F.lit("r"), F.col("rater").cast("string")).alias("rater"), F.get(F.array(*map(F.lit, PLATFORMS)), (i % 3).cast("int")).alias("platform"), F.get(F.array(*map(F.lit, ["Punitive ", "educative", "positive"])), (i % 7 % 3).cast("int")).alias("intervention_style"),
        F.col("s").alias("empathy"), F.col("s2").alias("constructiveness"), (1.0 + F.col("rater")).alias("respect"), (1.0 + i % 5).alias("social_cohesion"), F.get(levels, ((i + F.col("rater")) % 3).cast("int")).alias("confidence_tier1"), F.get(levels, ((i + 2 * F.col("rater")) % 3).cast("int")).alias("confidence_style"),
    )


def _counted_sql(by: str, level: str, shown: str) -> str:
    return f"SELECT '{shown}' AS what, {by} AS g, count(*) AS n, count(*) FILTER ({level} = 1) AS low, count(*) FILTER ({level} = 2) AS medium, count(*) FILTER ({level} = 3) AS high, round(avg({level}), 6) AS mean_level FROM {RATED} GROUP BY 2"


@query(" UNION ALL ".join(_counted_sql(*x) for x in (("rater", "level", "by_rater"), ("rater", "style_level", "style_by_rater"), ("platform", "level", "by_platform"), ("style", "style_level", "by_style"))))
def confidence_counts(tab):
    c = reports.confidence_report(rated(tab))
    by = {"by_rater": "rater", "style_by_rater": "rater", "by_platform": "platform", "by_style": "style"}
    return together([c[k].select(F.lit(k).alias("what"), F.col(g).alias("g"), "n", "low", "medium", "high", F.round("mean_level", 6).alias("mean_level")) for k, g in by.items()])


@query(" UNION ALL ".join(kruskal_row(RATED, g, v, f"'{k}' AS what") for k, g, v in (("rater_test", "rater", "level"), ("platform_test", "platform", "level"), ("style_test", "style", "style_level"))))
def confidence_tests(tab):
    c = reports.confidence_report(rated(tab))
    return together([kruskal_columns(c[k], what=k) for k in ("rater_test", "platform_test", "style_test")])


DEVIATED = f"(SELECT *, abs(composite - (sum(composite) OVER w - composite) / (count(*) OVER w - 1)) AS deviation FROM (SELECT *, count(*) OVER (PARTITION BY record_id) AS m FROM {RATED}) WHERE m > 1 WINDOW w AS (PARTITION BY record_id))"


@query(f"SELECT c1 AS confidence_tier1, round(avg(deviation), 6) AS mean_deviation, count(deviation) AS n FROM {DEVIATED} GROUP BY 1")
def confidence_deviation(tab):
    return reports.confidence_report(rated(tab))["deviation"].withColumn("mean_deviation", F.round("mean_deviation", 6))


PER = f"(SELECT record_id, any_value(platform) AS platform, count(*) AS raters, avg(level) AS mean_conf_tier1_num, min(level) AS min_conf_tier1, max(level) AS max_conf, stddev_pop(composite) AS cross_rater_composite_sd, stddev_samp(s) AS a, stddev_samp(s2) AS b FROM {RATED} GROUP BY 1)"


@query(f"SELECT record_id, platform, round(mean_conf_tier1_num, 6) AS mean_conf_tier1_num, min_conf_tier1::INT AS min_conf_tier1, round(cross_rater_composite_sd, 6) AS cross_rater_composite_sd FROM {PER}")
def confidence_records(tab):
    r = reports.confidence_report(rated(tab))["records"]
    return r.select("record_id", "platform", F.round("mean_conf_tier1_num", 6).alias("mean_conf_tier1_num"), "min_conf_tier1", F.round("cross_rater_composite_sd", 6).alias("cross_rater_composite_sd"))


@query(f"""WITH g AS (SELECT *, CASE WHEN raters = 3 AND max_conf = 1 THEN 'all_low' WHEN raters = 3 AND max_conf < 3 THEN 'all_not_high' ELSE 'any_high' END AS k FROM {PER})
SELECT k AS "group", count(*) AS n, round(avg(a), 6) AS sd_empathy, round(avg(b), 6) AS sd_constructiveness FROM (SELECT k, a, b FROM g UNION ALL SELECT 'all_not_high', a, b FROM g WHERE k = 'all_low') GROUP BY 1""")
def confidence_consensus(tab):
    c = reports.confidence_report(rated(tab))["consensus"]
    return c.select("group", "n", F.round("sd_empathy", 6).alias("sd_empathy"), F.round("sd_constructiveness", 6).alias("sd_constructiveness"))


_D4 = {"empathy": "s", "constructiveness": "s2", "respect": "respect", "social_cohesion": "social_cohesion"}


@query(f"""
WITH r AS MATERIALIZED (SELECT * FROM {RATED}), m AS (SELECT record_id, {', '.join(f'max({c}) - min({c}) > 1.5 AS f_{d}, round_even(avg({c}) * 2, 0) / 2 AS {d}' for d, c in _D4.items())} FROM r GROUP BY 1),
v AS (SELECT record_id, style, count(*) AS n FROM r GROUP BY record_id, style QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY count(*) DESC, style) = 1),
f AS (SELECT m.*, {' OR '.join(f'f_{d}' for d in _D4)} AS flagged, style FROM m JOIN v USING (record_id))
SELECT record_id, flagged, CASE WHEN flagged AND record_id % 2 = 0 THEN 4.5 ELSE empathy END AS empathy, constructiveness, respect, social_cohesion, CASE WHEN flagged AND record_id % 2 = 0 THEN 'structural' ELSE style END AS intervention_style_consensus FROM f""")
def consensus_adjudicated(tab):
    r = rated(tab).withColumn("intervention_style", F.lower(F.trim("intervention_style")))
    long = agreement.long_form(r, "record_id", "rater", DIMS)
    given = r.filter(F.col("record_id") % 2 == 0).select("record_id").distinct().select("record_id", F.lit("4.5").alias("adj_empathy"), *[F.lit("?").alias(f"adj_{d}") for d in DIMS[1:]], F.lit(" Structural").alias("adj_intervention_style"))
    return agreement.consensus(long, r.select("record_id", "rater", F.col("intervention_style").alias("style")), given)


@query(f"SELECT record_id, round(stddev_samp(x), 6) AS sd, round(stddev_pop(x), 6) AS sd_pop, round(avg(x), 6) AS mean FROM (SELECT record_id, unnest([r1, r2, r3]) AS x FROM (SELECT record_id, max(s) FILTER (rater = 'r1') AS r1, max(s) FILTER (rater = 'r2') AS r2, max(s) FILTER (rater = 'r3') AS r3 FROM {RATED} GROUP BY 1)) GROUP BY 1")
def wide_row_spread(tab):
    w = reports.wide_ratings(rated(tab), ["empathy", "constructiveness"])
    own = [f"{r}_empathy" for r in reports.RATERS]
    return w.select("record_id", F.round(t.row_std(*own), 6).alias("sd"), F.round(t.row_std(*own, ddof=0), 6).alias("sd_pop"), F.round(t.row_mean(*own), 6).alias("mean"))


# Joins and flags --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def truthy_flags_dropped(tab):
    flags = F.when(F.col("toxic") == 1, F.get(F.array(*map(F.lit, ["True", " yes", "1"])), (F.col("doc_id") % 3).cast("int"))).otherwise(F.get(F.array(*map(F.lit, ["false", "no", "0"])), (F.col("doc_id") % 3).cast("int")))
    rows = tab("documents").select("doc_id", "lang").join(tab("labels").select("doc_id", flags.alias("invalid_triple")).dropDuplicates(["doc_id"]), "doc_id", "left")
    return agreement.without_flagged(rows, "invalid_triple").select("doc_id", "lang")


@query("SELECT (SELECT count(*) FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id) WHERE doc_id % 2 = 0) AS matched, (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)) AS unmatched_labels")
def labels_matched(tab):
    sample, labels = tab("documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("record_id")), tab("labels").select(F.col("doc_id").alias("record_id")).distinct()
    joined, unmatched = reports.matched(sample, labels)
    return joined.agg(F.count("*").alias("matched")).crossJoin(unmatched.agg(F.count("*").alias("unmatched_labels")))  # one row each


@query("""
WITH s AS (SELECT doc_id, ((n_chars % 19) + 100)::BIGINT AS i, (n_chars % 7)::BIGINT AS o FROM documents) SELECT sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round((sum(i) * 0.8 + sum(o) * 4.0) / 1e6, 9) AS cost FROM s""")
def scoring_cost(tab):
    s = tab("documents").select((F.col("n_chars") % 19 + 100).alias("input_tokens"), (F.col("n_chars") % 7).alias("output_tokens"))
    return scoring.cost(s, 0.8, 4.0).withColumn("cost", F.round("cost", 9))


# Scalars ----------------------------------------------------------------------------------------------------------


@query(rf"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS target, CASE doc_id % 6 WHEN 1 THEN 'Talk' WHEN 3 THEN 'User talk' WHEN 5 THEN 'Wikipedia talk' ELSE (doc_id % 6)::VARCHAR END AS namespace,
 regexp_matches(lower(text), 'warn|vandal|block|spam|uw-|revert| rv |undid|undo|welcome|thanks|civil') OR regexp_matches(lower(text), '\{{\{{uw-|\{{\{{welcome|\{{\{{warning|\{{\{{bansummary|\{{\{{indef-block|\{{\{{blocked|wp:civil') AS is_intervention,
 md5(CASE WHEN doc_id % 4 = 0 THEN substr({CLEAN.format('text')}, 1, 1500) WHEN {CLEAN.format('text')} = '' THEN 'Edit summary: ' || source ELSE 'Edit summary: ' || source || chr(10) || chr(10) || 'Article excerpt:' || chr(10) || substr({CLEAN.format('text')}, 1, 1500) END) AS edit FROM documents""")
def wiki_scalars(tab):
    d, i = tab("documents"), F.col("doc_id")
    title = F.when(i % 3 == 0, F.concat(F.lit("User talk:"), "source")).otherwise(F.concat(F.lit("Talk:"), "source"))
    comment = F.when(i % 4 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("  "), "source"))
    return d.select("doc_id", t.talk_target(title).alias("target"), t.namespace_name(i % 6).alias("namespace"), t.is_intervention("text", "text").alias("is_intervention"), F.md5(t.article_edit(comment, "text")).alias("edit"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'warning' WHEN doc_id % 5 = 0 THEN 'positive_reinforcement' ELSE 'reframe' END AS kind, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN lang WHEN 2 THEN source END AS first,
 ['reddit', 'stackexchange', 'wikipedia', 'other'][doc_id % 4 + 1] AS platform, ['reddit', 'stackexchange', 'wikipedia', 'zz'][doc_id % 4 + 1] || '_' || doc_id AS record_id,
 CASE WHEN doc_id % 4 = 0 AND doc_id % 3 <> 2 THEN 'peer' WHEN doc_id % 4 = 1 AND doc_id % 3 = 1 THEN 'domain_expert' WHEN doc_id % 4 = 2 AND doc_id % 3 IN (0, 2) THEN 'formal_authority' WHEN doc_id % 4 = 2 THEN 'peer_editor' ELSE 'unknown' END AS strict_role FROM documents""")
def id_scalars(tab):
    d, i = tab("documents"), F.col("doc_id")
    platform, short = (F.get(F.array(*map(F.lit, x)), (i % 4).cast("int")) for x in ([*PLATFORMS, "other"], ["bl", "mn", "di", "zz"]))
    kind = F.get(F.array(*map(F.lit, ["warning", "reframe", "restriction"])), (i % 3).cast("int"))
    first = t.first_truthy(F.when(i % 4 == 0, F.col("source")).otherwise(F.lit("")), F.when(i % 4 == 1, F.col("lang")), F.when(i % 4 == 2, F.col("source")))
    return d.select("doc_id", t.reddit_type(i % 7 == 0, F.when(i % 5 == 0, "1∆").otherwise("none")).alias("kind"), first.alias("first"), t.platform_of(F.concat(platform, F.lit("_x_y"))).alias("platform"), t.blinded_to_platform(F.concat(short, F.lit("_"), i.cast("string"))).alias("record_id"), t.strict_role(platform, kind).alias("strict_role"))


@query("""
SELECT vec_id, CASE WHEN x < 0.5 THEN 'poor' WHEN x < 0.75 THEN 'moderate' WHEN x < 0.9 THEN 'good' ELSE 'excellent' END AS icc, CASE WHEN x < 0.2 THEN 'slight' WHEN x < 0.4 THEN 'fair' WHEN x < 0.6 THEN 'moderate' WHEN x < 0.8 THEN 'substantial' ELSE 'near-perfect' END AS kappa,
 CASE WHEN vec_id % 40 > 0 THEN printf('%.1f%%', 100.0 * (vec_id % 9) / (vec_id % 40)) ELSE '—' END AS percent, repeat('█', round_even(x * 20, 0)::INT) || repeat('░', 20 - round_even(x * 20, 0)::INT) AS bar,
 ['low', 'medium', 'high', 'low'][vec_id % 4 + 1] AS level, [1, 2, 3, 1][vec_id % 4 + 1]::INT AS rank FROM (SELECT vec_id, (vec_id % 40) / 40.0::DOUBLE AS x FROM embeddings)""")
def label_scalars(tab):
    e = tab("embeddings").select("vec_id", ((F.col("vec_id") % 40) / 40.0).alias("x"))
    level = t.confidence_level(F.get(F.array(*map(F.lit, [" Low", "medium", "HIGH ", "?"])), (F.col("vec_id") % 4).cast("int")))
    return e.select("vec_id", t.icc_label("x").alias("icc"), t.kappa_label("x").alias("kappa"), t.percent(F.col("vec_id") % 9, F.col("vec_id") % 40).alias("percent"), t.bar("x").alias("bar"), level.alias("level"), t.confidence_rank(level).alias("rank"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) <= 25")
def sample_n_each(tab):
    return sampling.sample_n(tab("documents").select("doc_id", "lang"), ["lang"], 25, "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS place FROM documents")
def shuffled_places(tab):
    """Every row's place in the shuffled order."""
    from rejoinder.operators.ranges import running

    return running(tab("documents").select("doc_id", sampling.draw("doc_id").alias("d")), ["d", "doc_id"], name="place").select("doc_id", "place")


@query(f"SELECT record_id, flagged, '' AS adj_s, '' AS adj_s2, '' AS adj_intervention_style, '' AS adjudicator_notes FROM (SELECT record_id, max(s) - min(s) > 1.5 OR max(s2) - min(s2) > 1.5 AS flagged FROM {RATINGS} GROUP BY 1) WHERE flagged")
def adjudication_rows(tab):
    from rejoinder.sources.sinks import adjudication_sheet

    long = agreement.long_form(_ratings(tab), "record_id", "rater", ["s", "s2"])
    return adjudication_sheet(agreement.disagreements(long).filter("flagged"), ["s", "s2"])


@query(f"SELECT 'r' || rater AS rater, count(*) FILTER (s * 2 <> floor(s * 2)) AS off_grid_empathy, count(*) FILTER (s2 * 2 <> floor(s2 * 2)) AS off_grid_constructiveness, count(*) FILTER (record_id % 5 = 0) AS unlisted_styles FROM {RATINGS} GROUP BY 1")
def form_problem_counts(tab):
    from rejoinder.sources.readers import form_problems

    style = F.when(F.col("record_id") % 5 == 0, "punative").otherwise("punitive")
    form = rated(tab).withColumns({"intervention_style": style, "respect": F.lit(3.0), "social_cohesion": F.lit(None).cast("double")})
    return form_problems(form).select("rater", "off_grid_empathy", "off_grid_constructiveness", "unlisted_styles")


@query("""
SELECT doc_id, CASE WHEN l.toxic = 1 THEN -1.0 ELSE 3.0 END::DOUBLE AS empathy, CASE WHEN l.toxic = 1 THEN -1.0 ELSE 0.5 END::DOUBLE AS confidence FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)""")
def sentinel_scores(tab):
    bad = tab("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    value = F.when(F.coalesce(F.col("toxic") == 1, F.lit(False)), F.lit(None).cast("double"))
    scores = tab("documents").select("doc_id").join(bad, "doc_id", "left").select("doc_id", *[value.otherwise(3.0).alias(d) for d in scoring.DIMENSIONS], value.otherwise(0.5).alias("confidence"))
    return scoring.with_sentinels(scores).select("doc_id", "empathy", "confidence")


# Unified records --------------------------------------------------------------------------------------------------


@query(rf"""
WITH c AS (SELECT *, lag(turn) OVER w AS pt, lag(role) OVER w AS pr, lag(text) OVER w AS px FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT c.*, (SELECT min(x.turn) FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = c.pr AND x.turn > c.turn) AS nt FROM c WHERE pr <> role)
SELECT 'reddit' AS platform, pr AS user_id, md5({CLEAN.format("px")}) AS pre, md5({CLEAN.format("r.text")}) AS mid, md5({CLEAN.format("p.text")}) AS post, CASE WHEN r.turn % 3 = 0 THEN 'warning' ELSE 'reframe' END AS intervention_type, round((nt - r.turn) / 60.0, 6) AS minutes, 'peer' AS intervener_role, r.conv_id::VARCHAR AS conversation, false AS removed
FROM r JOIN conversations p ON p.conv_id = r.conv_id AND p.turn = nt WHERE length({CLEAN.format("px")}) >= 20 AND length({CLEAN.format("r.text")}) >= 20 AND length({CLEAN.format("p.text")}) >= 20""")
def unified_replies(tab):
    from rejoinder.operators import triples
    from rejoinder.plans.catalogue import _utterances

    u = _utterances(tab("conversations")).withColumns({"stickied": F.col("timestamp") % 3 == 0, "author_flair": F.lit(""), "conv_split": F.lit(None).cast("string"), "conv_has_removed_comment": F.lit(None).cast("boolean"), "score": F.lit(1)})
    r = triples.unified(triples.reddit_triples(u))
    meta = F.from_json("platform_metadata", "conversation_id string, conv_has_removed_comment boolean")
    return r.select("platform", "user_id", *[F.md5(c).alias(k) for k, c in (("pre", "pre_intervention_text"), ("mid", "intervention_text"), ("post", "post_intervention_text"))], "intervention_type", F.round("response_time_minutes", 6).alias("minutes"), "intervener_role", meta["conversation_id"].alias("conversation"), meta["conv_has_removed_comment"].alias("removed"))


@query(rf"""
WITH o AS (SELECT conv_id, arg_min(role, turn) AS owner, arg_min(text, turn) AS body FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, turn, role, text, owner, body FROM conversations JOIN o USING (conv_id) WHERE length(text) >= 20 AND length(trim(body)) >= 20 AND turn > 0),
r AS (SELECT *, (SELECT min(x.turn) FROM c x WHERE x.conv_id = c.conv_id AND x.turn > c.turn AND x.role = c.owner) AS nt FROM c WHERE role <> owner),
v AS (SELECT r.*, p.text AS answer, row_number() OVER (PARTITION BY r.conv_id ORDER BY r.turn) AS k FROM r JOIN conversations p ON p.conv_id = r.conv_id AND p.turn = r.nt WHERE length({CLEAN.format("r.text")}) >= 20 AND length({CLEAN.format("p.text")}) >= 20)
SELECT conv_id::VARCHAR AS post_id, owner AS user_id, md5({CLEAN.format("body")}) AS pre, md5({CLEAN.format("text")}) AS mid, md5({CLEAN.format("answer")}) AS post, round((nt - turn)::DOUBLE, 6) AS minutes FROM v WHERE k <= 3""")
def unified_comments(tab):
    from rejoinder.operators import triples

    c = tab("conversations")
    posts = c.groupBy("conv_id").agg(F.min_by("role", "turn").alias("owner_user_id"), F.min_by("text", "turn").alias("body_text")).select(F.col("conv_id").cast("string").alias("post_id"), "owner_user_id", "body_text", F.lit(1).alias("post_type_id"), F.lit("4").alias("score"), F.lit("t").alias("title"))
    at = F.date_format(F.timestamp_seconds(F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss")
    comments = c.filter("turn > 0").select(F.format_string("%06d", "turn").alias("comment_id"), F.col("conv_id").cast("string").alias("post_id"), F.col("role").alias("user_id"), "text", at.alias("creation_date"))
    r = triples.stackexchange_triples(posts, comments)
    return r.select(F.get_json_object("platform_metadata", "$.post_id").alias("post_id"), "user_id", *[F.md5(x).alias(k) for k, x in (("pre", "pre_intervention_text"), ("mid", "intervention_text"), ("post", "post_intervention_text"))], F.round("response_time_minutes", 6).alias("minutes"))


@query(f"""
WITH a AS (SELECT platform, composite AS v FROM {ANALYSIS}), o AS (SELECT platform, count(*) AS n, min(v) AS lo, max(v) AS hi, var_samp(v) * pow(count(*), -0.4) AS h2 FROM a GROUP BY 1),
p AS (SELECT *, lo + (hi - lo) * k / 99 AS x FROM o, range(100) AS r(k)), c AS (SELECT platform, v, count(*) AS m FROM a GROUP BY 1, 2)
SELECT p.platform, k::INT AS k, round(x, 9) AS x, round(sum(m * exp(-pow(x - v, 2) / (2 * h2)) / sqrt(2 * pi() * h2)) / any_value(n), 9) AS density FROM p JOIN c USING (platform) GROUP BY 1, 2, 3""")
def violin_densities(tab):
    got = reports.densities(analysis(tab), "platform", "prosociality_composite")
    return got.select("platform", "k", F.round("x", 9).alias("x"), F.round("density", 9).alias("density"))

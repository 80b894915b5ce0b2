import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rejoinder.llm import site_quality, toxicity

SCHEMA = "doc_id long, text string, score double, __note string, n long"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    y = np.asarray(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def sentences(rnd, n):
    plain, bad, texts, y = [f"w{chr(97 + i)}x" for i in range(26)], ["vile", "scumbag", "rotten"], [], []
    for _ in range(n):
        toxic = rnd.random() < 0.4
        own = rnd.choices(plain, k=6) + (rnd.choices(bad, k=1) if toxic and rnd.random() < 0.8 else [])
        if rnd.random() < (0.7 if toxic else 0.1):  # labels go with mentions of a group
            own.append("muslim")
        texts.append(" ".join(own))
        y.append(int(toxic))
    return texts, np.array(y)


def test_swaps_shrink_what_a_mention_says():
    texts, y = sentences(random.Random(1), 1500)
    plain, fair = toxicity.fit(texts, y, swap=0.0), toxicity.fit(texts, y, swap=5.0)
    assert max(plain.gap, fair.gap) <= toxicity.TOLERANCE  # what differs are the optima
    mention = [f"wa wb {g}" for g in ("muslim", "christian", "hindu")]

    def apart(m):
        return np.ptp(m.score(mention))

    assert apart(plain) > 0.1 and apart(fair) < 0.2 * apart(plain)
    held, yh = sentences(random.Random(2), 800)
    clean = [t for t, v in zip(held, yh, strict=True) if not v and "muslim" in t]
    assert (plain.score(clean) >= 0.5).mean() > 0.4 and (fair.score(clean) >= 0.5).mean() < 0.1
    assert auc(yh, fair.score(held)) > auc(yh, plain.score(held)) - 0.01


def test_false_positives_on_neutral_mentions_fall_in_the_query_s_own_fit(spark):
    """Mentions are planted in half of the toxic and a fifth of the clean documents; then clean ones outside the fit all get one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    named = F.when(F.col("toxic") == 1, draw < 5).otherwise(draw < 2)
    planted = docs.join(labels, "doc_id").withColumn("text", F.when(named, F.concat("text", F.lit(" Muslim and native."))).otherwise(F.col("text"))).select(docs.columns)
    plain, fair = (toxicity.learn(planted, labels, swap=s) for s in (0.0, 8.0))
    assert plain.swaps == 0 and fair.swaps > labels.filter("doc_id > 0").count() / 2  # texts without a term get one
    assert max(plain.gap, fair.gap) <= toxicity.TOLERANCE
    clean = [r.text + " Muslim and native." for r in docs.join(labels.filter("toxic = 0"), "doc_id").filter(toxicity.fold() == 0).collect()]
    before, after = (plain.score(clean) >= 0.5).mean(), (fair.score(clean) >= 0.5).mean()
    assert before > 0.1 and after < 0.5 * before
    mentions = ["", *(t for group in toxicity.IDENTITIES for t in group)]
    assert np.ptp(fair.score(mentions)) < 0.6 * np.ptp(plain.score(mentions))


def test_the_penalty_acts_in_the_query_on_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    own, plain = toxicity.learn(docs, labels), toxicity.learn(docs, labels, swap=0.0)
    terms = [t for group in toxicity.IDENTITIES for t in group]
    assert own.swaps > 0 and max(own.gap, plain.gap) <= toxicity.TOLERANCE
    assert any(own.weights.get(t) for t in terms)  # terms are weighed, since copies hold them
    squares = [sum(m.weights.get(t, 0.0) ** 2 for t in terms) for m in (own, plain)]
    assert squares[0] < squares[1] and np.ptp(own.score(["", *terms])) < 0.1
    assert toxicity.toxicity_scores(docs.limit(3), own).select("n_swaps").distinct().collect()[0][0] == own.swaps


def test_the_fit_meets_the_conditions_of_its_minimum():
    """The value by brute force, of copies as texts of their own; the fit as the query makes it."""
    texts, y = sentences(random.Random(3), 400)
    model = toxicity.fit(texts, y)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    terms = {t for group in toxicity.IDENTITIES for t in group}
    parts = []  # text's words, label, weight; then pairs of words with weights
    pairs = []
    for t, label, own in zip(texts, y.tolist(), weight.tolist(), strict=True):
        put, changes = toxicity.counterfactuals(t)
        base, anchor = toxicity.words(t), toxicity.words(t) | ({put} if put else set())
        copies = ([anchor] if put else []) + [(anchor - {a}) | ({b} if b else set()) for a, b in changes]
        assert copies  # each text names a group or gets a mention
        parts += [(base, label, own * (1 - toxicity.COPIES)), *((c, label, own * toxicity.COPIES / len(copies)) for c in copies)]
        pairs += [(base if put and c is copies[0] else anchor, c, own / len(copies)) for c in copies]

    def value(weights, bias):
        z = lambda s: bias + sum(weights.get(w, 0.0) for w in s)
        sig = lambda s: 1 / (1 + np.exp(-z(s)))
        loss = sum(m * (np.logaddexp(0, z(s)) - label * z(s)) for s, label, m in parts)
        moved = 2.0 * sum(m * (sig(a) - sig(b)) ** 2 for a, b, m in pairs)
        return loss + moved + sum(toxicity.RIDGE / 2 * v * v if k in terms else toxicity.L1 * abs(v) for k, v in weights.items())

    least = value(model.weights, model.bias)
    for word in ("muslim", "christian", "vile", "wax", "jewish"):
        for step in (-0.02, 0.02):
            assert value({**model.weights, word: model.weights.get(word, 0.0) + step}, model.bias) > least
    assert min(value(model.weights, model.bias + s) for s in (-0.02, 0.02)) > least
    assert model.gap <= toxicity.TOLERANCE


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("x"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.toxicity_scores(docs, toxicity.learn(docs, labels))
    held = got.filter("held_out").join(labels, "doc_id").toPandas()
    assert auc(held["toxic"], held["score"]) > 0.9 and got.count() == docs.count()
    odd = spark.createDataFrame([(1, None, 0.1, "a", 1), (1, "", 0.1, "a", 1), (None, "x" * 300_000, 0.1, "a", 1)], SCHEMA)
    model = toxicity.learn(odd, labels.limit(0))
    assert [r.predicted for r in toxicity.toxicity_scores(odd, model).collect()] == [0, 0, 0]
    assert toxicity.toxicity_scores(odd.limit(0), model).count() == 0


def test_quality_is_shrunk_by_site(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    evidence = site_quality.learn(docs, labels.filter("doc_id % 3 <> 0"))
    got = site_quality.judged(docs, evidence, F.col("source"), F.col("lang")).join(labels.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    assert auc(got["quality"], got["__posterior"]) > 0.95
    rows = [(i, "", 0.0, h, 1) for i, h in enumerate(["big"] * 400 + ["bad"] * 100 + ["one"])]
    flat = spark.createDataFrame(rows, SCHEMA).select("doc_id", F.col("__note").alias("__host"), F.lit("p").alias("__path"), F.when(F.col("__note") == "big", 3.0).otherwise(-3.0).alias("__logit"))
    sites, mean = site_quality.site_posteriors(flat)
    rate = {r["__host"]: r["path_rate"] for r in sites.collect()}
    assert rate["bad"] < rate["one"] < mean < rate["big"]  # one document says less than a hundred


def test_bad_and_good_sites_turn_decisions(spark):
    """Against brute force: documents with the same evidence go where their site is bad and stay where it is good."""
    rnd = np.random.default_rng(7)
    rows = [(h, q, float(rnd.normal(m, 1.0))) for h, m in (("good", 4.0), ("bad", -3.5), ("mid", 1.5)) for q in ("a", "b") for _ in range(150)] + [("new", "a", 0.3)]
    rows += [("good", "a", -0.2), ("bad", "a", 0.2), ("bad", "b", 0.2), ("good", "b", -0.2)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, __host string, __path string, __logit double")
    sums = site_quality.site_sums(frame)
    found = site_quality.spread(sums)
    p = np.array([1 / (1 + np.exp(-r[2])) for r in rows])
    host, path = np.array([r[0] for r in rows]), np.array([f"{r[0]}/{r[1]}" for r in rows])
    n, mean = len(p), p.mean()
    means = {g: p[path == g].mean() for g in set(path)}
    size = {g: int((path == g).sum()) for g in set(path)}
    hosts = {g: p[host == g].mean() for g in set(host)}
    within = sum(((p[path == g] - m) ** 2).sum() for g, m in means.items()) / (n - len(means))
    nested = sum(s * s / (host == g.split("/")[0]).sum() for g, s in size.items())
    paths = max(0, sum(size[g] * (m - hosts[g.split("/")[0]]) ** 2 for g, m in means.items()) - (len(means) - len(hosts)) * within) / (n - nested)
    sizes = {g: (host == g).sum() for g in hosts}
    between = sum(sizes[g] * (m - mean) ** 2 for g, m in hosts.items()) - (len(hosts) - 1) * within - paths * (nested - sum(s * s for s in size.values()) / n)
    between = max(0, between) / (n - sum(s * s for s in sizes.values()) / n)
    assert np.allclose([found.mean, found.paths, found.hosts], [mean, paths, between], rtol=1e-9, atol=1e-12) and between > 0.05
    label = sum(size[g] * m * (1 - m) for g, m in means.items()) / n
    docs = frame.select("doc_id", F.col("__host").alias("source"), F.col("__path").alias("lang"), F.col("__logit").alias("z"), F.lit("x").alias("__posterior"))
    evidence = site_quality.Evidence(0.0, np.zeros(site_quality.FEATURES))
    got = judged_by(docs, evidence)
    for i, r in enumerate(rows):
        k, o = size[path[i]] - 1, sizes[host[i]] - 1
        h_mean = (hosts[host[i]] * (o + 1) - p[i]) / o if o else mean
        squares = sum((s - (g == path[i])) ** 2 for g, s in size.items() if g.split("/")[0] == host[i])
        trust = between / (between + paths * squares / o**2 + label / o) if o else 0
        want = mean + trust * (h_mean - mean)
        if k:
            want += paths / (paths + label / k) * ((means[path[i]] * (k + 1) - p[i]) / k - want)
        assert abs(got[i]["path_rate"] - want) < 1e-9
    last = [got[len(rows) - j]["posterior"] >= 0.5 for j in (4, 3, 2, 1)]
    assert last == [True, False, False, True] and got[600 + 300]["posterior"] >= 0.5


def judged_by(docs, evidence):
    """judged with the given logits in place of evidence from texts."""
    real = site_quality.with_evidence
    try:
        site_quality.with_evidence = lambda d, e, h, q: d.withColumns({"__logit": F.col("z"), "__host": h, "__path": q})
        to = site_quality.added(docs)
        assert to["posterior"] == "__posterior_"  # the input has a column of the first name
        got = site_quality.judged(docs, evidence, F.col("source"), F.col("lang"))
        return {r["doc_id"]: {"path_rate": r["__path_rate"], "posterior": r["__posterior_"], "own": r["__posterior"]} for r in got.collect()}
    finally:
        site_quality.with_evidence = real


def test_quality_of_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, 0.1, "a", 1), (1, "", 0.1, None, 1), (None, "x" * 3_000_000, 0.1, "a", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    evidence = site_quality.learn(odd, none)
    got = site_quality.judged(odd, evidence, F.col("__note"), F.lit(None))
    assert got.filter("__posterior >= 0.5").count() == 3 and {"score", "__note"} <= set(got.columns)
    assert site_quality.judged(odd.limit(0), evidence, F.col("__note"), F.col("n")).count() == 0


def test_features_do_not_depend_on_the_batch():
    texts = ["abc DEF!! | 12", "", None, "é" * 10, "#$%&*" * 9]
    assert np.allclose(site_quality.features(texts), np.vstack([site_quality.features([t]) for t in texts]))


def kind_of_junk(text):
    words = text.split()
    if any(f"{c}{c}{c}" in text for c in "#$%&*"):
        return "symbols"
    if " | " in text:
        return "tables"
    if "!!" in text:
        return "shouting"
    return "repetition" if len(words) >= 8 and len(set(words)) < 0.6 * len(words) else "other"


def test_every_kind_of_junk_is_rejected():
    docs, labels = (pq.read_table(f"/root/testdata/sf0.1/{n}.parquet").to_pandas() for n in ("documents", "labels"))
    known = docs.merge(labels, on="doc_id")
    held = known["doc_id"] % 3 == 0
    x, y = site_quality.features(known["text"].tolist()), known["quality"].to_numpy(dtype=float)
    known["kept"] = site_quality.fit(x[~held], y[~held]).logit(known["text"].tolist()) >= 0
    junk, clean = known[held & (y == 0)], known[held & (y == 1)]
    kept = junk["kept"].groupby(junk["text"].map(kind_of_junk)).agg(["mean", "size"])
    for kind in ("symbols", "tables", "shouting", "repetition"):
        assert kept.loc[kind, "size"] >= 20 and kept.loc[kind, "mean"] <= 0.05, kept
    assert clean["kept"].mean() > 0.99


def test_repetition_is_seen_over_the_whole_text():
    plain = " ".join(f"w{i}" for i in range(400))
    at = site_quality.KINDS + 2
    got = site_quality.features([plain, plain + " De" * 4000, "Rech.\nLes Rech.\n" * 50, "a a b b c c", None, "alone", "", " \n "])[:, at:]
    assert (got[0, [0, 2, 6]] == 0).all() and (got[[4, 5, 6, 7]] == 0).all()
    assert got[1, 0] > 0.2 and got[1, 1] > 0.9 and got[1, 6] > 0.9  # behind 400 words of their own
    assert got[2, 4] > 0.8 and np.isclose(got[3, 6] ** 2, 3 / 5)

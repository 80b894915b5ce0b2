import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from rejoinder.operators import agreement, reports, sampling, scoring, stats, triples
from rejoinder.plans import catalogue

HOUR = 3_600_000_000
LONG = "a text of more than twenty characters"


def test_as_of_is_strict_and_includes_48_hours(spark):
    t0 = 100 * HOUR
    rows = spark.createDataFrame([("u", t0 - 49 * HOUR, 1), ("u", t0 - 48 * HOUR, 2), ("u", t0, 3), ("u", t0 + 1, 4), ("v", t0 - 1, 5)], "who string, us long, id long")
    got = triples.as_of(spark.createDataFrame([("u", t0, "e"), ("w", t0, "f")], "who string, us long, name string"), rows, "who").select("name", "pre.id", "post.id").collect()
    assert sorted(map(tuple, got)) == [("e", 2, 4), ("f", None, None)]


def test_reply_chain_skips_the_parent_and_looks_across_conversations(spark):
    u = [("p", "c1", "A", None, 9, LONG), ("r", "c2", "B", "p", 5, LONG), ("x", "c2", "A", None, 5, LONG), ("y", "c2", "A", None, 6, LONG), ("z", "c2", "A", None, 7, LONG), ("s", "c2", "A", "p", 8, LONG), ("q", "c1", "B", "p", 3, LONG), ("k", "c1", "A", None, 11, LONG)]
    df = spark.createDataFrame(u, "utterance_id string, conversation_id string, speaker string, reply_to string, timestamp long, text string")
    assert sorted((r.utterance_id, r.pre_id, r.post_id) for r in triples.reply_chain(df).collect()) == [("q", "p", "k"), ("r", "p", "y")]
    full = df.withColumns({"stickied": F.lit(False), "author_flair": F.lit(""), "conv_split": F.lit(None).cast("string"), "conv_has_removed_comment": F.lit(None).cast("boolean"), "score": F.lit(1)})
    got = triples.unified(triples.reddit_triples(full)).orderBy("record_id").collect()
    assert [r.record_id for r in got] == ["reddit_000000", "reddit_000001"] and json.loads(got[0].platform_metadata)["conv_split"] is None and got[0].intervener_role == "peer"


def test_stackexchange_takes_three_answered_comments(spark):
    posts = spark.createDataFrame([("1", "o", LONG, 1, "5", "t")], "post_id string, owner_user_id string, body_text string, post_type_id int, score string, title string")
    rows = [(str(i), "1", u, LONG if u != "s" else "short", f"2020-01-01T00:0{i}:00") for i, u in enumerate(["a", "b", "s", "", "c", "d", "o"])] + [("9", "1", "e", LONG, "2020-01-01T00:09:00")]
    comments = spark.createDataFrame(rows, "comment_id string, post_id string, user_id string, text string, creation_date string")
    got = triples.stackexchange_triples(posts, comments).collect()
    assert sorted(json.loads(r.platform_metadata)["intervention_comment_id"] for r in got) == ["0", "1", "4"] and got[0].response_time_minutes in (6.0, 5.0, 2.0)


def test_wikipedia_joins_edits_as_of_and_legacy(spark):
    talk = [("p", "User talk:Ann", 3, f"r{i}", f"2020-01-0{i + 2}T00:00:00Z", who, None, None, c, x) for i, (who, c, x) in enumerate([("Ann", "hello", LONG), ("Bob", "warn you", LONG + " " + LONG), ("Ann", "ok", LONG)])]
    cols = "page_id string, page_title string, namespace int, revision_id string, timestamp string, contributor_username string, contributor_id string, contributor_ip string, edit_comment string, text_content string"
    talk = spark.createDataFrame(talk, cols)
    edits = talk.limit(0).drop("namespace").unionByName(spark.createDataFrame([("a", "Art", "e1", "2020-01-02T12:00:00Z", "Ann", None, None, "typo", LONG), ("a", "Art", "e2", "2020-01-03T06:00:00Z", "Ann", None, None, None, LONG)], cols.replace("namespace int, ", "")))
    got = triples.wikipedia_triples(talk, edits).collect()
    assert [(r.user_id, r.intervention_type, r.response_time_minutes) for r in got] == [("Ann", "warning", 360.0)]
    old = triples.wikipedia_triples_legacy(talk).collect()
    assert [(r.user_id, r.intervention_type, r.response_time_minutes) for r in old] == [("Ann", "warning", 1440.0)]


@pytest.mark.parametrize(("n", "sizes"), [(2, (2, 0, 0)), (3, (1, 1, 1)), (10, (8, 1, 1)), (25, (21, 2, 2))])
def test_split_sizes(spark, n, sizes):
    got = {r[0]: r[1] for r in sampling.split_801010(spark.range(n).withColumn("g", F.lit("x")), ["g"], "id").groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("train", "val", "test")) == sizes


def test_proportional_remainder_and_quota(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "g string, n long")
    assert [tuple(r) for r in sampling.proportional_targets(counts, ["g"], 10).orderBy("g").collect()] == [("a", 4), ("b", 3), ("c", 3)]
    rows = spark.range(20).select("id", F.lit("s").alias("g"), (F.col("id") < 3).alias("rich"))
    got = sampling.quota_sample(rows, spark.createDataFrame([("s", 5)], "g string, target int"), ["g"], "id", F.col("rich")).collect()
    assert len(got) == 5 and {0, 1, 2} <= {r.id for r in got}


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3)] + [("b", float(v)) for v in (4, 5, 6)] + [(None, 1.0), ("c", None)], "g string, v double")
    k = stats.kruskal(df, "g", "v").first()
    assert round(k.h, 6) == 3.857143 and round(k.p, 6) == 0.049535 and (k.k, k.n) == (2, 6)
    assert stats.pairwise_mann_whitney(df, "g", "v").first().u == 0
    xy = spark.createDataFrame([(float(i), float(6 - i)) for i in range(1, 6)], "x double, y double")
    assert stats.spearman(xy, "x", "y").first().rho == -1.0
    assert stats.kruskal(df.withColumn("v", F.lit(1.0)), "g", "v").first().h is None
    mono = stats.kruskal(df.withColumn("v", F.exp("v")), "g", "v").first()
    assert abs(mono.h - k.h) < 1e-12
    assert [r.n for r in stats.buckets(df, "v", [0, 2, 10, 20]).orderBy("bucket").collect()] == [2, 5, 0]


def test_agreement(spark):
    same = [(f"s{i}", r, "d", float(i % 4)) for i in range(6) for r in "abc"]
    long = spark.createDataFrame(same, "record_id string, rater string, dim string, score double")
    assert abs(agreement.icc(long, 3).first().icc_2_1 - 1) < 1e-9
    votes = spark.createDataFrame([(f"s{i}", "xy"[i % 2]) for i in range(6) for _ in range(3)], "record_id string, category string")
    assert agreement.fleiss_kappa(votes, 3).first().kappa == 1.0
    pair = spark.createDataFrame([("p", "a", "d", 1.0), ("p", "b", "d", 2.5), ("p", "c", "d", 2.0), ("q", "a", "d", 1.0), ("q", "b", "d", 3.0), ("q", "c", "d", None)], "record_id string, rater string, dim string, score double")
    assert dict(map(tuple, agreement.disagreements(pair).collect())) == {"p": False, "q": True}
    styles = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", None), ("y", "b"), ("y", "b"), ("y", "a")], "record_id string, style string")
    assert {r.record_id: r["style"] for r in agreement.plurality(styles, ["record_id"], "style").collect()} == {"x": "a", "y": "b"}
    iccs = spark.createDataFrame([(0.7555,), (0.5645,), (0.589,), (0.726,)], "icc_2_k double")
    assert agreement.verdict(iccs).first().verdict == "POOR"


def test_consensus_takes_adjudicated_values_of_flagged_rows_only(spark):
    long = spark.createDataFrame([(i, r, d, s) for i in ("p", "q") for d in agreement.DIMS for r, s in (("a", 1.0), ("b", 4.0 if i == "p" else 1.5))], "record_id string, rater string, dim string, score double")
    styles = spark.createDataFrame([("p", "a", "punitive"), ("q", "a", "punitive")], "record_id string, rater string, style string")
    adj = spark.createDataFrame([(i, "5", None, "x", "2", "Educative") for i in ("p", "q")], "record_id string, adj_empathy string, adj_constructiveness string, adj_respect string, adj_social_cohesion string, adj_intervention_style string")
    got = {r.record_id: r for r in agreement.consensus(long, styles, adj).collect()}
    assert (got["p"].empathy, got["p"].respect, got["p"].intervention_style_consensus) == (5.0, 2.5, "educative")
    assert (got["q"].empathy, got["q"].intervention_style_consensus) == (1.0, "punitive")


def test_replies_are_parsed_or_refused(spark):
    full = {d: 2.25 for d in scoring.DIMENSIONS}
    raws = [json.dumps(full | {"confidence": 3}), "```json\n" + json.dumps(full) + "\n```", json.dumps(full | {"respect": 9}), "no json", None, json.dumps({k: v for k, v in full.items() if k != "empathy"})]
    got = scoring.parsed_reply(spark.createDataFrame([(r,) for r in raws], "raw_response string")).collect()
    assert [r.is_parsed for r in got] == [True, True, False, False, False, False] and got[0].empathy == 2.0 and got[0].confidence == 1.0 and got[1].invalid_triple is False


def test_retry_backs_off():
    waits = []

    def fails(_):
        raise TimeoutError("x")

    assert scoring.Retry(sleep=waits.append)(fails, "p") == (None, "TimeoutError: x") and waits == [2.0, 4.0, 8.0]


def records(spark, n=240):
    r = spark.range(n).select(
        F.format_string("reddit_%06d", "id").alias("record_id"), F.when(F.col("id") % 3 == 0, "wikipedia").otherwise("reddit").alias("platform"), (F.col("id") % 17).cast("string").alias("user_id"), F.lit(LONG * 3).alias("pre_intervention_text"), F.lit(LONG).alias("intervention_text"),
        F.when(F.col("id") % 4 == 0, "warning").otherwise("reframe").alias("intervention_type"), F.when(F.col("id") % 5 > 0, LONG).alias("post_intervention_text"), F.timestamp_seconds(F.col("id") * 86_400).alias("timestamp"), (F.col("id") * 13.0 - 20).alias("response_time_minutes"), F.lit('{"post_score": "4"}').alias("platform_metadata"),
    )
    return r.withColumn("intervener_role", F.lit("peer"))


def test_score_features_and_reports(spark, tmp_path):
    sample = records(spark)
    scores = scoring.scored(sample, scoring.stub_scorer)
    scores = scores.withColumns({d: F.when(F.col("record_id") == "reddit_000007", -1.0).otherwise(1 + F.pmod(F.xxhash64("record_id", F.lit(d)), F.lit(9)) / 2.0) for d in scoring.DIMENSIONS}).withColumn("invalid_triple", F.col("record_id") == "reddit_000008")
    reports.features(sample, scores).write.parquet(f"{tmp_path}/features")  # once: dozens of tables read it
    df = spark.read.parquet(f"{tmp_path}/features")
    assert df.count() == 238 and df.filter("se_post_score = 4").count() == 238 and "pre_intervention_text" not in df.columns
    assert reports.features(sample, scores, include_malformed=True).count() == 239
    for name, table in reports.research_questions(df).items():
        assert table.count() >= 0, name
    audit = reports.audit(scores, sample, list(scoring.DIMENSIONS))
    gate = audit["gate"].first()
    assert (gate.n, gate.n_malformed, gate.n_invalid, gate.go) == (240, 1, 1, False)
    assert audit["rates"].filter("level = 3").first().n == 240
    d = reports.tier_d_report(sample, sample.limit(3))
    assert [r.n for r in d["funnel"].orderBy("stage_no").collect()] == [240, 240, 240, 48]
    assert reports.sensitivity(df, ["intervention_type", "platform"]).count() == 2
    for table in reports.label_checks(scores.join(sample.select("record_id", "platform", "intervention_type"), "record_id")).values():
        table.count()


def test_confidence_report(spark):
    rows = [(f"bl_{i}", r, "reddit" if i % 2 else "wikipedia", "educative ", *[float(1 + (i + j) % 5)] * 4, c, c) for i in range(9) for j, (r, c) in enumerate([("r1", "low" if i < 3 else "high "), ("r2", "low"), ("r3", "?" if i < 3 else "medium")])]
    long = spark.createDataFrame(rows, "record_id string, rater string, platform string, intervention_style string, empathy double, constructiveness double, respect double, social_cohesion double, confidence_tier1 string, confidence_style string")
    got = reports.confidence_report(long)
    assert {r.group: r.n for r in got["consensus"].collect()} == {"all_low": 3, "all_not_high": 3, "any_high": 6}
    assert {r.rater: r.low for r in got["by_rater"].collect()} == {"r1": 3, "r2": 9, "r3": 3}
    for t_ in got.values():
        t_.count()
    assert reports.wide_ratings(long, ["empathy"]).count() == 9


def test_one_key_of_200_000_rows_takes_no_square_of_them(spark):
    n, began = 200_000, time.time()
    line = spark.range(n).select(F.lit("u").alias("who"), (F.col("id") * 1_000_000).alias("us"), "id")
    got = triples.as_of(line.filter("id % 2 = 1").withColumnRenamed("id", "event_id"), line.filter("id % 2 = 0"), "who")
    assert got.agg(F.count_if(F.col("pre.id") == F.col("event_id") - 1), F.count_if(F.col("post.id") == F.col("event_id") + 1)).first() == (n // 2, n // 2 - 1)
    comments = spark.range(n).select(F.lit("t").alias("thread"), "id", F.when(F.col("id") % 1000 == 999, "owner").otherwise("other").alias("author"), F.lit("owner").alias("owner"))
    found = triples.owner_next(comments, "thread", ["id"], "author", "owner", ["id"])
    assert found.agg(F.count("*"), F.count_if(F.col("next.id") == F.floor(F.col("id") / 1000) * 1000 + 999)).first() == (n - n // 1000, n - n // 1000)
    said = spark.range(n).select(F.format_string("%06d", "id").alias("utterance_id"), F.lit("c").alias("conversation_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("speaker"), F.when(F.col("id") > 0, F.format_string("%06d", F.col("id") - 1)).alias("reply_to"), F.col("id").alias("timestamp"))
    assert triples.reply_chain(said).agg(F.count("*"), F.count_if(F.col("post_id").cast("long") == F.col("timestamp") + 1)).first() == (n - 2, n - 2)
    split = sampling.split_801010(spark.range(n).withColumn("g", F.lit("x")), ["g"], "id").groupBy("split").count()
    assert dict(map(tuple, split.collect())) == {"train": n * 8 // 10, "val": n // 10, "test": n // 10}
    values = spark.range(n).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), (F.col("id") * 0.5).alias("v"))
    assert stats.pairwise_mann_whitney(values, "g", "v").first().u == (n // 2) * (n // 2 - 1) / 2
    assert stats.medians(values, "g", "v").orderBy("g").first()["median"] == (n - 2) / 4
    assert time.time() - began < 300  # a square of the rows takes hours


def test_ranks_do_not_depend_on_how_rows_are_dealt(spark):
    rows = spark.range(50_000).select((F.col("id") % 3).cast("string").alias("g"), (F.xxhash64("id") % 9000 / 7.0).alias("v"))
    want = rows.toPandas().groupby("g")["v"].quantile([0.1, 0.5, 0.9]).round(9).unstack().to_dict("index")
    for parts in (1, 7):
        got = stats.percentiles(rows.repartition(parts), "v", [10, 50, 90], ["g"]).collect()
        assert {r.g: {0.1: round(r.p10, 9), 0.5: round(r.p50, 9), 0.9: round(r.p90, 9)} for r in got} == want
    nulls = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", None)], "g string, v double")
    assert sorted(map(tuple, stats.percentiles(nulls, "v", [50], ["g"]).collect()), key=str) == sorted([("x", 0, None), (None, 2, 2.0)], key=str)
    own = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(40)], "id long, g string")
    assert {r.g: r["n"] for r in sampling.split_801010(own, ["g"], "id").filter("split = 'val'").groupBy("g").agg(F.count("*").alias("n")).collect()} == {None: 2, "x": 2}


def test_added_content_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    tails = ["\nand a new line at both ends\n", "\t\x0b\x1c\x85other blanks \r", "   　spaces of all kinds    ", " \n mixed \n ", None, ""]
    rows = []
    for i, tail in enumerate(tails):
        before = f"what stood there before, number {i}"
        rows += [(i, 0, "user", before), (i, 1, "user", tail and before + tail + "z" * 30 + tail), (i, 2, "user", "\nshorter\n"), (i, None, "user", "at no known turn, so behind all others, " * 3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalogue.queries()["lag_added_content"](spark, str(tmp_path)).collect()
    sql = catalogue.oracle_sql()["lag_added_content"]
    want = duckdb.sql(sql.replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) == len(rows)


def test_added_content_reads_texts_to_their_end(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    first = "é😀 what stood there first. " * 150  # over 3,000 characters, as are all tails and new texts but one
    tail = "x" * 2990 + "  inner blanks about the place of an old cut  " + "ß" * 90_000
    texts = {0: first, 1: first + " " + tail + "a ", 2: "shorter " + tail[:-1], 3: None, 4: tail + "b", 5: tail + "b" + "short but long enough by two"}
    added = {0: first, 1: tail + "a", 2: "shorter " + tail[:-1], 3: "", 4: tail + "b", 5: "short but long enough by two"}
    spark.createDataFrame([(1, k, "user", x) for k, x in texts.items()], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, catalogue.queries()["lag_added_content"](spark, str(tmp_path)).collect()))
    assert got == [(1, k, len(x), hashlib.md5(x.encode()).hexdigest()) for k, x in added.items()]
    sql = catalogue.oracle_sql()["lag_added_content"]
    assert got == sorted(duckdb.sql(sql.replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")).fetchall())

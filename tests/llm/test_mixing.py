from pyspark.sql import functions as F

from rejoinder.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, tokens long, topic string"


def test_margins_meet_their_targets(spark):
    rows = [(a, b, t, s, u) for a, b, t, s, u in [("x", "m", 10, 0.5, 0.3), ("x", "n", 20, 0.5, 0.7), ("y", "m", 30, 0.5, 0.3), ("y", "n", 5, 0.5, 0.7)]]
    cells = spark.createDataFrame(rows, "a string, b string, tokens long, ta double, tb double")
    for small in (100, 0):
        got = mixing.rake(cells, {"a": "ta", "b": "tb"}, rounds=24, small=small)
        for column, target in (("a", "ta"), ("b", "tb")):
            for r in got.groupBy(column).agg(F.sum("weight").alias("w"), F.first(target).alias("t")).collect():
                assert abs(r["w"] / 65 - r["t"]) < 1e-6


def test_odd_rows(spark):
    odd = [(1, None, None, None, 1, "q"), (1, "", "s", "en", 1, "q"), (None, "a b", "s", None, 1, "q"), (4, "x " * 200_000, "s", "en", 1, "q"), (4, "x " * 200_000, "s", "en", 1, "q")]
    docs = spark.createDataFrame(odd, SCHEMA)
    got = {(r["doc_id"], r["__tokens"]): r["__kept"] for r in mixing.sampled(docs).collect()}
    assert got[1, 0] is True and (4, 200_000) in got and (None, 2) in got
    assert mixing.sampled(docs).filter("doc_id = 4").select("__kept").distinct().count() == 1
    assert mixing.sampled(docs.limit(0)).count() == 0


def test_probabilities_follow_the_cells(spark):
    rows = [(i, "w " * 30, "big" if i % 10 else "small", "en", 1, "q") for i in range(4000)]
    got = mixing.sampled(spark.createDataFrame(rows, SCHEMA), {"source": 0.5}, 0.6).groupBy("source").agg(F.avg(F.col("__kept").cast("int")).alias("rate"), F.first("__probability").alias("p")).collect()
    assert all(abs(r["rate"] - r["p"]) < 0.06 for r in got)
    assert {r["source"]: r["p"] for r in got}["small"] == 1.0


def test_expected_margins_meet_their_targets_without_the_cap(spark):
    rows = [(i, "w " * (30 + 40 * (i % 7)), "hot" if i % 3 == 0 else f"s{i % 11}", ("en", "de", "fr")[i % 5 % 3], 1, "q") for i in range(3000)]
    own = mixing.with_cells(spark.createDataFrame(rows, SCHEMA))
    capped, free = (mixing.margins(mixing.mixed_cells(own, capped=c)).toPandas() for c in (True, False))
    assert capped["gap"].abs().max() > 0.01  # what the cap costs is told
    assert set(free["margin"]) == {"source", "lang", "topic"} and free["gap"].abs().max() < 1e-6
    targets = mixing.tempered(own.groupBy("__source").agg(F.sum("__tokens").alias("tokens")), "__source", mixing.TEMPER["source"]).toPandas().set_index("__source")["target___source"]
    got = free[free["margin"] == "source"].set_index("value")["achieved"]
    assert (got - targets).abs().max() < 1e-4


def test_a_rare_value_costs_the_others_nothing(spark):
    """A topic that hasn't the tokens for its target gives all it has; the sample stays as large as the budget says."""
    rows = [(i, "w " * (250 if i % 40 else 5), "a" if i % 3 else "b", ("en", "de")[i % 7 % 2], 1, "q") for i in range(2000)]
    own = mixing.with_cells(spark.createDataFrame(rows, SCHEMA))
    cells = mixing.mixed_cells(own, {"source": 0.8, "lang": 0.8, "topic": 0.1}, 0.7)
    rare = cells.filter("__topic = 'notes'").toPandas()
    tokens, kept = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    assert (rare["probability"] == 1).all() and abs(kept / tokens - 0.7) < 1e-6
    gaps = mixing.margins(cells).toPandas().set_index(["margin", "value"])["gap"]
    assert gaps["topic", "notes"] < -0.5  # told, as it can't be met
    assert gaps[["source", "lang"]].abs().max() < 1e-6


def test_given_targets_are_met(spark):
    rows = [(i, "w " * (10 + i % 50), ("a", "b", "c")[i % 3], ("en", "de")[i % 2], 1, "q") for i in range(900)]
    own = mixing.with_cells(spark.createDataFrame(rows, SCHEMA))
    given = {"source": {"a": 2, "b": 1, "c": 1, "gone": 5}, "lang": {"en": 0.4, "de": 0.6}}
    got = mixing.margins(mixing.mixed_cells(own, {}, 0.5, targets=given)).toPandas().set_index(["margin", "value"])["achieved"]
    assert abs(got["source", "a"] - 0.5) < 1e-6 and abs(got["source", "c"] - 0.25) < 1e-6 and abs(got["lang", "de"] - 0.6) < 1e-6


def test_asked_and_achieved_shares_stand_in_the_rows(spark):
    rows = [(i, "w " * (250 if i % 40 else 5), "a" if i % 3 else "b", ("en", "de")[i % 7 % 2], 1, "q") for i in range(1200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.sampled(docs, {"source": 0.8, "lang": 0.8, "topic": 0.1}, 0.7, texts=False, shares=True).toPandas()
    weight = got["__tokens"] * got["__probability"]
    for k in ("source", "lang", "topic"):
        for value, own in got.groupby(f"__{k}"):
            assert own[f"asked_{k}"].nunique() == own[f"achieved_{k}"].nunique() == 1
            assert abs(own[f"achieved_{k}"].iloc[0] - weight[own.index].sum() / weight.sum()) < 1e-6, value
    assert abs(got.drop_duplicates("__topic")["asked_topic"].sum() - 1) < 1e-9
    notes = got[got["__topic"] == "notes"].iloc[0]
    assert notes["achieved_topic"] < 0.5 * notes["asked_topic"] and (got["asked_source"] - got["achieved_source"]).abs().max() < 1e-6

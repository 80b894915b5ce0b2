import random
import time

import pytest
from pyspark.sql import functions as F

from rejoinder.operators import scoring, triples
from rejoinder.streaming.as_of_stream import HOUR, as_of_stream
from rejoinder.streaming.scoring_stream import score_stream, scores

COLUMNS = ["record_id", "platform", "intervention_type", "intervener_role", "pre_intervention_text", "intervention_text", "post_intervention_text"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)


def add(spark, folder, ids):
    spark.createDataFrame([(f"r{i}", *["x"] * 6) for i in ids], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, ask, **options):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return score_stream(source, str(tmp_path / "out"), str(tmp_path / "check"), ask, **options)


def test_a_stream_resumes_and_scores_each_record_once(spark, tmp_path):
    for k in range(2):
        add(spark, str(tmp_path / "in"), range(k * 2, k * 2 + 3))
        run(spark, tmp_path, scoring.stub_scorer).awaitTermination(200)
    got = scores(spark, str(tmp_path / "out"))
    assert sorted(r.record_id for r in got.collect()) == ["r0", "r1", "r2", "r3", "r4"] and "batch" not in got.columns
    with pytest.raises(ValueError, match="doesn't know"):
        score_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "other"), scoring.stub_scorer)


def test_a_stop_inside_a_batch_writes_nothing_twice_and_loses_nothing(spark, tmp_path):
    for k in range(3):
        add(spark, str(tmp_path / "in"), range(k * 4, k * 4 + 6))  # ids overlap from file to file
    mark = tmp_path / "calls"
    stop = tmp_path / "stop"
    stop.touch()

    def ask(prompt):
        with mark.open("a") as f:
            f.write("x")
        if stop.exists() and mark.stat().st_size > 8:
            raise SystemExit("killed")  # not an error of the scorer: it ends the task, and so the batch
        return scoring.stub_scorer(prompt)

    with pytest.raises(Exception):  # noqa: B017  whatever the engine reports
        run(spark, tmp_path, ask).awaitTermination(200)
    done = [r.record_id for r in scores(spark, str(tmp_path / "out")).collect()]
    assert 0 < len(done) < 14
    stop.unlink()
    run(spark, tmp_path, ask).awaitTermination(200)
    assert sorted(r.record_id for r in scores(spark, str(tmp_path / "out")).collect()) == sorted(f"r{i}" for i in range(14))


def test_the_rate_holds_for_the_whole_job(spark):
    rows = spark.createDataFrame([(f"r{i}", *["x"] * 6) for i in range(48)], SCHEMA).repartition(4)
    warm = scoring.scored(rows.limit(1), lambda p: "{}")
    warm.collect()
    got = scoring.scored(rows, lambda p: str(time.time()), per_second=16.0, lanes=4).select("raw_response").collect()
    at = sorted(float(r.raw_response) for r in got)
    assert len(at) == 48 and max(sum(a <= b < a + 1.0 for b in at) for a in at) <= 16 + 4
    naps = []
    pace = scoring.Pace(0.5, clock=lambda: 10.0, sleep=naps.append)
    for _ in range(3):
        pace()
    assert naps == [0.5, 1.0]


def test_stream_of_neighbours_equals_the_batch_join(spark, tmp_path):
    rnd, t0 = random.Random(6), 500_000 * HOUR
    times = [t0 + rnd.randrange(0, 400) * HOUR // 2 for _ in range(160)]
    rows = [(f"k{rnd.randrange(3)}", t, f"{'e' if rnd.random() < 0.4 else 'v'}{i:03d}") for i, t in enumerate(sorted(times))]
    end = [(f"k{k}", t0 + 2_000 * HOUR, f"z{k}") for k in range(3)] + [("k0", t0 + 4_000 * HOUR, "z9")]  # the watermark passes all others
    schema = "who string, us long, id string"
    for n, part in enumerate([rows[:60], rows[60:110], rows[110:], end[:3], end[3:]]):
        (spark.createDataFrame(rnd.sample(part, len(part)), schema).withColumn("at", F.timestamp_micros("us")).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}")))
    stream = spark.readStream.schema(f"{schema}, at timestamp, n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    joined = as_of_stream(stream.filter("id like 'e%'"), stream.filter("id like 'v%' or id like 'z%'"), "who", "at", "id", late="400 hours")
    got = []
    out = str(tmp_path / "out")
    for _ in range(2):  # the second start goes on where the first one ended
        joined.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(300)
    got = sorted((r.key, r.us, r.event_id, r.pre_id, r.post_id) for r in spark.read.parquet(out).collect())
    table = spark.createDataFrame(rows, schema)
    batch = triples.as_of(table.filter("id like 'e%'").withColumnRenamed("id", "event_id"), table.filter("id like 'v%'"), "who")
    near = F.when(F.col("post.us") - F.col("us") <= 48 * HOUR, F.col("post.id"))
    want = sorted((r.who, r.us, r.event_id, r.pre, r.post) for r in batch.select("who", "us", "event_id", F.col("pre.id").alias("pre"), near.alias("post")).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert got == want

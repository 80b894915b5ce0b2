"""Segmented scans: any key's share of the rows, results of a plain window."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.operators import triples
from rejoinder.operators.carry import Nearest, carried
from rejoinder.operators.membership import pruned_members


def test_carried_equals_a_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None, "c"]), rnd.randrange(40) if rnd.random() > 0.05 else None, i, rnd.choice([None, None, None, i])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at int, id int, v int").repartition(5)
    up, down = W.partitionBy("k").orderBy("at", "id"), W.partitionBy("k").orderBy(F.col("at").desc(), F.col("id").desc())
    frame = (W.unboundedPreceding, -1)
    want = df.select("id", F.last("v", True).over(up.rowsBetween(*frame)).alias("before"), F.last("v", True).over(down.rowsBetween(*frame)).alias("after"))
    for parts in (1, 7, 40):
        got = carried(df, ["k"], ["at", "id"], parts, before=Nearest(F.col("v")), after=Nearest(F.col("v"), "after")).select("id", "before", "after")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        tied = carried(df, ["k"], ["at"], parts, before=Nearest(F.col("v"), "before", [F.col("id")]), after=Nearest(F.col("v"), "after", [F.col("id")])).select("id", "before", "after")
        assert sorted(map(str, tied.collect())) == sorted(map(str, want.collect()))
    assert carried(df.limit(0), ["k"], ["at", "id"], before=Nearest(F.col("v"))).count() == 0
    alone = carried(df, [], ["id"], 6, before=Nearest(F.col("v"))).orderBy("id").select("before").collect()
    seen, line = None, []
    for r in sorted(rows, key=lambda r: r[2]):
        line.append(seen)
        seen = r[3] if r[3] is not None else seen
    assert [r.before for r in alone] == line


def test_a_key_with_all_rows_is_worked_on_by_many_tasks(spark):
    n, parts = 60_000, 16
    rows = spark.range(n).select(F.lit("hot").alias("who"), (F.col("id") * 1_000_003 % n * 10**6).alias("us"), "id", F.repeat(F.lit("x"), 50).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = triples.as_of(rows.filter("id % 3 = 0").select("who", "us", F.col("id").alias("event")), rows.filter("id % 3 > 0"), "who")
        spread = got.groupBy(F.spark_partition_id()).count().collect()
        assert len(spread) >= parts // 2 and max(r["count"] for r in spread) < n / 3 / 2
        at = {i * 1_000_003 % n: i for i in range(n)}
        for r in got.filter("event % 1001 = 0").collect():
            p = r.us // 10**6
            pre = next((at[q] for q in range(p - 1, -1, -1) if at[q] % 3), None)
            post = next((at[q] for q in range(p + 1, n) if at[q] % 3), None)
            assert (r.pre and r.pre.id, r.post and r.post.id) == (pre, post) and len((r.pre or r.post).text) == 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_scan_skips_what_lies_between_members(spark, tmp_path):
    path = str(tmp_path / "sorted")
    spark.range(40_000).select("id", F.md5(F.col("id").cast("string")).alias("text")).repartitionByRange(20, "id").sortWithinPartitions("id").write.parquet(path)
    members = spark.createDataFrame([(i,) for i in (*range(100, 140), *range(39_000, 39_020), 77_777)] + [(None,)], "m long")
    got = pruned_members(spark.read.parquet(path), "id", members, 8)

    def scanned(df):
        df._jdf.queryExecution().executedPlan().execute().count()
        text = df._jdf.queryExecution().executedPlan()

        def walk(node):
            if "Scan" in node.nodeName() and node.metrics().contains("numOutputRows"):
                yield node.metrics().apply("numOutputRows").value()
            for i in range(node.children().size()):
                yield from walk(node.children().apply(i))
            if node.nodeName() == "AdaptiveSparkPlan":
                yield from walk(node.executedPlan())
            if "QueryStage" in node.nodeName():
                yield from walk(node.plan())

        return max(walk(text))

    assert scanned(got) < 40_000 / 4  # row groups between the ranges aren't read
    assert sorted(r.id for r in got.collect()) == [*range(100, 140), *range(39_000, 39_020)]
    assert pruned_members(spark.read.parquet(path), "id", members.limit(0), 8).count() == 0
    strings = spark.read.parquet(path).withColumn("k", F.col("id").cast("string"))
    assert pruned_members(strings, "k", members.select(F.col("m").cast("string")), 4).count() == 60

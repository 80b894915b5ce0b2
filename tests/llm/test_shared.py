import pyarrow as pa

from rejoinder.llm import shared


def test_batches_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "64m")
    shared.in_small_batches(spark)
    wide = spark.range(0, 1000, 1, 1).selectExpr("id", "repeat('x', 20000) AS text")
    sizes = [r.size for r in wide.mapInArrow(lambda batches: (pa.record_batch({"size": [b.nbytes]}) for b in batches), "size long").collect()]
    assert sum(sizes) >= 20_000_000 and max(sizes) < 2 * shared.BATCH_BYTES
    spark.conf.set(key, "1000")
    shared.in_small_batches(spark)
    assert spark.conf.get(key) == "1000"
    spark.conf.unset(key)

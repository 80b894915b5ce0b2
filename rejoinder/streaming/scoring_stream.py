"""Streaming counterparts: resumable scoring of arriving records, and event-time windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rejoinder.operators import scoring
from rejoinder.sources.readers import exists


def score_stream(records: DataFrame, out: str, checkpoint: str, ask: Callable[[str], str], at: str | None = None, forget: str | None = None, **options) -> StreamingQuery:
    """Score what arrives, each record_id once, in a folder of ``out`` for each micro-batch.

    Which ids have been let through is keyed state of the query, in its checkpoint: a batch reads the state of the ids
    that it holds, never what was written before. A batch that was stopped is repeated after a restart with the same
    records and replaces its own folder, so none is written twice and none is lost. With ``at`` (an event time) and
    ``forget`` (such as "30 days") ids leave the state that long after they came; a record that repeats later than that
    is scored again. options: those of scoring.scored, such as per_second.

    Starting over on an old ``out`` with a new checkpoint raises, since the ids that are done are in the old one.
    """
    spark = records.sparkSession
    if exists(spark, out) and not exists(spark, checkpoint):
        raise ValueError(f"{out} has scores, but {checkpoint} doesn't know their records")
    new = records.withWatermark(at, forget).dropDuplicatesWithinWatermark(["record_id"]) if at and forget else records.dropDuplicates(["record_id"])

    def batch(rows: DataFrame, number: int) -> None:
        scoring.scored(rows, ask, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scores(spark: SparkSession, out: str) -> DataFrame:
    """All scores that a stream has written."""
    return spark.read.parquet(out).drop("batch")


def windowed_counts(events: DataFrame, at: str, kind: str, value: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per event-time window; the same plan on a stream (with its watermark) and on a table."""
    return events.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")

"""Scoring of records by an outside scorer: prompt, reply parsing, retries, and resuming after what is done."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.functions import text as t

TIER1 = ("empathy", "constructiveness", "respect", "social_cohesion")
TIER3 = ("deliberative_quality", "task_norm_alignment")
DIMENSIONS = TIER1 + TIER3
SCORES = "record_id string, raw_response string, label_error string, input_tokens long, output_tokens long"
REPLY = ", ".join(f"{d} string" for d in DIMENSIONS) + ", confidence string, invalid_triple boolean, rationale string"


def prompt() -> Column:
    """What a record's scorer is given: where and how someone was corrected, then the three texts under headings."""

    def part(heading, c):
        return F.concat(F.lit(f"\n\n## {heading}\n"), F.coalesce(t.strip(c), F.lit("")))

    def known(c):
        return F.coalesce(c, F.lit("unknown"))

    where = F.concat(F.lit("Corrected on "), known("platform"), F.lit(" by a "), known("intervener_role"), F.lit(", in the form of a "), known("intervention_type"), F.lit("."))
    return F.concat(where, part("Written before", "pre_intervention_text"), part("The correction", "intervention_text"), part("Written after, to be scored", "post_intervention_text"), F.lit("\n"))


def parsed_reply(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Adds the six scores, confidence, invalid_triple, rationale and is_parsed.

    The text from the first { to the last } must be a JSON object with all six scores, which are put on the grid of
    halves (ties to even) and must lie from 1 to 5. Confidence is clamped to [0, 1]. Else all is null.
    """
    body = F.regexp_extract(F.coalesce(F.col(raw), F.lit("")), r"(?s)\{.*\}", 0)
    df = df.withColumn("__r", F.from_json(body, REPLY, {"mode": "PERMISSIVE"}))
    on_grid = {d: t.round_half(F.expr(f"try_cast(__r.{d} as double)")) for d in DIMENSIONS}
    ok = F.lit(True)
    for v in on_grid.values():
        ok = ok & F.coalesce(v.between(1.0, 5.0), F.lit(False))
    df = df.withColumn("is_parsed", ok)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr("try_cast(__r.confidence as double)")))
    return df.withColumns(
        {d: F.when(F.col("is_parsed"), v) for d, v in on_grid.items()}
        | {
            "confidence": F.when(F.col("is_parsed") & F.col("__r.confidence").isNotNull(), confidence),
            "invalid_triple": F.when(F.col("is_parsed"), F.coalesce("__r.invalid_triple", F.lit(False))),
            "rationale": F.when(F.col("is_parsed"), F.coalesce("__r.rationale", F.lit("{}"))),
        }
    ).drop("__r")


def pending(records: DataFrame, done: DataFrame) -> DataFrame:
    """Records that have no score yet."""
    return records.join(done.select("record_id"), "record_id", "left_anti")


@dataclass
class Retry:
    """Attempts and pauses: base * 2 ** (attempt - 1) seconds, twice that after a refusal for rate."""

    attempts: int = 4
    base: float = 2.0
    pause: float = 0.0
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, ask: Callable[[str], str], prompt: str) -> tuple[str | None, str | None]:
        error = None
        for attempt in range(1, self.attempts + 1):
            try:
                reply = ask(prompt)
                if self.pause:
                    self.sleep(self.pause)
                return reply, None
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                if attempt < self.attempts:
                    self.sleep(self.base * 2 ** (attempt - 1) * (2 if "rate" in type(e).__name__.lower() else 1))
        return None, error


@dataclass
class Pace:
    """Calls of one lane, at least ``interval`` seconds apart from begin to begin."""

    interval: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    due: float = 0.0

    def __call__(self) -> None:
        now = self.clock()
        if now < self.due:
            self.sleep(self.due - now)
        self.due = max(now, self.due) + self.interval


def scored(records: DataFrame, ask: Callable[[str], str], retry: Retry | None = None, per_second: float | None = None, lanes: int | None = None) -> DataFrame:
    """record_id and the scorer's raw reply (or error) for each record: SCORES, then parsed.

    per_second bounds the calls of the whole job, retries included, whatever the number of cores: records are dealt to
    ``lanes`` partitions (as many as there are cores if not given), no more of which can run at once, and each lane has
    an even share of the rate.
    """
    retry = retry or Retry()
    if per_second:
        lanes = lanes or records.sparkSession.sparkContext.defaultParallelism
        records = records.repartition(lanes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(lanes / per_second) if per_second else None

        def paced(p: str) -> str:
            if pace:
                pace()
            return ask(p)

        for b in batches:
            replies = [retry(paced, p) for p in b["prompt"]]
            yield pd.DataFrame({
                "record_id": b["record_id"], "raw_response": [r for r, _ in replies], "label_error": [e for _, e in replies],
                "input_tokens": [len(p) // 4 for p in b["prompt"]], "output_tokens": [len(r or "") // 4 for r, _ in replies],
            })

    raw = records.select("record_id", prompt().alias("prompt")).mapInPandas(run, SCORES)
    parsed = parsed_reply(raw)
    return parsed.withColumn("label_error", F.coalesce("label_error", F.when(~F.col("is_parsed"), "unparsed")))


def stub_scorer(prompt: str) -> str:
    """A deterministic scorer for tests: scores from the prompt's length and marks."""
    import json

    base = 1.0 + (len(prompt) % 9) / 2
    return json.dumps({d: min(5.0, base) for d in DIMENSIONS} | {"confidence": 0.5 + (prompt.count("?") % 5) / 10, "invalid_triple": len(prompt) < 150})


def with_sentinels(scores: DataFrame) -> DataFrame:
    """-1 for the scores of failed rows, as files for other tools hold them."""
    return scores.withColumns({d: F.coalesce(d, F.lit(-1.0)) for d in (*DIMENSIONS, "confidence")})


def cost(scores: DataFrame, input_rate: float, output_rate: float) -> DataFrame:
    """Token sums and their price at rates per million."""
    s = scores.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return s.withColumn("cost", (F.col("input_tokens") * input_rate + F.col("output_tokens") * output_rate) / 1e6)

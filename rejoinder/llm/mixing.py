"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed to cells of source, language and topic. The cells' token weights are raked: scaled in turn so that
each margin's weights meet its target shares of ``budget`` times all tokens. A value of a margin that hasn't the tokens
for its target gives all it has, and the margin's other values share what it lacks in proportion (``feasible``). Nor can
a cell give more tokens than it has, so raking is bounded: a cell that would exceed its tokens is held at them and the
others make up for it (what holds is a cell's factors' product, so it can come below its tokens again). Rounds go on
until all margins meet their feasible targets to ``TOLERANCE``. If they stop coming nearer, as targets that contradict
each other do, the budget is lowered a few times; what then remains is warned of. ``margins`` states what every value's
expected tokens are beside its target. A document's probability is its cell's weight over its tokens, and it stays if a
number drawn from its doc_id is lower.

With ``capped`` probabilities are cut at 1 after unbounded raking instead, and no cell makes up for it.

A hot source is one row per language and topic after the partial sums, so nothing is dealt by source. While there
are at most ``SMALL`` cells, raking runs in one task without any shuffle and the cells are broadcast; beyond that
margins are summed by partial aggregates and joined back by shuffle.

Defined cases: a null text is empty and weighs 0 tokens (a cell without tokens keeps all of its documents); a very
long text is counted whole; null sources and languages are values of their own; rows with the same doc_id share their
fate within a cell; an empty table gives no rows; columns are added with a leading "__" and, where the input has such
a column already, as many underscores behind as make it a new one (``added``).
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.llm.shared import free_names, stored

#: Rounds between two written tables; by how much the margins may miss their targets.
STRETCH, TOLERANCE = 4, 1e-9
#: Gaps that don't shrink by a tenth in a stretch have stalled; what is then left of the budget, and how often.
STALLED, LOWER, LOWERINGS = 0.9, 0.9, 3
SMALL = 100_000
#: Target share of a margin's value: its token share to this power, over the sum of all.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
BUDGET = 0.8
NONE = "\x01"
WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
NAMES = ("__source", "__lang", "__topic", "__tokens", "__probability", "__kept")


def added(docs: DataFrame) -> dict[str, str]:
    """The names that ``sampled`` gives its columns on these documents, by their names in NAMES without underscores."""
    return {n.strip("_"): own for n, own in zip(NAMES, free_names(docs.columns, *NAMES), strict=True)}


def word_count(text: Column) -> Column:
    """Words are runs of characters other than space and tab to carriage return."""
    marks = F.regexp_replace(text, WORD, ".")
    return F.when(F.contains(marks, F.lit(".")), F.length(marks)).otherwise(F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A stand-in for a topic, as documents have none: the text's form."""
    return (
        F.when(F.contains(text, F.lit(" | ")), F.lit("tables"))
        .when(F.length(text) < 400, F.lit("notes"))
        .when(F.length(text) > 6000, F.lit("long reads"))
        .otherwise(F.lit("articles"))
    )


def with_cells(docs: DataFrame, topic=topic_of, tokens=word_count) -> DataFrame:
    """Adds __source, __lang, __topic and __tokens (or as ``added`` names them)."""
    text, to = F.coalesce(F.col("text").cast("string"), F.lit("")), added(docs)
    return docs.withColumns({
        to["source"]: F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
        to["lang"]: F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        to["topic"]: topic(text),
        to["tokens"]: tokens(text),
    })


def _scaled(cells: DataFrame, column: str, target: str, in_place: bool) -> DataFrame:
    """weight scaled to the margin's targets (of the rows' upper bounds those that are reached stay), and its gap before."""
    full = F.col("weight") >= F.col("upper")
    sums = {"held": F.sum(F.when(full, F.col("upper")).otherwise(0.0)), "free": F.sum(F.when(full, 0.0).otherwise(F.col("weight")))}
    if in_place:
        now = cells.withColumns({k: v.over(W.partitionBy(column)) for k, v in sums.items()})
    else:
        now = cells.join(cells.groupBy(column).agg(*[v.alias(k) for k, v in sums.items()]), column)
    want = F.col("total") * F.col(target)
    open_ = F.greatest(want - F.col("held"), F.lit(0.0)) / F.col("free")
    factor = F.when(F.col("free") > 0, open_).when(F.col("held") > 0, want / F.col("held")).otherwise(F.lit(1.0))
    gap = F.when(want > 0, F.abs((F.col("held") + F.col("free")) / want - 1)).otherwise(F.lit(0.0))
    return now.withColumns({"weight": F.col("weight") * factor, "gap": F.greatest("gap", gap)}).drop("held", "free")


def _raked(cells: DataFrame, margins: dict[str, str], rounds: int | None, small: int) -> tuple[DataFrame, float, bool]:
    """cells (weight, upper, total) after ``rounds``, or until their gap is below TOLERANCE or has stalled; the gap; if a cell is held."""
    in_place = cells.count() <= small  # bounded: in one task every window finds its rows in place
    now, done, before = cells, 0, float("inf")
    while True:
        now = now.coalesce(1) if in_place else now
        for i in range(STRETCH):
            now = now.withColumn("gap", F.lit(0.0)) if i in (0, STRETCH - 1) else now
            for column, target in margins.items():
                now = _scaled(now, column, target, in_place)
            now = now if in_place else stored(now, "scaled", wave=True)  # each join with its own sums doubles the plan
        now, done = stored(now, "raked"), done + STRETCH
        gap, full = now.agg(F.max("gap"), F.max(F.col("weight") >= F.col("upper"))).first()
        gap = gap or 0.0
        if (done >= rounds) if rounds else (gap <= TOLERANCE or gap > STALLED * before):
            return now, gap, bool(full)
        before = gap


def rake(cells: DataFrame, margins: dict[str, str], start: str = "tokens", rounds: int | None = None, small: int = SMALL) -> DataFrame:
    """Adds weight: start, scaled in turn until each margin's sums are its targets. margins: column -> target column.

    A target column holds the share of the row's value in its margin. rounds: at least as many, whatever the gap.
    """
    total = cells.agg(F.sum(F.col(start).cast("double"))).first()[0] or 0.0
    begin = cells.withColumns({"weight": F.col(start).cast("double"), "total": F.lit(total), "upper": F.lit(float("inf"))})
    return _raked(stored(begin, "cells"), margins, rounds, small)[0].drop("total", "upper", "gap")


def feasible(sums: DataFrame, budget: float, total: float) -> DataFrame:
    """sums (margin, value, t, share) with feasible: share, but at most t / (budget * total), others of a margin making up.

    A share is raised by its margin's factor, which a few sums over all values find: each may hold more values at what
    they have, and raises the factor of the others.
    """
    cap, factors = F.col("t") / F.lit(budget * total), {}
    while True:
        raised = F.col("share") * F.coalesce(*[F.when(F.col("margin") == m, F.lit(f)) for m, f in factors.items()], F.lit(1.0))
        held = raised > cap
        now = {}
        for r in sums.groupBy("margin").agg(F.sum(F.when(held, cap).otherwise(0.0)).alias("held"), F.sum(F.when(held, 0.0).otherwise(F.col("share"))).alias("free")).collect():  # a row a margin
            now[r["margin"]] = max(factors.get(r["margin"], 1.0), (1 - r["held"]) / r["free"]) if r["free"] > 0 else factors.get(r["margin"], 1.0)
        if all(f <= factors.get(m, 1.0) * (1 + 1e-12) for m, f in now.items()):
            return sums.withColumn("feasible", F.least(raised, cap))
        factors = now


def rake_bounded(cells: DataFrame, margins: dict[str, str], budget: float = BUDGET, small: int = SMALL) -> DataFrame:
    """Adds weight, at most tokens in each row: each margin's sums are its feasible target shares of budget * all tokens.

    The budget is lowered only if these can't be met together.
    """
    cells = stored(cells, "cells")
    sums = stored(_margin_sums(cells, list(margins), F.coalesce(*[F.when(F.col("m.margin") == c, F.col(t)) for c, t in margins.items()])), "margins", wave=True)
    total = sums.agg(F.sum(F.when(F.col("margin") == next(iter(margins)), F.col("t")))).first()[0]
    if not total:
        return cells.withColumn("weight", F.lit(0.0))
    for lowered in range(LOWERINGS + 1):
        begin, found = cells, feasible(sums, budget, total)
        for column in margins:
            begin = begin.join(found.filter(F.col("margin") == column).select(F.col("value").alias(column), F.col("feasible").alias(f"feasible_{column}")), column)
        begin = stored(begin.withColumns({"weight": F.lit(budget) * F.col("tokens"), "total": F.lit(budget * total), "upper": F.col("tokens").cast("double")}), "begin", wave=True)
        now, gap, held = _raked(begin, {c: f"feasible_{c}" for c in margins}, None, small)
        if gap <= TOLERANCE or not held or lowered == LOWERINGS:
            break
        budget *= LOWER
    if gap > 1e-6:
        warnings.warn(f"target weights contradict each other: a margin is off by {gap:.3g} of its target", stacklevel=2)
    return now.withColumn("weight", F.least("weight", "upper")).drop("total", "upper", "gap", *[f"feasible_{c}" for c in margins])


def _margin_sums(cells: DataFrame, columns: list[str], share: Column | None = None) -> DataFrame:
    """margin, value, t (tokens) and, where it is given, share of every value of the columns."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("margin"), F.col(c).alias("value")) for c in columns])).alias("m")
    more = [F.first("share").alias("share")] if share is not None else []
    own = cells.select("*", each)
    own = own.select("m", "tokens", *([share.alias("share")] if more else []))
    return own.groupBy("m.margin", "m.value").agg(F.sum("tokens").cast("double").alias("t"), *more)


def with_targets(cells: DataFrame, powers: dict[str, float], given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Adds target_<column> for each column of powers and given: the value's share of the margin.

    powers: token share to this power, over the sum of all values'; given: the values' weights, over the sum of those
    that occur (0 for a value without one).
    """
    given = given or {}
    columns = list({**powers, **given})
    sums = _margin_sums(cells, columns)
    raw = F.lit(0.0)
    for column in columns:
        if column in given:
            known = F.create_map(*[x for k, v in given[column].items() for x in (F.lit(k), F.lit(float(v)))])
            own = F.coalesce(F.try_element_at(known, F.col("value")), F.lit(0.0)) if given[column] else F.lit(0.0)
        else:
            own = F.pow(F.col("t"), powers[column])
        raw = F.when(F.col("margin") == column, own).otherwise(raw)
    sums = stored(sums.withColumn("raw", raw), "margins")
    whole = {r["margin"]: r["whole"] for r in sums.groupBy("margin").agg(F.sum("raw").alias("whole")).collect()}  # a row a margin
    for column in columns:
        share = F.col("raw") / F.lit(whole[column]) if whole.get(column) else F.lit(0.0)
        cells = cells.join(sums.filter(F.col("margin") == column).select(F.col("value").alias(column), share.alias(f"target_{column}")), column)
    return cells


def tempered(cells: DataFrame, column: str, power: float) -> DataFrame:
    """Adds target_<column>: the value's token share to this power, over the sum of all values'."""
    return with_targets(cells, {column: power})


def mixed_cells(docs: DataFrame, powers: dict[str, float] = TEMPER, budget: float = BUDGET, capped: bool = False, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Per cell: __source, __lang, __topic, tokens, documents, weight, probability. docs: as with_cells gives them.

    targets: by margin the share of each value, in place of powers. capped: rake without bounds and cut at 1.
    """
    cells = stored(docs.groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("documents")), "cells")
    given = {f"__{k}": v for k, v in (targets or {}).items()}
    powers = {f"__{k}": v for k, v in powers.items() if f"__{k}" not in given}
    cells, margins = with_targets(cells, powers, given), {k: f"target_{k}" for k in (*powers, *given)}
    raked, scale = (rake(cells, margins), budget) if capped else (rake_bounded(cells, margins, budget), 1.0)
    share = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(scale) * F.col("weight") / F.col("tokens"))).otherwise(F.lit(1.0))
    shares = [F.col(t).alias(f"target_{c.removeprefix('__')}") for c, t in margins.items()]
    return stored(raked.select("__source", "__lang", "__topic", "tokens", "documents", "weight", F.round(share, 9).alias("probability"), *shares), "mixed", wave=True)


def margins(cells: DataFrame) -> DataFrame:
    """margin, value, target, achieved, gap: target and expected token shares, gap their ratio less 1. cells: as mixed_cells gives them."""
    names = [c.removeprefix("target_") for c in cells.columns if c.startswith("target_")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("margin"), F.col(f"__{n}").alias("value"), F.col(f"target_{n}").alias("target")) for n in names])).alias("m")
    own = cells.select(each, (F.col("tokens") * F.col("probability")).alias("e")).groupBy("m.margin", "m.value").agg(F.first("m.target").alias("target"), F.sum("e").alias("e"))
    whole = own.groupBy("margin").agg(F.sum("e").alias("es"))
    got = own.join(whole, "margin").select("margin", "value", "target", F.try_divide("e", "es").alias("achieved"))
    return got.withColumn("gap", F.try_divide("achieved", "target") - 1)


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """A number from [0, 1), the same for the same doc_id wherever it is computed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sampled(docs: DataFrame, powers: dict[str, float] = TEMPER, budget: float = BUDGET, capped: bool = False, targets: dict[str, dict[str, float]] | None = None, texts: bool = True, shares: bool = False) -> DataFrame:
    """docs with their cells' columns, __probability and __kept. budget, capped and targets: as in mixed_cells.

    shares: also the asked and the achieved token share of the row's value in each margin (asked_source, achieved_source
    and so on), which differ where a value hasn't the tokens for its target.

    texts: whether the texts are wanted. Without them the cells' columns are computed once and written; with them
    they are computed again rather than writing all texts.
    """
    to = added(docs)
    own = with_cells(docs)
    if not texts:
        own = stored(own.drop("text"), "tokens")
    keys = ("source", "lang", "topic")
    cells = mixed_cells(own.select(*[F.col(to[k]).alias(f"__{k}") for k in (*keys, "tokens")]), powers, budget, capped, targets)
    told = [f"{kind}_{k}" for k in keys for kind in ("asked", "achieved")] if shares else []
    if shares:
        expected = F.col("tokens") * F.col("probability")
        whole = cells.agg(F.sum(expected)).first()[0] or 0.0
        achieved = {f"achieved_{k}": F.coalesce(F.sum(expected).over(W.partitionBy(f"__{k}")) / F.lit(whole), F.lit(0.0)) if whole else F.lit(0.0) for k in keys}
        cells = stored(cells.withColumns(achieved).withColumnsRenamed({f"target_{k}": f"asked_{k}" for k in keys}), "shares", wave=True)
    known = cells.select(*[F.col(f"__{k}").alias(to[k]) for k in keys], F.col("probability").alias(to["probability"]), *told)
    if cells.count() <= SMALL:
        known = F.broadcast(known)
    joined = own.join(known, [to[k] for k in keys], "left")
    return joined.withColumn(to["kept"], draw(F.col("doc_id")) < F.col(to["probability"]))

"""Document quality by hierarchical empirical Bayes.

A logistic model over a text's character make-up and its repetition of words, pairs of words and lines gives each
document's own evidence, a probability. Grouped sums of these by path and host give the spread of probabilities
within paths, between the paths of a host and between hosts (nested analysis of variance, method of moments). Each
host's rate is shrunk toward the global one and each path's toward its host's, the more the fewer documents it has and
the less such sites differ beyond chance: where sites don't differ at all, every rate is the global one and only a
document's own evidence counts. A site's rate counts as known no better than as many labels would tell it.

A document's posterior is its own evidence times the ratio of its path's odds to the global odds; for that its own
probability is taken out of its path's and host's sums, so it doesn't count twice.

The host and path are columns that the caller names. Sites are summed by partial aggregates, so a host with a third
of all rows is no burden; the joined table of sites is broadcast only while it has at most ``SMALL`` rows, else joined
by shuffle.

Defined cases: a null or empty text has the features of no characters, and one without two words or lines repeats
none; a very long text is featured whole, in a step of its own; a null host or path is a site of its own;
without labels of both kinds the evidence is the share of label 1 (everything is kept without any); rows with the
same doc_id are judged each for itself and each counts for its site; documents with equal posteriors are kept or go
alike; an empty table gives no rows; added columns have names with a leading "__" and, where the input has such a
column already, as many underscores behind as make it a new one (``added``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.shared import BASE, CHUNK_CHARS, free_names, in_small_batches, mixed, span_hashes, stored

SAMPLE = 20_000
SMALL = 100_000
THRESHOLD = 0.5
KINDS = 14
#: Words, pairs of neighbouring words and lines: for each how few are distinct, and the share of the commonest one;
#: then the share of words that are the same as the word before.
REPEATS = 7
FEATURES = KINDS + 2 + REPEATS


def _kind_of_byte() -> np.ndarray:
    kind = np.full(256, 13, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kind[b] = 5
        elif "a" <= c <= "z":
            kind[b] = 0
        elif "A" <= c <= "Z":
            kind[b] = 1
        elif "0" <= c <= "9":
            kind[b] = 2
        elif c == " ":
            kind[b] = 3
        elif c in "\t\n\r\x0b\x0c":
            kind[b] = 4
        elif c in "!|":
            kind[b] = 6 + "!|".index(c)
        elif c in ".,;:?'\"()-":
            kind[b] = 8
        elif c in "#$%&*":
            kind[b] = (9, 10, 10, 11, 12)["#$%&*".index(c)]
    return kind


BYTE_KIND = _kind_of_byte()


def _runs(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; ``first`` marks where a text begins, which no run goes over."""
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | first))
    after, last = np.concatenate([inside[1:], [False]]), np.concatenate([first[1:], [True]])
    return starts, np.flatnonzero(inside & (~after | last)) + 1


def _repeats(hashes: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    """Two columns by text: 1 - log distinct / log all, and the root of the commonest one's share; 0 below two."""
    _, at, often = np.unique(mixed(hashes + text.astype(np.uint64) * np.uint64(BASE)), return_index=True, return_counts=True)
    n = np.bincount(text, minlength=count)
    distinct, most = np.bincount(text[at], minlength=count), np.zeros(count, dtype=np.int64)
    np.maximum.at(most, text[at], often)
    some = n >= 2
    n, distinct, most = np.where(some, n, 2), np.where(some, distinct, 2), np.where(some, most, 0)
    return np.column_stack([1 - np.log(distinct) / np.log(n), np.sqrt(most / n)])


def repetition(data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """REPEATS columns of texts whose bytes stand in a row in ``data``, n of each."""
    whose, first = np.repeat(np.arange(len(n)), n), np.zeros(len(data), dtype=bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    out = []
    begins, ends = _runs((data != 32) & ((data < 9) | (data > 13)), first)
    words, text = mixed(span_hashes(data, begins, ends)), whose[begins]
    out.append(_repeats(words, text, len(n)))
    pair = text[1:] == text[:-1]
    again = np.bincount(text[1:][pair & (words[1:] == words[:-1])], minlength=len(n))
    again = np.sqrt(again / np.maximum(1, np.bincount(text[1:][pair], minlength=len(n))))
    out.append(_repeats((words[:-1] * np.uint64(BASE) + words[1:])[pair], text[1:][pair], len(n)))
    starts, ends = _runs(data != 10, first)
    written = np.searchsorted(begins, starts) < np.searchsorted(begins, ends)  # lines that hold a word
    starts, ends = starts[written], ends[written]
    out.append(_repeats(mixed(span_hashes(data, starts, ends)), whose[starts], len(n)))
    return np.column_stack([*out, again])


def features(texts: list[str | None]) -> np.ndarray:
    """Of each text square roots of the shares of KINDS kinds of characters, mean word length, log length, repetition."""
    out = np.zeros((len(texts), FEATURES))
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= CHUNK_CHARS):
            size += len(texts[stop] or "")
            stop += 1
        own = [(t or "").encode("utf-8", "surrogatepass") for t in texts[at:stop]]
        n = np.array([len(t) for t in own], dtype=np.int64)
        data = np.frombuffer(b"".join(own), dtype=np.uint8)
        kinds = BYTE_KIND[data]
        counts = np.bincount(np.repeat(np.arange(len(own)), n) * KINDS + kinds, minlength=len(own) * KINDS).reshape(-1, KINDS)
        out[at:stop, :KINDS] = np.sqrt(counts / np.maximum(1, n)[:, None])
        out[at:stop, KINDS] = np.minimum(4, (n - counts[:, 3] - counts[:, 4]) / (counts[:, 3] + counts[:, 4] + 1) / 10)
        out[at:stop, KINDS + 1] = np.log1p(n) / 10
        out[at:stop, KINDS + 2 :] = repetition(data, n)
        at = stop
    return out


@dataclass
class Evidence:
    bias: float
    weights: np.ndarray

    def logit(self, texts: list[str | None]) -> np.ndarray:
        return np.clip(features(texts) @ self.weights + self.bias, -30, 30)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> Evidence:
    """Logistic regression by Newton's method."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return Evidence(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(FEATURES))
    a = np.column_stack([np.ones(len(y)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * len(y) * np.eye(len(w)) / 10
    penalty[0, 0] = 0
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        move = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w)), a.T @ (y - p) - penalty @ w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return Evidence(float(w[0]), w[1:])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Evidence:
    """Fit on at most ``sample`` labelled rows, smallest hash of doc_id first. Only features reach the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).na.drop().groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(list(features(texts.tolist())))

    in_small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(chosen), "doc_id").select(of("text").alias("x"), "y").limit(sample).toPandas()
    return fit(np.array(got["x"].tolist()).reshape(-1, FEATURES), got["y"].to_numpy(dtype=np.float64))


NAMES = ("__logit", "__host", "__path", "__host_rate", "__path_rate", "__posterior")


def added(docs: DataFrame) -> dict[str, str]:
    """The names that ``judged`` gives its columns on these documents, by their names in NAMES without underscores."""
    return {n.strip("_"): own for n, own in zip(NAMES, free_names(docs.columns, *NAMES), strict=True)}


def with_evidence(docs: DataFrame, evidence: Evidence, host: Column, path: Column) -> DataFrame:
    """Adds __logit, __host and __path (or as ``added`` names them)."""

    in_small_batches(docs.sparkSession)
    to = added(docs)

    @F.pandas_udf("double")
    def logit(texts: pd.Series) -> pd.Series:
        return pd.Series(evidence.logit(texts.tolist()))

    return docs.withColumns({to["logit"]: logit(F.col("text").cast("string")), to["host"]: F.coalesce(host.cast("string"), F.lit("\x00")), to["path"]: F.coalesce(path.cast("string"), F.lit("\x00"))})


@dataclass
class Spread:
    """The global mean and the variances of rates: between hosts, between a host's paths, and of a single label."""

    mean: float
    hosts: float
    paths: float
    label: float

    def rates(self, n: Column, p: Column, host_n: Column, host_p: Column, squares: Column) -> tuple[Column, Column]:
        """Posterior rates of a host and its path. squares: the sum of squared sizes of the host's paths."""
        own = F.lit(self.paths) * F.try_divide(squares, host_n * host_n) + F.try_divide(F.lit(self.label), host_n)
        host = F.lit(self.mean) + F.coalesce(F.lit(self.hosts) / (F.lit(self.hosts) + own) * (F.try_divide(host_p, host_n) - F.lit(self.mean)), F.lit(0.0))
        own = F.try_divide(F.lit(self.label), n)
        path = host + F.coalesce(F.lit(self.paths) / (F.lit(self.paths) + own) * (F.try_divide(p, n) - host), F.lit(0.0))
        return tuple(F.least(F.greatest(r, F.lit(1e-6)), F.lit(1 - 1e-6)) for r in (host, path))


def site_sums(scored: DataFrame) -> DataFrame:
    """Per __host and __path: n, p and pp (documents, sum of probabilities, of their squares), and the host's n, p, squares."""
    p = 1 / (1 + F.exp(-F.col("__logit")))
    paths = stored(scored.groupBy("__host", "__path").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("p"), F.sum(p * p).alias("pp")), "paths")
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("host_n"), F.sum("p").alias("host_p"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return stored(paths.join(hosts, "__host"), "sites")


def spread(sites: DataFrame) -> Spread:
    """Moments of a nested one-way layout of unequal sizes."""
    n, p, mean = F.col("n"), F.col("p"), F.col("p") / F.col("n")
    t = sites.agg(F.sum(n).alias("n"), F.sum(p).alias("p"), F.count("*").alias("paths"), F.sum("pp").alias("pp"), F.sum(p * mean).alias("by_path"), F.sum(n * mean * (1 - mean)).alias("label"), F.sum(n * n).alias("nn"), F.sum(n * n / F.col("host_n")).alias("nn_host")).first()
    h = sites.groupBy("__host").agg(F.first("host_n").alias("n"), F.first("host_p").alias("p")).agg(F.count("*").alias("hosts"), F.sum(F.col("p") * F.col("p") / F.col("n")).alias("by_host"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not t["n"]:
        return Spread(0.5, 0.0, 0.0, 0.25)
    total, whole = t["n"], t["p"] * t["p"] / t["n"]
    mean = min(1 - 1e-6, max(1e-6, t["p"] / total))
    within = max(0.0, t["pp"] - t["by_path"]) / max(1.0, total - t["paths"])
    free = total - t["nn_host"]
    paths = max(0.0, (t["by_path"] - h["by_host"] - (t["paths"] - h["hosts"]) * within) / free) if free > 1e-9 * total else 0.0
    free = total - h["nn"] / total
    hosts = max(0.0, (h["by_host"] - whole - (h["hosts"] - 1) * within - paths * (t["nn_host"] - t["nn"] / total)) / free) if free > 1e-9 * total else 0.0
    return Spread(mean, float(hosts), float(paths), max(1e-6, t["label"] / total))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """Posterior rate of each __host, __path (columns host_rate, path_rate), and the global mean."""
    sites = site_sums(scored)
    found = spread(sites)
    host, path = found.rates(*map(F.col, ("n", "p", "host_n", "host_p", "squares")))
    return sites.select("__host", "__path", host.alias("host_rate"), path.alias("path_rate")), found.mean


def judged(docs: DataFrame, evidence: Evidence, host: Column, path: Column, texts: bool = True) -> DataFrame:
    """docs with __logit, __host, __path, __host_rate, __path_rate (both without the document itself) and __posterior.

    texts: whether the texts are wanted. Without them the evidence is computed once and written; with them it is
    computed again rather than writing all texts.
    """
    to = added(docs)
    scored = with_evidence(docs, evidence, host, path)
    if not texts:
        scored = stored(scored.drop("text"), "evidence")
    sites = site_sums(scored.select(F.col(to["logit"]).alias("__logit"), F.col(to["host"]).alias("__host"), F.col(to["path"]).alias("__path")))
    found = spread(sites)
    inner = free_names([*scored.columns, *to.values()], "__site")[0]
    sites = sites.select(F.col("__host").alias(to["host"]), F.col("__path").alias(to["path"]), F.struct("n", "p", "host_n", "host_p", "squares").alias(inner))
    if sites.count() <= SMALL:
        sites = F.broadcast(sites)
    site, own = {k: F.col(inner)[k] for k in ("n", "p", "host_n", "host_p", "squares")}, 1 / (1 + F.exp(-F.col(to["logit"])))
    others = site["n"] - 1, site["p"] - own, site["host_n"] - 1, site["host_p"] - own, site["squares"] - 2 * site["n"] + 1
    rates = dict(zip(("host_rate", "path_rate"), found.rates(*others), strict=True))
    odds = F.log(F.col(to["path_rate"]) / (1 - F.col(to["path_rate"]))) - float(np.log(found.mean / (1 - found.mean)))
    joined = scored.join(sites, [to["host"], to["path"]], "left").withColumns({to[k]: v for k, v in rates.items()}).drop(inner)
    return joined.withColumn(to["posterior"], 1 / (1 + F.exp(-F.least(F.greatest(F.col(to["logit"]) + odds, F.lit(-40.0)), F.lit(40.0)))))

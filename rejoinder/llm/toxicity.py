"""A toxicity classifier with counterfactual regularisation.

A logistic model over the words of a text, with an L1 penalty on words, fitted on labelled documents. For each labelled
sentence that names a group, its counterfactuals swap the term for the others of its list or leave it out; a labelled
document that names none gets a neutral mention of one group put into one of its sentences (chosen by the text's checksum), and that
mention is swapped through its list too. The changed texts act twice: they are copies with their text's label, which
share ``COPIES`` of its weight, so that terms are weighed like words; and the fit penalises the squared change of the
score that each makes in its text, so that a mere mention of a group says nothing about toxicity, however labels lie.

Fitting takes a bounded sample: ``SAMPLE`` labelled rows, smallest hash of doc_id first, and all words that several of
these rows hold. Words and swaps are found on the executors; the driver gets numbers of words. The fit goes on until no
weight's condition for a minimum is missed by more than ``TOLERANCE``, and warns if it can't. Scoring covers whole texts.

Defined cases: a null or empty text has the score of no words; a very long text counts each word once like any other;
rows with the same doc_id are scored each for itself, the sample takes one of them (smallest hash of the text), and
labels of an id that repeats count once, the largest; a null doc_id is never labelled and never held out; without
both labels in the sample all scores are the share of label 1 (0 without any); an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
import warnings
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.shared import in_small_batches, stored

SAMPLE = 8_000
#: Share of a text's weight that its copies have; L1 of words; how far conditions of the minimum may be missed; most steps.
COPIES, L1, TOLERANCE, STEPS = 0.5, 0.0015, 1e-7, 1_000
#: Words that a step takes in at most, and texts whose words are laid out at once.
ENTER, BLOCK = 200, 500
#: Square penalty of terms, which have no L1: small, but keeps their weights finite where all of a term's texts have one label.
RIDGE = 0.001
FOLDS = 5
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Terms that name groups of people, by list; a term's counterfactuals are the others of its list (fixed values).
IDENTITIES = [
    ["women", "men"], ["woman", "man"], ["girl", "boy"], ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["muslim", "jewish", "christian", "hindu", "buddhist", "atheist"], ["muslims", "jews", "christians", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "hispanic", "latino"], ["african", "american", "european", "mexican", "chinese", "indian"],
    ["immigrant", "refugee", "native"], ["immigrants", "refugees", "natives"], ["blind", "deaf", "disabled"], ["old", "young", "elderly"],
    ["frauen", "männer"], ["muslime", "juden", "christen"], ["femmes", "hommes"], ["musulmans", "juifs", "chrétiens"], ["mujeres", "hombres"], ["musulmanes", "judíos", "cristianos"],
]


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    swaps: int = 0  # counterfactuals that the fit penalised
    gap: float = 0.0  # by how much a condition of the minimum is missed at most

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        get = self.weights.get
        z = np.array([self.bias + math.fsum(map(get, words(t) & self.weights.keys())) for t in texts], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: A change of a text's words: the word that goes and the one that comes (or none).
Change = tuple[str | None, str | None]


def counterfactuals(text: str | None, identities: list[list[str]] = IDENTITIES) -> tuple[str | None, list[Change]]:
    """The mention that is put into a text (if it names no group) and the distinct changes by swaps or loss of its terms."""
    others = {t: [o for o in group if o != t] for group in identities for t in group}
    everywhere = [words(s) for s in SENTENCE.split(text or "")]
    found: dict[Change, None] = {}
    for own in everywhere:
        for term in sorted(own & others.keys()):
            stays = sum(term in s for s in everywhere) > 1
            for other in (None, *others[term]):
                change = None if stays else term, None if other is None or any(other in s for s in everywhere) else other
                if any(change):
                    found[change] = None
    if not found and identities and any(everywhere) and not any(own & others.keys() for own in everywhere):
        pick = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
        group = identities[pick % len(identities)]
        term = group[pick // len(identities) % len(group)]
        return term, [(term, other) for other in others[term]]
    return None, list(found)


def fit(texts: list[str], labels: np.ndarray, identities: list[list[str]] = IDENTITIES, least: int = 4, **options) -> Model:
    """fit_sets on texts. Words of fewer than ``least`` texts aren't features; group terms always are."""
    sets = [words(t) for t in texts]
    counts = Counter(w for s in sets for w in s)
    terms = {t for group in identities for t in group}
    vocabulary = {w: i for i, w in enumerate(sorted({w for w, n in counts.items() if n >= least} | terms))}
    found = [counterfactuals(t, identities) for t in texts]
    number = lambda w: vocabulary.get(w, -1)
    return fit_sets([[vocabulary[w] for w in s if w in vocabulary] for s in sets], labels, vocabulary, [number(p) for p, _ in found], [[(number(a), number(b)) for a, b in c] for _, c in found], terms, **options)


class Objective:
    """Loss of texts and copies, the penalty of swaps, the ridge of terms; their gradient and curvature.

    puts: each text's mention (-1: none); changes: each text's (gone, come), with -1 for none, from the text with its
    mention. A text that has copies (itself with the mention, and each change) gives them COPIES of its weight. Margins
    are z of texts, a of texts with their mentions and c of changes; a word that is none has the number d and weight 0.
    """

    def __init__(self, sets, y: np.ndarray, d: int, puts, changes, ridged: np.ndarray, swap: float):
        n = len(y)
        self.y, self.n, self.d, self.ridge = y, n, d, np.append(RIDGE * ridged, 0.0)
        per_row = np.array([len(s) for s in sets], dtype=np.int64)
        self.rows, self.columns = np.repeat(np.arange(n), per_row), np.concatenate([np.asarray(s, dtype=np.int64) for s in sets])
        sizes = np.array([len(c) for c in changes], dtype=np.int64)
        self.owner = np.repeat(np.arange(n), sizes)
        flat = np.array([x for c in changes for x in c], dtype=np.int64).reshape(-1, 2)
        self.gone, self.come = (np.where(flat[:, k] < 0, d, flat[:, k]) for k in (0, 1))
        self.put = np.where(np.asarray(puts) < 0, d, puts).astype(np.int64)
        has_put = (self.put < d).astype(np.float64)
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))  # classes weigh alike
        copies = sizes + has_put
        each = weight / np.maximum(copies, 1)
        self.own_weight = weight * np.where(copies > 0, 1 - COPIES, 1.0)
        self.put_weight, self.change_weight = COPIES * each * has_put, COPIES * each[self.owner]
        self.put_swap, self.change_swap = swap * each * has_put, swap * each[self.owner]
        self.n_swaps = int(copies.sum())

    def margins(self, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = np.append(w, 0.0)
        z = np.bincount(self.rows, weights=known[self.columns], minlength=self.n) + b
        a = z + known[self.put]
        return z, a, a[self.owner] + known[self.come] - known[self.gone]

    def value(self, w: np.ndarray, b: float) -> float:
        margins = self.margins(w, b)
        losses = ((self.own_weight, self.y), (self.put_weight, self.y), (self.change_weight, self.y[self.owner]))
        out = sum(float((weight * (np.logaddexp(0, v) - label * v)).sum()) for v, (weight, label) in zip(margins, losses, strict=True))
        sz, sa, sc = map(sigmoid, margins)
        out += float((self.change_swap * (sc - sa[self.owner]) ** 2).sum() + (self.put_swap * (sa - sz) ** 2).sum())
        return out + 0.5 * float((self.ridge[:-1] * w * w).sum())

    def gradient(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        sz, sa, sc = map(sigmoid, self.margins(w, b))
        to_change, to_put, yc, n = sc - sa[self.owner], sa - sz, self.y[self.owner], self.d + 1
        dc = self.change_weight * (sc - yc) + 2 * self.change_swap * to_change * sc * (1 - sc)
        da = self.put_weight * (sa - self.y) + 2 * self.put_swap * to_put * sa * (1 - sa)
        da += np.bincount(self.owner, weights=dc - 2 * self.change_swap * to_change * (sa * (1 - sa))[self.owner], minlength=self.n)
        dz = self.own_weight * (sz - self.y) - 2 * self.put_swap * to_put * sz * (1 - sz) + da
        g = np.bincount(self.columns, weights=dz[self.rows], minlength=n) + np.bincount(self.put, weights=da, minlength=n)
        g += np.bincount(self.come, weights=dc, minlength=n) - np.bincount(self.gone, weights=dc, minlength=n)
        return g[: self.d] + self.ridge[:-1] * w, float(dz.sum())

    def curvature(self, w: np.ndarray, b: float, active: np.ndarray) -> np.ndarray:
        """Of the active words, then the bias: the losses' second derivatives and the penalty's, of its linearised changes.

        Each margin's direction is its text's words u and a few terms s; sums of h (k u + s)(k u + s)' are gathered as
        those of u u', u s' and s s'. Texts' words are laid out for a block of texts at a time.
        """
        sz, sa, sc = map(sigmoid, self.margins(w, b))
        hz, ha, hc = sz * (1 - sz), sa * (1 - sa), sc * (1 - sc)
        size, at = len(active) + 1, np.full(self.d + 1, -1, dtype=np.int64)
        at[active] = np.arange(len(active))
        own = np.zeros(self.n)  # of u u'
        mixed = np.zeros((self.n, size)) if len(self.owner) or (self.put < self.d).any() else None  # of u s', by text
        out = np.zeros((size, size))
        o, p = self.owner, self.put

        def add(text, h, k, *terms):
            """h (k u + sum of factor * term)**2 for each of the given."""
            nonlocal own
            own = own + np.bincount(text, weights=h * k * k, minlength=self.n)
            listed = [(at[t], x) for t, x in terms]
            for i, x in listed:
                ok = i >= 0
                np.add.at(mixed, (text[ok], i[ok]), (h * k * x)[ok])
                for j, v in listed:
                    both = ok & (j >= 0)
                    np.add.at(out, (i[both], j[both]), (h * x * v)[both])

        every = np.arange(self.n)
        own += self.own_weight * hz
        one, ones = np.ones(self.n), np.ones(len(o))
        if mixed is not None:
            add(every, self.put_weight * ha, one, (p, one))
            add(every, 2 * self.put_swap, ha - hz, (p, ha))
            add(o, self.change_weight * hc, ones, (p[o], ones), (self.come, ones), (self.gone, -ones))
            add(o, 2 * self.change_swap, hc - ha[o], (p[o], hc - ha[o]), (self.come, hc), (self.gone, -hc))
        keep = at[self.columns] >= 0
        rows, columns = self.rows[keep], at[self.columns[keep]]
        cuts = np.searchsorted(rows, np.arange(0, self.n + BLOCK, BLOCK))
        for k, first in enumerate(range(0, self.n, BLOCK)):
            last = min(self.n, first + BLOCK)
            u = np.zeros((last - first, size))
            u[:, -1] = 1
            u[rows[cuts[k] : cuts[k + 1]] - first, columns[cuts[k] : cuts[k + 1]]] = 1
            out += (u * own[first:last, None]).T @ u
            if mixed is not None:
                cross = u.T @ mixed[first:last]
                out += cross + cross.T
        out[np.arange(size), np.arange(size)] += np.append(self.ridge[active], 0.0) + 1e-9
        return out


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def missed(w: np.ndarray, g: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """By how much each weight's condition of the minimum is missed."""
    return np.where(w != 0, np.abs(g + l1 * np.sign(w)), np.maximum(np.abs(g) - l1, 0))


def _quadratic(h: np.ndarray, g: np.ndarray, x: np.ndarray, l1: np.ndarray, tolerance: float) -> np.ndarray:
    """The minimum over new x of g (new - x) + (new - x)' h (new - x) / 2 + l1 |new|, by coordinates."""
    new, slope, diagonal = x.copy(), g.copy(), np.diag(h).tolist()
    bounds = l1.tolist()
    for turn in range(500):
        largest = 0.0
        for i in range(len(x)) if turn % 10 == 0 else np.flatnonzero((new != 0) | (l1 == 0)).tolist():
            old, c = float(new[i]), diagonal[i]
            wanted = c * old - float(slope[i])
            to = math.copysign(max(abs(wanted) - bounds[i], 0.0), wanted) / c
            if to != old:
                slope += (to - old) * h[:, i]
                new[i] = to
                largest = max(largest, abs(to - old) * c)
        if turn % 10 == 0 and largest <= tolerance:
            break
    return new


def fit_sets(sets: list[Iterable[int]], labels: np.ndarray, vocabulary: dict[str, int], puts: list[int], changes: list[list[tuple[int, int]]], terms: set[str], l1: float = L1, swap: float = 2.0, tolerance: float = TOLERANCE, steps: int = STEPS) -> Model:
    """Minimise mean log loss + swap * mean squared change of score by counterfactuals + l1 * |weights of words|.

    sets: numbers of each text's words. Newton steps on the words that have weight and those that miss their condition
    most (ENTER of them at a step), each step shortened until it goes down, until all conditions are met.
    """
    y = np.asarray(labels, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    names = sorted(vocabulary, key=vocabulary.get)
    ridged = np.array([t in terms for t in names])
    f, penalty = Objective(sets, y, len(names), puts, changes, ridged, swap), np.where(ridged, 0.0, l1)
    w, b, now = np.zeros(len(names)), 0.0, math.inf
    for _ in range(steps):
        g, gb = f.gradient(w, b)
        off = missed(w, g, penalty)
        gap = max(float(off.max(initial=0.0)), abs(gb))
        if gap <= tolerance:
            break
        entering = np.argsort(-off, kind="stable")[:ENTER]
        active = np.union1d(np.flatnonzero((w != 0) | ridged), entering[off[entering] > tolerance])
        x, slope, bounds = np.append(w[active], b), np.append(g[active], gb), np.append(penalty[active], 0.0)
        to = _quadratic(f.curvature(w, b, active), slope, x, bounds, min(0.1 * gap, 1e-4))
        now = f.value(w, b) + float((penalty * np.abs(w)).sum())
        expected = float(slope @ (to - x)) + float((bounds * (np.abs(to) - np.abs(x))).sum())
        part = 1.0
        while part > 1e-10:
            trial, bias = w.copy(), x[-1] + part * (to[-1] - x[-1])
            trial[active] = x[:-1] + part * (to[:-1] - x[:-1])
            if f.value(trial, bias) + float((penalty * np.abs(trial)).sum()) <= now + 0.01 * part * expected + 1e-15:
                break
            part /= 2
        else:
            break  # no step goes down any more: what is missed is beyond the numbers' precision
        w, b = trial, bias
    g, gb = f.gradient(w, b)
    gap = max(float(missed(w, g, penalty).max(initial=0.0)), abs(gb))
    if gap > tolerance:
        warnings.warn(f"the fit's conditions are missed by up to {gap:.2g}", stacklevel=2)
    return Model(float(b), {names[i]: float(w[i]) for i in np.flatnonzero(w).tolist()}, f.n_swaps if swap else 0, gap)


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, identities: list[list[str]] = IDENTITIES, least: int = 4, **options) -> Model:
    """Fit on labelled rows outside fold 0, at most ``sample`` of them."""
    in_small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).na.drop().groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.filter(fold() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("struct<words:array<string>,put:string,swaps:array<struct<gone:string,come:string>>>")
    def found(texts: pd.Series) -> pd.DataFrame:
        both = [counterfactuals(t, identities) for t in texts]
        return pd.DataFrame({"words": [sorted(words(t)) for t in texts], "put": [p for p, _ in both], "swaps": [[{"gone": a, "come": b} for a, b in c] for _, c in both]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    # one row of those that share a doc_id, by the hash of its text
    first = joined.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("hash"))
    own = stored(joined.select("doc_id", "y", F.xxhash64("text").alias("hash"), found("text").alias("f")), "labelled")
    own = own.join(F.broadcast(first), ["doc_id", "hash"]).dropDuplicates(["doc_id"]).select("doc_id", "y", "f.*")
    own = stored(own, "labelledwords", wave=True)
    counts = own.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    terms = {t for group in identities for t in group}
    vocabulary = {w: i for i, w in enumerate(sorted({r["w"] for r in counts.collect()} | terms))}  # at most the sample's words / ``least``

    @F.pandas_udf("array<int>")
    def numbers(sets: pd.Series) -> pd.Series:
        get = vocabulary.get
        return pd.Series([[i for i in map(get, s) if i is not None] for s in sets])

    got = own.select("doc_id", "y", "put", "swaps", numbers("words").alias("w")).toPandas().sort_values("doc_id", kind="stable")
    number = lambda w: vocabulary.get(w, -1)
    changes = [[(number(c["gone"]), number(c["come"])) for c in own_] for own_ in got["swaps"]]
    return fit_sets(got["w"].tolist(), got["y"].to_numpy(), vocabulary, [number(p) for p in got["put"]], changes, terms, **options)


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, from its text alone, and n_swaps and fit_gap of the fit."""
    in_small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = own.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), score("text").alias("score"))
    return scored.withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "n_swaps": F.lit(model.swaps).cast("long"), "fit_gap": F.lit(model.gap)})

"""Periodic runs of words: maximal stretches that repeat one period, found by the linear tandem-repeat method.

Words become numbers. Stretches that can't lie in a run are left out first: a run of length max(least, power * period)
holds each of its grams several times, so words that no frequent enough gram of their own stretch covers go, again and
again until nothing changes; this drops no run. What stays is one string with a separator of its own after every stretch.

1. Lempel-Ziv blocks of the string; for each block and period two longest common extensions (forward and backward) at
   its borders give squares that cover the leftmost occurrence of every square.
2. These squares' ends are marked in the suffix tree (intervals of the suffix array with parents and suffix links).
3. From each mark a walk takes the suffix link and appends the letter it lost, which turns the square by one place, for
   as long as the turned square occurs and isn't marked: then all squares of the string are marked.
4. Leaves below the marks are all occurrences; those of one period at consecutive places merge into one run.

Squares whose half is itself a power are left out (a shorter period stands for them), which bounds occurrences by
n log n. A text is one task's work, in memory of about 0.8 KB for each word that stays after the first step.

Defined cases: a null or empty text has no words and no runs; a very long text is one string like any other; rows that
share a doc_id, and null doc_ids, are judged each for itself; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.shared import in_small_batches, mixed, text_slices, trimmed

LEAST, POWER = 6, 4
GRAM = 3
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


# -- which stretches can hold a run


def gram_count(least: int, power: int, gram: int = GRAM) -> int:
    """How often each gram of a run occurs in it at least, whatever the period."""
    return min((max(least, power * q) - gram + 1) // q for q in range(1, max(gram, least) + 1))


def repeated_stretches(words: np.ndarray, text: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that may lie in runs, and the number of the stretch of each. text: which text a word is of."""
    at, own, need = np.arange(len(words)), text, gram_count(least, power)
    while len(at):
        if need >= 2:
            w = words[at].astype(np.uint64)
            good = np.zeros(len(at), dtype=bool)
            if len(at) >= GRAM:
                whole = own[GRAM - 1 :] == own[: 1 - GRAM]
                key = mixed(mixed(mixed(w[:-2] ^ mixed(own[:-2].astype(np.uint64) + np.uint64(1))) ^ w[1:-1]) ^ w[2:])
                key, places = key[whole], np.flatnonzero(whole)
                order = np.argsort(key, kind="stable")
                change = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]])) if len(key) else np.zeros(1, np.int64)
                often = np.repeat(np.diff(change) >= need, np.diff(change))
                good[places[order[often]]] = True
            begins = np.concatenate([[False], good])  # of a word: does a good gram begin before it
            covered = good | begins[:-1] | np.concatenate([[False, False], good])[: len(good)]
            tied = good | begins[:-1]  # to the next word, by a gram that begins here or one before
        else:
            covered, tied = np.ones(len(at), dtype=bool), np.ones(len(at), dtype=bool)
        breaks = np.concatenate([[True], ~tied[:-1] | (own[1:] != own[:-1]) | ~covered[:-1]])
        stretch = np.cumsum(breaks) - 1
        sizes = np.bincount(stretch, weights=covered).astype(np.int64)
        keep = covered & (sizes[stretch] >= least)
        if keep.all() and (len(sizes) == len(np.unique(own))):
            return at, stretch
        at, own = at[keep], stretch[keep]
    return at, own


# -- the string's tables


def substring_ranks(s: np.ndarray) -> np.ndarray:
    """ranks[j, i]: the rank of s[i : i + 2**j] among all of them, for j up to where all differ."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while rank.max(initial=0) + 1 < n:
        after = np.zeros(n, dtype=np.int64)
        if width < n:
            after[:-width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        width *= 2
    return np.array(levels)


def common(ranks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of suffixes i and j (i != j; one beyond the end has none)."""
    n = ranks.shape[1]
    i, j, got = i.astype(np.int64), j.astype(np.int64), np.zeros(len(i), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        a, b = i + got, j + got
        inside = np.maximum(a, b) < n
        same = inside & (ranks[level][np.where(inside, a, 0)] == ranks[level][np.where(inside, b, 0)])
        got += same.astype(np.int64) << level
    return got


def lempel_ziv(suffixes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Begins of the blocks: each is the longest prefix of the rest that also begins further left, or one letter."""
    n = len(suffixes)
    before, after, stack = [-1] * n, [-1] * n, []
    for p in suffixes.tolist():  # of each suffix, its neighbours in order that begin further left
        while stack and stack[-1] > p:
            after[stack.pop()] = p
        if stack:
            before[p] = stack[-1]
        stack.append(p)
    longest = np.zeros(n, dtype=np.int64)
    for other in (np.array(before), np.array(after)):
        there = np.flatnonzero(other >= 0)
        longest[there] = np.maximum(longest[there], common(ranks, there, other[there]))
    starts, at, step = [], 0, np.maximum(longest, 1).tolist()
    while at < n:
        starts.append(at)
        at += step[at]
    return np.array(starts)


def covering_squares(s: np.ndarray, blocks: np.ndarray, ahead: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of squares such that every square's leftmost occurrence lies in the run of one, not before it."""
    n, starts, periods = len(s), [], []
    ends = np.append(blocks[1:], n)
    after = np.append(ends[1:], n)  # the end of the next block

    def spread(first, count):
        owner = np.repeat(np.arange(len(count)), count)
        return owner, np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1

    # the centre in the block, the end beyond it
    owner, k = spread(blocks, np.where(ends < n, ends - blocks, 0))
    h1 = ends[owner]
    q = h1 - k
    hit = np.flatnonzero(s[h1] == s[q]) if len(k) else np.zeros(0, np.int64)
    h1, q, k = h1[hit], q[hit], k[hit]
    forth, aft = common(ahead, h1, q), _before(back, h1, q)
    start, ok = np.maximum(q - aft, q - k + 1), forth + aft >= k
    starts.append(start[ok])
    periods.append(k[ok])
    # the begin before the block, the centre in it
    owner, k = spread(blocks, np.where(blocks > 0, after - blocks, 0))
    h, h1 = blocks[owner], ends[owner]
    q = h + k
    hit = np.flatnonzero(q < n)
    hit = hit[(s[h[hit]] == s[q[hit]]) & (s[h[hit] - 1] == s[q[hit] - 1])]
    h, h1, q, k = h[hit], h1[hit], q[hit], k[hit]
    forth, aft = common(ahead, h, q), _before(back, h, q)
    start = np.maximum(h - aft, h - k + 1)
    ok = (forth + aft >= k) & (start + k <= h1)
    starts.append(start[ok])
    periods.append(k[ok])
    return np.concatenate(starts), np.concatenate(periods)


def _before(back: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common suffixes of what stands before i and before j (from ranks of the string backwards)."""
    n, out = back.shape[1], np.zeros(len(i), dtype=np.int64)
    there = np.flatnonzero((i > 0) & (j > 0))
    out[there] = common(back, n - i[there], n - j[there])
    return out


def primitive(starts: np.ndarray, periods: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Which squares' halves aren't powers: no prime part of the period is a period too."""
    ok, rest = np.ones(len(starts), dtype=bool), periods.copy()
    least = np.arange(int(periods.max(initial=1)) + 1)
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            of = least[p * p :: p]
            of[of == np.arange(p * p, len(least), p)] = p
    while (todo := np.flatnonzero(rest > 1)).size:
        prime = least[rest[todo]]
        part = periods[todo] // prime
        ok[todo] &= common(ahead, starts[todo], starts[todo] + part) < 2 * periods[todo] - part
        rest[todo] //= prime
    return ok


class SuffixTree:
    """Nodes as intervals of the suffix array: leaves 0..n-1 in order, then inner nodes, the root last."""

    def __init__(self, s: np.ndarray, suffixes: np.ndarray, ranks: np.ndarray):
        n = len(s)
        self.s, self.suffixes, self.place = s, suffixes, ranks[-1]
        shared = np.append(common(ranks, suffixes[:-1], suffixes[1:]), -1).tolist()
        parent, lo, hi, depth = [0] * n, list(range(n)), list(range(n)), (n - suffixes).tolist()
        stack, held = [(0, 0, [])], None  # open nodes: depth, first leaf, children
        for j, d in enumerate(shared):
            node, first = j, j
            while stack and stack[-1][0] > d:
                top, first_, below = stack.pop()
                below.append(node)
                node, first = len(parent), first_
                for x in below:
                    parent[x] = node
                parent.append(0)
                lo.append(first_)
                hi.append(j)
                depth.append(top)
            if not stack:
                held = node  # the root
            elif stack[-1][0] < d:
                stack.append((d, first, [node]))
            else:
                stack[-1][2].append(node)
        self.root = held
        parent[held] = held
        self.parent, self.lo, self.hi, self.depth = (np.array(x, dtype=np.int64) for x in (parent, lo, hi, depth))
        self.link = self._links(n, ranks)

    def _links(self, n: int, ranks: np.ndarray) -> np.ndarray:
        """Suffix links of inner nodes: the node of a string without its first letter, found by the string's ranks."""
        inner = np.arange(n, len(self.parent))
        link = np.full(len(self.parent), self.root, dtype=np.int64)
        d, i = self.depth[inner], self.suffixes[self.lo[inner]]

        def names(i, d):
            level = np.frexp(np.maximum(d, 1).astype(np.float64))[1] - 1
            return ranks[level, i] * n + ranks[level, np.minimum(i + d - (1 << level), n - 1)]

        deep = d > 1
        have = d > 0
        both = np.concatenate([names(i[have], d[have]), names(i[deep] + 1, d[deep] - 1)])
        named = np.unique(both, return_inverse=True)[1] * (int(d.max(initial=0)) + 1) + np.concatenate([d[have], d[deep] - 1])
        own, wanted = named[: int(have.sum())], named[int(have.sum()) :]
        order = np.argsort(own)
        found = order[np.minimum(np.searchsorted(own[order], wanted), len(order) - 1)] if len(order) else wanted
        link[inner[deep]] = inner[have][found]
        return link

    def loci(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The highest nodes whose strings begin with s[start : start + length]."""
        ups, node = [self.parent], self.place[starts]
        while (ups[-1] != self.root).any():
            ups.append(ups[-1][ups[-1]])
        for up in reversed(ups):
            higher = up[node]
            node = np.where(self.depth[higher] >= lengths, higher, node)
        return node

    def walk(self, nodes: np.ndarray, lengths: np.ndarray) -> dict[tuple[int, int], None]:
        """All marks (node, length) that suffix-link walks reach from these."""
        s, depth, parent, link, root = self.s.tolist(), self.depth.tolist(), self.parent.tolist(), self.link.tolist(), self.root
        first = self.suffixes[self.lo].tolist()
        below = np.flatnonzero(np.arange(len(depth)) != root)
        letters = self.s[self.suffixes[self.lo[below]] + self.depth[self.parent[below]]]
        child = dict(zip(zip(self.parent[below].tolist(), letters.tolist(), strict=True), below.tolist(), strict=True))
        marks = dict.fromkeys(zip(nodes.tolist(), lengths.tolist(), strict=True))
        for v, size in list(marks):
            while True:
                at = first[v]
                lost, u, c = s[at], link[parent[v]] if parent[v] != root else root, -1
                while depth[u] < size - 1:
                    c = child[u, s[at + 1 + depth[u]]]
                    if depth[c] > size - 1:
                        break
                    u = c
                if depth[u] == size - 1:
                    v = child.get((u, lost), -1)
                else:
                    v = c if s[first[c] + size - 1] == lost else -1
                if v < 0 or (v, size) in marks:
                    break
                marks[v, size] = None
        return marks


def string_runs(s: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """Rows (start, length, period) of a string's runs, in order of start and period. The last letter occurs once."""
    if len(s) < 2:
        return np.zeros((0, 3), dtype=np.int64)
    ahead = substring_ranks(s)
    suffixes = np.empty(len(s), dtype=np.int64)
    suffixes[ahead[-1]] = np.arange(len(s))
    starts, periods = covering_squares(s, lempel_ziv(suffixes, ahead), ahead, substring_ranks(s[::-1]))
    if len(starts):
        own = primitive(starts, periods, ahead)
        starts, periods = starts[own], periods[own]
    if not len(starts):
        return np.zeros((0, 3), dtype=np.int64)
    tree = SuffixTree(s, suffixes, ahead)
    marks = np.array(list(tree.walk(tree.loci(starts, 2 * periods), 2 * periods)), dtype=np.int64)
    lo, n = tree.lo[marks[:, 0]], tree.hi[marks[:, 0]] - tree.lo[marks[:, 0]] + 1
    place = suffixes[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    period = np.repeat(marks[:, 1] // 2, n)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])]))
    last = np.append(first[1:], len(place)) - 1
    runs = np.column_stack([place[first], place[last] - place[first] + 2 * period[first], period[first]])
    runs = runs[runs[:, 1] >= np.maximum(least, power * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[list], least: int = LEAST, power: int = POWER) -> list[np.ndarray]:
    """Each text's runs; a text is a list of words (anything hashable)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    words = np.fromiter((hash(w) for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    at, stretch = repeated_stretches(words, text, least, power)
    none = np.zeros((0, 3), dtype=np.int64)
    if not len(at):
        return [none] * len(texts)
    begins = np.cumsum(sizes) - sizes
    number: dict = {}
    s = np.array([number.setdefault(texts[t][i], len(number)) for t, i in zip(text[at].tolist(), (at - begins[text[at]]).tolist(), strict=True)], dtype=np.int64)
    ends = np.append(np.flatnonzero(stretch[1:] != stretch[:-1]) + 1, len(s))
    s = np.insert(s, ends, len(number) + np.arange(len(ends)))  # a separator of its own behind each stretch
    places = np.insert(at, ends, -1)
    found = string_runs(s, least, power)
    start = places[found[:, 0]]
    owner = text[start]
    found[:, 0] = start - begins[owner]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))  # stretches are in order of texts
    return [found[cut[t] : cut[t + 1]] for t in range(len(texts))]


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


# -- documents


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """doc_id, n_words, runs in order of start and period, and the text with each run cut to its first period."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                texts = [(t or b"").split() for t in pc.cast(batch.column(1).slice(a, b - a), pa.binary()).to_pylist()]  # at the six white bytes of ASCII
                found = runs_of(texts, least, power)
                flat = np.concatenate(found)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
                rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(pairs))
                short = [b" ".join(collapsed(t, r)) for t, r in zip(texts, found, strict=True)]
                columns = [batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(offsets, rows), pa.array(short, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    in_small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(trimmed(find), RUNS)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts (by a checksum of doc_id) end in a period that their number gives."""
    h = F.crc32(F.col("doc_id").cast("string"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(h % 10 == 0, F.lit(False)).alias("planted"), F.floor(h / 10).cast("long").alias("g"))
    own = own.withColumn("w", F.when(F.col("planted"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    own = own.withColumn("n", F.size("w"))
    own = own.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    own = own.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))
    text: Column = F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", 1, F.col("a")), tail), " ")).otherwise(F.col("text"))
    return own.select("doc_id", text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of periodic_runs: the longest run (ties: smallest start, then period) and checksums of all runs and of the text."""
    longest = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    own = found.withColumn("top", F.get(longest, F.lit(0)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    length, period = -F.col("top.less"), F.col("top.period")
    return own.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("(-1000 * top.less) div top.period").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"), "n_words",
    )

"""N-gram Jaccard self-join of documents, exact, by count-vector R-trees.

A document's set is its distinct word shingles, as 64-bit hashes of the words. Hashed into groups, a set becomes a
point: the counts of its groups. The overlap of two sets is at most the sum of their points' coordinate minima, and
for a box of points at most the sum over the box's upper corner, so an R-tree over the points yields every pair that
can reach the threshold. Surviving pairs are bounded again by points of more groups and verified on the sets.

In so many dimensions one tree over all documents would visit nearly every leaf, so points are first dealt to trees
by key: two sets at or over the threshold share at least one of the first n - ceil(t * n) + 1 shingles of each, in
any one order of all shingles. The order puts frequent shingles last (by a table of counts over all documents of a
fixed size), so common passages rarely give a key. A key's documents form one tree; those of a key with more than
``TREE`` rows are cut into parts, and each two parts form a tree. Two documents that share several keys are left to
the first that both carry, and pairs are bounded by up to CARRIED groups where they come out.

Links between copies are not expanded. Documents with one and the same set are a class with one representative.
For each representative its likeliest partner (that which leads most of its keys) is verified first; the components
of these links are then known, and the trees search only pairs that lie in different components, which is all that
can still change a component. A key whose documents are all in one component needs no tree. Before they search, the
trees of more than one leaf propose for each representative the one nearest to it in another component, in rounds for
as long as a good part of these prove to be links: of many near copies nearly all are then in one component, whichever
leads them, and their pairs don't come out.

Points are what trees cost on disk, so only rows that can meet there get one. Keys, labels and set sizes alone are
grouped first: a pair of a key of up to a leaf is left to the smallest such key at which it meets, in sizes that can
reach the threshold, and the rows of other keys stay as they are.

Defined cases: a null text is empty; without words a document has no set and is linked with nothing; with fewer
words than a shingle takes, the whole sequence is the one shingle; a very long text is one set like any other, whose words are
found in steps; rows with the same doc_id are told apart by row,
and components are named by the smallest doc_id in them (null only if all are null); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.llm.components import components
from rejoinder.llm.shared import in_small_batches, mixed, release, shuffle_partitions, span_hashes, stored, text_slices, trimmed

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Groups of a tree's points and of the points that a key's rows carry at most; a fine point has no such end.
GROUPS, CARRIED = 128, 1024
#: A count in a point's byte that stands for this one or any larger, so it bounds nothing.
FULL = 255
#: Shingles of a set for each group of its fine point, and pairs and documents that may be broadcast to find texts.
FINE, SMALL = 4, 400_000
#: Keys before a row's own that it carries, and rows of a key that one tree holds at most.
BEFORE, TREE = 8, 20_000
#: Pairs of one set that are verified in one task, on average.
TOGETHER = 64
#: Slots of the frequency table and of its parts: 4 MB in all, whatever the input.
SLOTS, SLOT_PART = 1 << 19, 1 << 13
LEAF = 32
#: Proposals of a round for each link that makes another round worth while.
YIELD = 4
#: Pairs for each row of a key that may be listed before the key's rows are taken as they are.
LISTED = 8
#: Bytes of text that are cut to words at once.
STEP = 1 << 19
SKETCH = "row long, doc_id long, n long, sig1 long, sig2 long, keys array<long>, point binary, fine binary"


def _white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes that end with white space, and where they begin.

    Bytes are taken in steps that end at white space, so that a long text costs eight bytes a word and not many a byte.
    """
    hashes, begins, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + STEP)
        while end < len(data) and not _white(data[end - 1 : end])[0]:
            space = np.flatnonzero(_white(data[end : end + STEP]))
            end = end + int(space[0]) + 1 if len(space) else min(len(data), end + STEP)
        low = np.where((data[at:end] >= 65) & (data[at:end] <= 90), data[at:end] + 32, data[at:end])
        white = _white(low)
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        edge = np.concatenate([[0], edge]) if not white[0] else edge
        first, last = edge[0::2], edge[1::2]
        hashes.append(mixed(span_hashes(low, first, last) + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        begins.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(begins)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and each text's offsets.

    Words are runs of bytes other than space and tab to carriage return, with A-Z in lower case.
    """
    joined = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    word, first = _words(joined)
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    doc = np.searchsorted(ends, first, side="right")
    n = np.bincount(doc, minlength=len(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    k = len(word)
    parts = []
    if k >= words:
        h = word[: k - words + 1].copy()
        for j in range(1, words):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + word[j : k - words + 1 + j])
        whole = doc[: k - words + 1] == doc[words - 1 :]
        parts.append((doc[: k - words + 1][whole], h[whole]))
    for i in np.flatnonzero((n > 0) & (n < words)).tolist():
        h = word[at[i] : at[i] + 1].copy()
        for j in range(at[i] + 1, at[i + 1]):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + word[j : j + 1])
        parts.append((np.array([i]), mixed(h + np.uint64(n[i]))))
    doc, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def _sets_of(column: pa.Array, words: int):
    for a, b in text_slices(column):
        texts = [(t or "").encode() for t in column.slice(a, b - a).to_pylist()]
        yield a, *shingle_sets(texts, words)


def _signatures(h: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two sums over each set modulo 2**64, which with its size tell sets apart."""
    out = []
    for values in (h, mixed(h + np.uint64(1))):
        sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(values, out=sums[1:])
        out.append(pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)))
    return out[0], out[1]


def _point(h: np.ndarray, most: int | None = None) -> bytes:
    """Counts of about a quarter as many groups as shingles, a byte each; folding it gives the counts of fewer groups."""
    groups = GROUPS
    while groups * FINE < len(h) and groups != most:
        groups *= 2
    return np.minimum(np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups), FULL).astype(np.uint8).tobytes()


def _counts(point: bytes, groups: int) -> np.ndarray:
    """A point folded to this many groups (a divisor of its own)."""
    own = np.frombuffer(point, dtype=np.uint8).astype(np.int64)
    own[own == FULL] = 1 << 40
    return own.reshape(-1, groups).sum(0)


def _can_reach(x: bytes, y: bytes, sizes: int, numerator: int, denominator: int) -> bool:
    """Whether the summed minima of two points, in as many groups as both have, allow the threshold."""
    d = min(len(x), len(y))
    return (numerator + denominator) * int(np.minimum(_counts(x, d), _counts(y, d)).sum()) >= numerator * sizes


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slot_counts(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """How many documents have a shingle of each slot, over all documents. Its size is fixed: SLOTS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for _, h, _ in _sets_of(batch.column(0), words):
                total += np.bincount((h >> np.uint64(40)).astype(np.int64) % SLOTS, minlength=SLOTS)
        parts = total.reshape(-1, SLOT_PART).astype("<u4" if total.max(initial=0) < 1 << 32 else "<u8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(counts, dtype="<u4" if len(counts) == 4 * SLOT_PART else "<u8").astype(np.int64)
                sums[part] = sums[part] + own if part in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])

    kind = "part long, counts binary"
    summed = docs.select(F.col("text").cast("string")).mapInArrow(trimmed(count), kind).repartition(SLOTS // SLOT_PART, "part").mapInArrow(trimmed(add), kind)
    table = np.zeros(SLOTS, dtype=np.int64)
    for part, counts in summed.collect():  # SLOTS / SLOT_PART rows
        table[part * SLOT_PART : (part + 1) * SLOT_PART] = np.frombuffer(counts, dtype="<i8")
    return table


def sketches(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """Per document: the size and a 128-bit sum of its set, its keys (the first shingles in order) and its point.

    point has at most CARRIED groups; fine is the point of more groups where a set has need of them, else null. The
    table is written.
    """
    in_small_batches(docs.sparkSession)
    table = slot_counts(docs, words)
    mean = max(1.0, float(table.mean()))
    # the excess over what a slot holds by chance; counts within three deviations are alike
    rank = np.where(table <= mean + 3 * np.sqrt(mean), 0, np.ceil(np.log2(np.maximum(1, table / mean)) * 8) + 1).astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(rank.tobytes())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for a, h, at in _sets_of(batch.column(2), words):
                n = np.diff(at)
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, ranks[(h >> np.uint64(40)).astype(np.int64) % SLOTS], doc))
                place = np.arange(len(h)) - np.repeat(at[:-1], n)
                need = -(-n * numerator // denominator)
                first = place < np.repeat(n - need + 1, n)
                keys = h[order][first].view(np.int64)
                sums, more = _signatures(h, at)
                points = [_point(h[at[i] : at[i + 1]], CARRIED) for i in range(len(n))]
                fine = [_point(h[at[i] : at[i + 1]]) if n[i] > FINE * CARRIED else None for i in range(len(n))]
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, n - need + 1, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(n)), batch.column(1).slice(a, len(n)), pa.array(n),
                        sums, more,
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)), pa.array(points, pa.binary()),
                        pa.array(fine, pa.binary()),
                    ],
                    names=[c.split()[0] for c in SKETCH.split(", ")],
                )

    try:
        return stored(_own(docs).mapInArrow(trimmed(sketch), SKETCH), "sketches")
    finally:
        shared.destroy()


class CountVectorTree:
    """A packed R-tree over points of group counts; box bounds need only the boxes' upper corners.

    Points are sorted by set size, then by their first coordinates, and every LEAF of them share a box.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        starts = np.arange(0, len(sizes), LEAF)
        self.high = np.maximum.reduceat(self.points, starts, axis=0)
        self.small = np.minimum.reduceat(self.sizes, starts)
        self.large = np.maximum.reduceat(self.sizes, starts)

    def search(self, point: np.ndarray, size: int, numerator: int, denominator: int) -> np.ndarray:
        """Indices of all points whose overlap bound with this one can reach the threshold."""
        return self.bounds(point, size, numerator, denominator)[0]

    def bounds(self, point: np.ndarray, size: int, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
        """What ``search`` finds, and the overlap bound of each."""
        near = np.flatnonzero((self.small * numerator <= size * denominator) & (self.large * denominator >= size * numerator))
        near = near[(numerator + denominator) * np.minimum(self.high[near], point).sum(1, dtype=np.int64) >= numerator * (self.small[near] + size)]
        own = (near[:, None] * LEAF + np.arange(LEAF)).ravel()
        own = own[own < len(self.sizes)]
        met = np.minimum(self.points[own], point).sum(1, dtype=np.int64)
        fits = (numerator + denominator) * met >= numerator * (self.sizes[own] + size)
        return self.order[own[fits]], met[fits]


def _tree_pairs(numerator: int, denominator: int, nearest: bool = False):
    """Over rows (key, x, y, part, id, n, label, before, point) sorted by key, x, y: the pairs of each key that its tree leaves.

    A pair that meets at an earlier key of both (one that both carry) is left to that key, so that two documents
    that share many keys come out about once. Of a key that is dealt over several trees (x, y are numbers of parts of
    its rows) each finds the pairs between its two parts. Trees of one leaf are searched together.

    nearest: for each row of a tree the one row (id, other, met: the share of their sizes that their bound is) of
    another label that it is nearest to, if any can reach the threshold. Trees of one leaf propose none.
    """

    def met_before(before: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), 10_000):
            a, b = before[i[at : at + 10_000]], before[j[at : at + 10_000]]
            out[at : at + 10_000] = ((a[:, :, None] == b[:, None, :]) & (a != 0)[:, :, None]).any((1, 2))
        return out

    def found(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of whole trees; starts: the first row of each."""
        ids, sizes, labels, part, x, y = (rows.column(c).to_numpy() for c in ("id", "n", "label", "part", "x", "y"))
        given = rows.column("point").to_pylist()
        width = np.fromiter(map(len, given), dtype=np.int64, count=len(given))
        points = np.empty((len(ids), GROUPS), dtype=np.int32)
        plain = width == GROUPS
        points[plain] = np.frombuffer(b"".join([p for p in given if len(p) == GROUPS]), dtype=np.uint8).reshape(-1, GROUPS)
        points[plain] = np.where(points[plain] == FULL, 1 << 24, points[plain])
        for i in np.flatnonzero(~plain).tolist():
            points[i] = np.minimum(_counts(given[i], GROUPS), 1 << 24)
        before = np.zeros((len(ids), BEFORE), dtype=np.int64)
        lists = rows.column("before").combine_chunks()
        counts = np.asarray(pc.list_value_length(lists))
        before[np.repeat(np.arange(len(ids)), counts), np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)] = pc.list_flatten(lists).to_numpy()

        def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (labels[i] != labels[j]) & (ids[i] != ids[j]) & ((x[i] == y[i]) | (part[i] != part[j]))

        def kept(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            """Those of the pairs i, j (bounded in GROUPS already) that belong to this key and can reach the threshold."""
            first = ~met_before(before, i, j)
            i, j = i[first], j[first]
            more = np.flatnonzero((width[i] > GROUPS) & (width[j] > GROUPS))
            fits = np.ones(len(i), dtype=bool)
            for k in more.tolist():
                fits[k] = _can_reach(given[i[k]], given[j[k]], int(sizes[i[k]] + sizes[j[k]]), numerator, denominator)
            a, b = ids[i[fits]], ids[j[fits]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def best(box: CountVectorTree, first: int, end: int) -> pa.RecordBatch:
            """The nearest row of another label of each row, the one with the smallest id of several."""
            out = []
            for i in range(first, end):
                hit, met = box.bounds(points[i], int(sizes[i]), numerator, denominator)
                hit = hit + first
                other = apart(np.full(len(hit), i), hit)
                if other.any():
                    hit, share = hit[other], met[other] / (sizes[hit[other]] + sizes[i])
                    at = np.lexsort((ids[hit], -share))[0]
                    out.append((int(ids[i]), int(ids[hit[at]]), float(share[at])))
            own = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(own[0], pa.int64()), pa.array(own[1], pa.int64()), pa.array(own[2], pa.float64())], names=["id", "other", "met"])

        ends = np.append(starts[1:], len(ids))
        tree = np.repeat(np.arange(len(starts)), ends - starts)
        leaf = (ends - starts <= LEAF)[tree]
        for d in range(1, 1 if nearest else LEAF):
            i = np.flatnonzero((tree[:-d] == tree[d:]) & leaf[:-d])
            if not len(i):
                break
            j = i + d
            total, least = sizes[i] + sizes[j], np.minimum(sizes[i], sizes[j])
            fits = apart(i, j) & ((numerator + denominator) * least >= numerator * total)
            i, j, total = i[fits], j[fits], total[fits]
            fits = np.zeros(len(i), dtype=bool)
            for at in range(0, len(i), 8192):
                met = np.minimum(points[i[at : at + 8192]], points[j[at : at + 8192]]).sum(1, dtype=np.int64)
                fits[at : at + 8192] = (numerator + denominator) * met >= numerator * total[at : at + 8192]
            if fits.any():
                yield kept(i[fits], j[fits])
        for first, end in zip(starts.tolist(), ends.tolist(), strict=True):
            if end - first <= LEAF:
                continue
            box, held, n = CountVectorTree(points[first:end], sizes[first:end]), [], 0
            if nearest:
                yield best(box, first, end)
                continue
            for i in range(first, end):
                hit = box.search(points[i], int(sizes[i]), numerator, denominator) + first
                hit = hit[hit > i]
                hit = hit[apart(np.full(len(hit), i), hit)]
                held.append((np.full(len(hit), i), hit))
                n += len(hit)
                if n > 50_000:
                    yield kept(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
            if n:
                yield kept(*map(np.concatenate, zip(*held, strict=True)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last tree so far, which may go on
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, x, y = (batch.column(c).to_numpy() for c in ("key", "x", "y"))
            starts = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            goes_on, shift = held and last == (int(key[0]), int(x[0]), int(y[0])), sum(b.num_rows for b in held)
            last = int(key[-1]), int(x[-1]), int(y[-1])
            begins = [0, *([shift] if held and not goes_on else []), *(starts + shift).tolist()]
            open_ = begins.pop()
            if not begins:
                held.append(batch)
                continue
            yield from found(pa.Table.from_batches([*held, batch.slice(0, open_ - shift)]), np.array(begins))
            held = [batch.slice(open_ - shift)]
        if held:
            yield from found(pa.Table.from_batches(held), np.zeros(1, dtype=np.int64))

    return pairs


def _tree_rows(rows: DataFrame, most: int = TREE) -> DataFrame:
    """rows (key, id, n, label, before, point) with x, y, part: a tree's rows are those of one key, x and y.

    A key with more than ``most`` rows is cut into parts by a hash of the id, and each two parts (and each alone) make
    a tree, so no task holds more than about two parts, whatever the key's share of all rows.
    """
    counts = rows.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > most)
    counts = stored(counts.select("key", F.ceil(F.col("rows") / F.lit(most)).cast("int").alias("parts")), "hotkeys", wave=True)
    dealt = rows.join(counts, "key", "left")
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    own = dealt.withColumn("part", part)
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    own = own.withColumn("other", F.explode(others)).withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")})
    return own.select("key", "x", "y", "part", "id", "n", "label", "before", "point")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b of representatives) whose sets reach the threshold. Sets are made anew for these documents.

    The pairs of one a are verified against its set where it is; many of them are dealt to several tasks. So a set is
    sent once for each pair that it is the b of, and once for each of these tasks as a.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(TOGETHER)).cast("int").alias("tasks"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.hash("b"), F.col("tasks")).alias("task"))
    held = counts.select("a", F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("role"))
    uses = stored(dealt.select("a", F.col("b").alias("id"), "task", F.lit(1).alias("role")).unionByName(held.select("a", "id", "task", "role")), "uses", wave=True)
    wanted = stored(reps.join(uses.select("id").distinct(), "id", "left_semi"), "wanted", wave=True)
    ids = wanted.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_key")).distinct()
    if wanted.count() <= SMALL:
        wanted, ids = F.broadcast(wanted), F.broadcast(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, at in _sets_of(batch.column(0), words):
                sums, more = _signatures(h, at)
                own = pa.array([h[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(at)), sums, more, own], names=["n", "sig1", "sig2", "shingles"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_key"), F.col("text").cast("string").alias("text"))
    made = texts.join(ids, "doc_key", "left_semi").select("text").mapInArrow(trimmed(sets), "n long, sig1 long, sig2 long, shingles binary")
    own = made.join(wanted, ["n", "sig1", "sig2"]).select("id", "shingles")
    if uses.count() <= SMALL:
        uses = F.broadcast(uses)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left = None, None
        for batch in batches:
            a, b = [], []
            for x, task, role, id_, own in zip(*(batch.column(c).to_pylist() for c in ("a", "task", "role", "id")), batch.column("shingles"), strict=True):
                right = np.frombuffer(own.as_buffer(), np.uint64)
                if role == 0:
                    held, left = (x, task), right.copy()
                    continue
                if held != (x, task):
                    raise ValueError(f"the set of {x} is missing")
                met = len(np.intersect1d(left, right, assume_unique=True))
                if denominator * met >= numerator * (len(left) + len(right) - met):
                    a.append(x), b.append(id_)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = own.join(uses, "id").repartition(shuffle_partitions(docs.sparkSession), "a", "task").sortWithinPartitions("a", "task", "role")
    return rows.select("a", "task", "role", "id", "shingles").mapInArrow(trimmed(check), "a long, b long")


def _labelled(met: DataFrame, known: DataFrame) -> DataFrame:
    """key, id and label, the component so far."""
    return met.select("key", "id").join(known.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")


def _mixed_keys(labelled: DataFrame) -> DataFrame:
    """The keys whose rows aren't all of one label."""
    return labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")


def _partners(numerator: int, denominator: int):
    """Over rows (key, id, n, label) sorted by key: the pairs (key, id, other) of each key that labels and sizes leave.

    Of a key with more than LEAF rows, or with more than LISTED such pairs for each of them, all rows come out with a
    null for other, so what comes out is in proportion to the rows. No more than a leaf of an open key is held.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = [np.empty(0, dtype=np.int64)] * 4, None  # crowded: a key of which rows have gone out
        for batch in chain(batches, [None]):
            columns = held if batch is None else [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, ("key", "id", "n", "label"), strict=True)]
            key, ids, sizes, labels = columns
            if not len(key):
                continue
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            group = np.cumsum(new) - 1
            rows = np.bincount(group)
            many = rows > LEAF
            many[0] |= crowded == int(key[0])
            end = len(key) if batch is None or many[-1] else int(np.flatnonzero(new)[-1])
            crowded = int(key[-1]) if many[-1] else None
            held = [x[end:] for x in columns]
            first, second = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for d in range(1, LEAF):
                i = np.flatnonzero((group[: max(0, end - d)] == group[d:end]) & ~many[group[: max(0, end - d)]])
                if not len(i):
                    break
                j = i + d
                fits = (labels[i] != labels[j]) & (denominator * np.minimum(sizes[i], sizes[j]) >= numerator * np.maximum(sizes[i], sizes[j]))
                first.append(i[fits]), second.append(j[fits])
            i, j = np.concatenate(first), np.concatenate(second)
            many |= np.bincount(group[i], minlength=len(rows)) > LISTED * rows
            apart = ~many[group[i]]
            i, j = i[apart], j[apart]
            whole = np.flatnonzero(many[group[:end]])
            other = pa.concat_arrays([pa.array(np.maximum(ids[i], ids[j])), pa.nulls(len(whole), pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[i], key[whole]])), pa.array(np.concatenate([np.minimum(ids[i], ids[j]), ids[whole]])), other], names=["key", "id", "other"])

    return listed


def _may_meet(met: DataFrame, known: DataFrame, points: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The rows (key, id) of met that trees must hold, so that each pair that is still apart meets in one."""
    sized = _labelled(met, known).join(points.select("id", "n"), "id").select("key", "id", "n", "label")
    sized = sized.repartition(shuffle_partitions(met.sparkSession), "key").sortWithinPartitions("key")
    found = stored(sized.mapInArrow(trimmed(_partners(numerator, denominator)), "key long, id long, other long"), "partners", wave=True)
    pairs = found.filter("other is not null").groupBy("id", "other").agg(F.min("key").alias("key"))
    own = pairs.select("key", F.explode(F.array("id", "other")).alias("id")).distinct()
    return own.unionByName(found.filter("other is null").select("key", "id"))


def _nearest(met: DataFrame, known: DataFrame, points: DataFrame, numerator: int, denominator: int) -> tuple[DataFrame, int]:
    """Pairs (a, b) of each id of met (key, id) with what is nearest to it in another component, and how many."""
    labelled = stored(_labelled(met, known), "labelled", wave=True)
    rows = labelled.join(_mixed_keys(labelled), "key").withColumn("before", F.array().cast("array<long>")).join(points.drop("fine"), "id")
    rows = _tree_rows(stored(rows.select("key", "id", "n", "label", "before", "point"), "treerows"))
    trees = rows.repartition(shuffle_partitions(met.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y")
    found = trees.mapInArrow(trimmed(_tree_pairs(numerator, denominator, True)), "id long, other long, met double")
    best = found.groupBy("id").agg(F.max_by("other", F.struct("met", -F.col("other"))).alias("other"))
    pairs = stored(best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "nearest", wave=True)
    pairs = stored(_bounded(pairs, points, numerator, denominator), "pairs", wave=True)
    return pairs, pairs.count()


def near_duplicates(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """A row per document: row, doc_id, n_shingles, component_id, and class_row (equal for documents with one set)."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    sketch = sketches(docs, words, numerator, denominator)
    small = sketch.select("row", "doc_id", "n", "sig1", "sig2")
    groups = stored(small.filter("n > 0").groupBy("n", "sig1", "sig2").agg(F.min("row").alias("class_row"), F.count("*").alias("copies")), "classes", wave=True)
    repeated = groups.filter("copies > 1").drop("copies")
    members = stored(small.join(repeated, ["n", "sig1", "sig2"], "left").withColumn("class_row", F.coalesce("class_row", "row")), "members", wave=True)
    reps = members.filter("row = class_row and n > 0").select(F.col("row").alias("id"), "doc_id", "n", "sig1", "sig2")
    others = members.filter("row <> class_row or n = 0").select("row")
    points = sketch.select(F.col("row").alias("id"), "n", "point", F.coalesce("fine", "point").alias("fine"))

    # keys that two representatives or more share; each is led by its smallest
    keyed = sketch.select("row", "keys").join(others, "row", "left_anti").select(F.explode("keys").alias("key"), F.col("row").alias("id"))
    keyed = keyed.repartition(parts, "key").sortWithinPartitions("key", "id")
    release(spark)
    met = stored(keyed.mapInArrow(trimmed(_shared_keys), "key long, id long, lead long"), "sharedkeys")
    del keyed
    release(spark)
    partner = met.filter("id <> lead").groupBy("id", "lead").agg(F.count("*").alias("n")).groupBy("id").agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("lead"))
    bound = _bounded(stored(partner.select(F.col("lead").alias("a"), F.col("id").alias("b")), "partners", wave=True), points, numerator, denominator)
    links = stored(_verified(stored(bound, "pairs", wave=True), docs, reps, words, numerator, denominator), "links", wave=True)

    # keys of more than a leaf: what is nearest is linked first, whichever row leads
    crowded = stored(met.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > LEAF).select("key"), "crowded", wave=True)
    crowd = None if crowded.isEmpty() else stored(met.select("key", "id").join(crowded, "key"), "crowd", wave=True)
    near_points = None if crowd is None else stored(points.join(crowd.select("id").distinct(), "id", "left_semi"), "crowdpoints")
    known = stored(components(links), "known", wave=True)
    while crowd is not None:
        near, n = _nearest(crowd, known, near_points, numerator, denominator)
        more = stored(_verified(near, docs, reps, words, numerator, denominator), "links", wave=True)
        found = more.count()
        if found:
            links = stored(links.unionByName(more), "links", wave=True)
            known = stored(components(links), "known", wave=True)
        if YIELD * found <= n:
            break

    # what the trees must still tell apart
    labelled = stored(_labelled(_may_meet(met, known, points, numerator, denominator), known), "labelled", wave=True)
    release(spark)
    before = F.collect_list("key").over(W.partitionBy("id").orderBy("key").rowsBetween(-BEFORE, -1))
    rows = labelled.join(_mixed_keys(labelled), "key").withColumn("before", before).join(points.drop("fine"), "id").select("key", "id", "n", "label", "before", "point")
    rows = _tree_rows(stored(rows, "treerows"))
    open_ = rows.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(trimmed(_tree_pairs(numerator, denominator)), "a long, b long").distinct()
    more = _verified(stored(_bounded(stored(open_, "open", wave=True), points, numerator, denominator), "pairs", wave=True), docs, reps, words, numerator, denominator)
    links = stored(links.unionByName(more), "links", wave=True)

    final = components(links)
    own = members.join(final.select(F.col("node").alias("class_row"), "component"), "class_row", "left").withColumn("component", F.coalesce("component", "class_row"))
    own = stored(own, "labels", wave=True)
    named = stored(own.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).filter("size > 1"), "named", wave=True)
    return own.join(named, "component", "left").select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("size").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "class_row")


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id) sorted: those whose key occurs again, with the key's first id.

    The last row of a batch waits for the next one, with its key's first id and whether the row before had its key.
    """
    names = ["key", "id", "lead"]
    held: tuple[int, int, int, bool] | None = None
    for batch in batches:
        key, id_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        if held is not None:
            key, id_ = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], id_])
        before = np.zeros(len(key), dtype=bool)
        before[1:] = key[1:] == key[:-1]
        start = np.maximum.accumulate(np.where(before, 0, np.arange(len(key))))
        lead = id_[start]
        if held is not None:
            lead = np.where(start == 0, held[2], lead)
            before[0] = held[3]
        given = before[:-1] | (key[1:] == key[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][given]) for c in (key, id_, lead)], names=names)
        held = int(key[-1]), int(id_[-1]), int(lead[-1]), bool(before[-1])
    if held is not None and held[3]:
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in held[:3]], names=names)


def _bounded(pairs: DataFrame, points: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs whose summed coordinate minima, of the fine points, can reach the threshold."""
    own = points.select("id", "n", "fine")
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("fine").alias("p1")), "a").join(own.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("fine").alias("p2")), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column("n1").to_numpy() + batch.column("n2").to_numpy()).tolist()
            both = zip(sizes, batch.column("p1").to_pylist(), batch.column("p2").to_pylist(), strict=True)
            fits = np.array([_can_reach(x, y, n, numerator, denominator) for n, x, y in both], dtype=bool)
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(c), pa.array(fits)) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(trimmed(keep), "a long, b long")

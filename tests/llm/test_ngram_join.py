import random
import re

import numpy as np
import pyarrow as pa

from rejoinder.llm import ngram_join
from rejoinder.llm.components import components

SCHEMA = "doc_id long, text string, n long, key string, component long"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


def made(seed, n=260):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = [rnd.choices(words, k=40) for _ in range(2)]
    rows, bases = [], [rnd.choices(words, k=rnd.choice([5, 8, 30, 60, 200])) for _ in range(12)]
    for i in range(n):
        base = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            base[rnd.randrange(len(base))] = rnd.choice(words).upper()
        if rnd.random() < 0.3:
            base += rnd.choice(common)
        rows.append((i * 3, rnd.choice([" ", "\n", "\t "]).join(base), 1, "k", 2))
    rows += [(9001, "", 1, "k", 2), (9002, None, 1, "k", 2), (9003, " \n", 1, "k", 2), (9004, "One two", 1, "k", 2), (9005, "one\ttwo ", 1, "k", 2), (9006, "a\x1cb é\xa0x", 1, "k", 2)]
    rows += [(None, rows[3][1], 1, "k", 2), (12, "Repeated row of the same id once", 1, "k", 2), (12, "repeated row of the same id once", 1, "k", 2)]
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in got])) == sorted(map(str, brute(rows)))


def test_long_texts_are_cut_to_words_in_steps(monkeypatch):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices(["a", "Bc", "x" * 90, "\u00e9t\u00e9"], k=n)).encode() for n in (0, 3, 400, 900)] + [b"y" * 700, b" \t" * 300, b"z" * 300 + b" " + b"z" * 300]
    whole = ngram_join.shingle_sets(texts)
    monkeypatch.setattr(ngram_join, "STEP", 64)
    steps = ngram_join.shingle_sets(texts)
    assert all((a == b).all() for a, b in zip(whole, steps, strict=True)) and whole[1][-1] > 700
    assert np.diff(whole[1]).tolist() == [len(shingles(t.decode())) for t in texts]


def test_long_texts_link(spark):
    rnd = random.Random(8)
    long = " ".join(f"w{rnd.randrange(60_000)}" for _ in range(300_000))
    rows = [(5, long, 1, "k", 2), (3, long.replace("w1 ", "q1 "), 1, "k", 2), (9, " ".join(long.split()[:100_000]), 1, "k", 2), (1, "w1 w2", 1, "k", 2)]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {5: 3, 3: 3, 9: 9, 1: 1}


def test_a_key_over_several_trees_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREE", 12)
    real = ngram_join._tree_rows
    monkeypatch.setattr(ngram_join, "_tree_rows", lambda rows, most=12: real(rows, most))
    rows = made(3, 200)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in got])) == sorted(map(str, brute(rows)))


def test_pairs_of_near_copies_do_not_grow_with_their_square(spark, monkeypatch):
    rnd = random.Random(4)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(400):  # those with most edits lead, and are linked with few others
        own = list(base)
        for at in rnd.sample(range(150), max(1, 7 - i // 40)):
            own[at] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own), 1, "k", 2))
    seen, real = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *more: seen.append(pairs.count()) or real(pairs, *more))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))
    assert sum(seen) < 12 * len(rows), seen


def test_only_rows_that_can_meet_are_dealt_to_trees(spark, monkeypatch):
    rnd = random.Random(5)
    rows = []
    for i in range(40):  # a text, one that falls short of the threshold, and an excerpt: they share many keys
        base = [f"w{i}x{k}" for k in range(200)]
        other = list(base)
        for at in (30, 60, 90, 120, 150, 180):
            other[at] = f"y{rnd.randrange(10**6)}"
        rows += [(3 * i, " ".join(base), 1, "k", 2), (3 * i + 1, " ".join(other), 1, "k", 2), (3 * i + 2, " ".join(base[:120]), 1, "k", 2)]
    seen, real = [], ngram_join._tree_rows
    monkeypatch.setattr(ngram_join, "_tree_rows", lambda rows, most=ngram_join.TREE: seen.append(rows.count()) or real(rows, most))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))
    assert len(seen) == 1 and seen[0] <= 2 * len(rows), seen


def test_partners_of_keys_over_several_batches():
    rnd = random.Random(7)
    rows = []
    for key in range(60):
        for id_ in rnd.sample(range(1000), rnd.choice([1, 2, 2, 3, 6, 16, 30, 33, 90])):
            rows.append((key, id_, rnd.choice([1, 50, 60, 70, 90]), rnd.choice([id_, id_, 5])))
    batches, at = [], 0
    while at < len(rows):
        end = at + rnd.choice([0, 1, 2, 7, 40])
        batches.append(pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[at:end]], pa.int64()) for c in range(4)], names=["key", "id", "n", "label"]))
        at = end
    out = [r for b in ngram_join._partners(80, 100)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(out) == len(set(out))
    for key in range(60):
        own = [r[1:] for r in rows if r[0] == key]
        fits = {(min(x[0], y[0]), max(x[0], y[0])) for i, x in enumerate(own) for y in own[:i] if x[2] != y[2] and 100 * min(x[1], y[1]) >= 80 * max(x[1], y[1])}
        whole = len(own) > ngram_join.LEAF or len(fits) > ngram_join.LISTED * len(own)
        assert {(a, b) for k, a, b in out if k == key} == ({(r[0], None) for r in own} if whole else fits)


def test_empty(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_loses_no_pair():
    r = np.random.default_rng(1)
    points = r.integers(0, 4, (300, ngram_join.GROUPS)).astype("<u2")
    points[100:200] = points[:100] + r.integers(0, 2, (100, ngram_join.GROUPS)).astype("<u2") // 2
    sizes = points.sum(1).astype(np.int64)
    tree = ngram_join.CountVectorTree(points, sizes)
    for i in range(300):
        bound = np.minimum(points, points[i]).sum(1).astype(int)
        assert sorted(tree.search(points[i], int(sizes[i]), 80, 100)) == np.flatnonzero(180 * bound >= 80 * (sizes + sizes[i])).tolist()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 400), (500, 400)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 400: 400, 500: 400}

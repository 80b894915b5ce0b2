import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rejoinder.llm import periodic_runs, queries


def brute(words, least, power):
    """All runs, by comparing the words with themselves at every distance."""
    out, n = [], len(words)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a = np.array([number[w] for w in words], dtype=np.int64)
    for q in range(1, n // max(2, power) + 1):
        same = np.concatenate([[0], (a[q:] == a[:-q]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(same))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            size = e - s + q
            if size >= max(least, power * q, 2 * q) and not any((a[s : s + size - r] == a[s + r : s + size]).all() for r in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts_with_runs(rnd, count, longest):
    for _ in range(count):
        n, letters = rnd.randint(0, longest), rnd.randint(1, 5)
        w = [rnd.choice("abcdef"[:letters]) for _ in range(n)]
        if n and rnd.random() < 0.6:
            a, p = rnd.randrange(n), rnd.randint(1, max(1, n // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield w


@pytest.mark.parametrize(("least", "power"), [(6, 4), (2, 2), (5, 3), (4, 2)])
def test_runs_are_all_and_only_those_of_brute_force(least, power):
    rnd = random.Random(least * 10 + power)
    for _ in range(250):
        texts = list(texts_with_runs(rnd, rnd.randint(1, 5), 45))
        assert [[tuple(r) for r in x.tolist()] for x in periodic_runs.runs_of(texts, least, power)] == [brute(w, least, power) for w in texts]


def test_a_long_text_of_one_word_and_of_nested_periods():
    assert periodic_runs.runs_of([["a"] * 60_000])[0].tolist() == [[0, 60_000, 1]]
    inner = ["x"] * 7 + ["y"]
    got = periodic_runs.runs_of([["q"] + inner * 40 + ["r"]])[0].tolist()
    assert [1, 320, 8] in got and [1, 7, 1] in got and len(got) == 41
    w = [str(random.Random(5).randrange(10**9) + i) for i in range(30_000)]
    w = [w[i] if i < 9_000 else w[9_000 + (i - 9_000) % 4_321] for i in range(30_000)]
    assert periodic_runs.runs_of([w])[0].tolist() == [[9_000, 21_000, 4_321]]


def test_blocks_cover_every_squares_leftmost_place():
    rnd = random.Random(8)
    for w in texts_with_runs(rnd, 60, 40):
        s = np.array([ord(c) for c in w] + [0], dtype=np.int64)
        ranks = periodic_runs.substring_ranks(s)
        suffixes = np.argsort(ranks[-1])
        assert [tuple(s[i:]) for i in suffixes.tolist()] == sorted(tuple(s[i:]) for i in range(len(s)))
        found = set(zip(*(x.tolist() for x in periodic_runs.covering_squares(s, periodic_runs.lempel_ziv(suffixes, ranks), ranks, periodic_runs.substring_ranks(s[::-1]))), strict=True))
        t = "".join(w)
        squares = {(i, k) for k in range(1, len(t) // 2 + 1) for i in range(len(t) - 2 * k + 1) if t[i : i + k] == t[i + k : i + 2 * k]}
        assert found <= squares
        for i, k in squares:
            if t.find(t[i : i + 2 * k]) == i:  # the leftmost of its kind
                assert any((j, k) in found and all((x, k) in squares for x in range(j, i)) for j in range(i + 1))


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w, 6, 4)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    tail = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *tail, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, " \t".join(rnd.choice(["a", "bä", "c d", "e"][: rnd.randint(1, 4)]) for _ in range(rnd.randint(0, 60))), "en", "s") for i in range(400)]
    rows += [(None, "x " * 9, "en", "s"), (400, None, "en", "s"), (401, "", "en", "s"), (402, " \n\x0b", None, None), (3, "dup " * 8, "en", "s"), (3, "dup " * 8, "en", "s"), (403, "long " * 30_000, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumnsRenamed({"lang": "runs", "source": "w"}).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    want = [expected(d, t) for d, t, *_ in rows if d != 403]
    assert sorted(map(str, map(tuple, (r for r in got if r.doc_id != 403)))) == sorted(map(str, want))
    assert sum(r.n_runs > 0 for r in got) > 40
    assert [tuple(r)[1:5] for r in got if r.doc_id == 403] == [(1, 0, 30_000, 1)]


def test_whole_table_and_empty_table(spark):
    top = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{top}/documents.parquet")
    got = {r.doc_id: tuple(r)[:8] for r in queries.op11_periodic_runs(spark, top).collect()}
    assert got == {r.doc_id: expected(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    assert periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_tails(docs.limit(0)))).count() == 0

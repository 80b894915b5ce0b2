import hashlib
import random

import numpy as np

from rejoinder.llm import winnowing

SCHEMA = "doc_id long, text string, bucket int, ahead int, k long"


def plain(text, k, w):
    """Winnowing as published, one window at a time."""
    if not text:
        return []
    k = min(k, len(text))
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    h = [int(winnowing.gram_hashes(points[i : i + k], k)[0]) >> (64 - winnowing.HASH_BITS) for i in range(len(points) - k + 1)]
    w, got = min(w, len(h)), []
    for i in range(len(h) - w + 1):
        least = min(h[i : i + w])
        at = max(j for j in range(i, i + w) if h[j] == least)
        if not got or got[-1] != (least, at):
            got.append((least, at))
    return got


def test_equals_the_published_scheme(monkeypatch):
    rnd = random.Random(1)
    for step in (1 << 20, 37):
        monkeypatch.setattr(winnowing, "STEP", step)
        for _ in range(60):
            text = "".join(rnd.choice("abé日") for _ in range(rnd.choice([0, 1, 3, 8, 40, 300])))
            h, p = winnowing.winnow(text, 4, 7)
            assert list(zip(h.tolist(), p.tolist(), strict=True)) == plain(text, 4, 7)


def test_rightmost_tie_and_guarantee():
    h, p = winnowing.winnow("a" * 50, 4, 7)
    assert p.tolist() == list(range(6, 47))
    shared = "".join(random.Random(2).choice("abcdef") for _ in range(winnowing.K + winnowing.WINDOW - 1))
    a, b = winnowing.winnow("x" * 300 + shared + "y" * 99), winnowing.winnow(shared + "z" * 500)
    assert set(a[0].tolist()) & set(b[0].tolist())


def test_next_and_edited(spark):
    rnd = random.Random(4)
    rows = [(i * 7 % 101, rnd.choice(["", None, "é" * 9, "".join(rnd.choice("abc de") for _ in range(rnd.randrange(900)))]), 1, 1, 1) for i in range(101)]
    rows += [(None, "n", 1, 1, 1), (5, "twice", 1, 1, 1), (5, "twice", 1, 1, 1)]
    got = winnowing.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "", r[0]) for r in rows))
    want = []
    for i, (_, _, text, doc) in enumerate(order):
        nxt, cut = order[(i + 1) % len(order)][2], len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        f, g, h = (winnowing.winnow(x) for x in (text, edited, nxt))
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), winnowing.as_string(*f), winnowing.as_string(*g), winnowing.likeness(f[0], g[0]), winnowing.likeness(f[0], h[0])))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_and_alone(spark):
    assert winnowing.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = winnowing.fingerprints(spark.createDataFrame([(4, "abcdefgh", 1, 1, 1)], SCHEMA)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0


def test_short_edited_texts_stay_alike():
    rnd = random.Random(7)
    likes = []
    for n in [*range(32, 119), *range(60, 119), *range(119, 250, 5)]:
        text, other = ("".join(rnd.choice("abcdefgh ") for _ in range(n)) for _ in range(2))
        edited = text[: n - n // 4] + other[: n // 4]
        a, b = winnowing.winnow(text), winnowing.winnow(edited)
        likes.append((n, winnowing.likeness(a[0], b[0])))
        assert likes[-1][1] > 0, n  # three quarters are unchanged
        if n >= 60:
            assert len(set(a[0].tolist())) >= 2, n
    assert np.mean([x < 1 for _, x in likes]) > 0.9 and np.std([x for n, x in likes if n >= 119]) < 0.15


def test_long_texts_are_fingerprinted_whole(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(2_500_000))
    rows = [(1, long, 1, 1, 1), (2, long[: 2_000_000] + "x" * 500_000, 1, 1, 1), (3, None, 1, 1, 1)]
    got = {r.doc_id: r for r in winnowing.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].n_chars == 2_500_000 and 0.6 < got[1].near_next < 0.85 and got[2].near_next == 0.0
    assert got[1].edited_sha256 == hashlib.sha256((long[: 1_875_000] + (long[:625_000])).encode()).hexdigest()
    assert got[1].fingerprint == winnowing.as_string(*winnowing.winnow(long)) and len(got[1].fingerprint.split()) > 200_000
    assert (got[3].n_chars, got[3].fingerprint) == (0, "")

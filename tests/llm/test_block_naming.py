import hashlib
import random
import re

from rejoinder.llm.block_naming import exact_duplicates

SCHEMA = "doc_id long, text string, row string, name long, i int"


def brute(rows):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    return [(r[0], hashlib.sha256(t.encode()).hexdigest(), texts.count(t), min((x[0] for x, u in zip(rows, texts, strict=True) if u == t and x[0] is not None), default=None)) for r, t in zip(rows, texts, strict=True)]


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    bodies = ["", "a", " ", "\t", "a\x0b \nb", "a b", "é" * 20, "é" * 21, "x" * 8, "x" * 16, "x" * 17, "日本" * 9, "abcdefgh" * 40, "abcdefgh" * 39 + "abcdefgX"]
    rows = [(i, rnd.choice(bodies), "r", 7, 1) for i in range(300)] + [(None, None, "r", 7, 1), (5, "dup", "r", 7, 1), (5, "dup", "r", 7, 1), (None, "only null ids", "r", 7, 1)]
    got = exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), block=8).collect()
    assert sorted(map(str, [(r.doc_id, r.text_sha256, r.group_size, r.keep_id) for r in got])) == sorted(map(str, brute(rows)))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_long_texts(spark):
    long = "ab " * 1_000_000
    rows = [(1, long, "r", 7, 1), (2, long.replace(" ", "\t"), "r", 7, 1), (3, long + "x", "r", 7, 1), (4, "x" + long, "r", 7, 1), (5, "short", "r", 7, 1)]
    got = exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)}
    assert sorted(map(str, [(r.doc_id, r.text_sha256, r.group_size, r.keep_id) for r in got])) == sorted(map(str, brute(rows)))


def test_empty(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rejoinder.llm import mixing, packing, site_quality
from tests.llm.test_ngram_join import brute, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, component_id int, __note string"


def table(spark, rows):
    """rows: (doc_id, text); the last three columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", 1, f"n{k}") for k, (i, t) in enumerate(rows)], SCHEMA)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


LONG = " ".join(f"w{i}" for i in range(200))


def test_exact_copies_go(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, "a b"), (7, "other"), (7, "other"), (7, "else"), (None, None), (5, ""), (None, "only null"), (8, "x" * 300_000)]
    got = corpus_pipeline.exact_dedup(spark, table(spark, rows), "")
    assert got.columns == table(spark, rows).columns
    assert kept(got) == sorted([(1, "a\tb"), (7, "other"), (7, "else"), (5, ""), (None, "only null"), (8, "x" * 300_000)], key=str)


def test_near_copies_go_even_where_ids_repeat(spark):
    rows = [
        (9, LONG), (4, LONG.replace("w199", "zz")), (9, "a text of its own with the same id"), (4, LONG.upper() + " more"), (None, LONG + " w200"),
        (None, "another text that has no id at all"), (None, "a third text without any id"), (1, None), (2, ""), (2, " \n"), (6, "two words"), (5, "Two\twords"),
    ]
    got = corpus_pipeline.near_dedup(spark, table(spark, rows).repartition(3), "")
    alone = [rows[2], *rows[5:10], rows[11]]
    one = [r for r in kept(got) if shingles(r[1]) & shingles(LONG)]
    assert len(one) == 1 and one[0][0] == 4
    assert sorted([r for r in kept(got) if r not in one], key=str) == sorted(alone, key=str)
    assert got.columns == table(spark, rows).columns


def test_stages_equal_brute_force_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    exact = corpus_pipeline.exact_dedup(spark, docs, sf)
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert sorted(r.doc_id for r in exact.select("doc_id").collect()) == sorted(first.values())
    near = corpus_pipeline.near_dedup(spark, docs, sf)
    assert sorted(r.doc_id for r in near.select("doc_id").collect()) == sorted(i for i, n, c in brute(rows) if n == 0 or c == i)


def test_extra_columns_keep_their_values_whatever_their_names(spark):
    sf = "/root/testdata/sf0.001"
    names = [*site_quality.NAMES, *mixing.NAMES, "__site", "__id", "__sha", "__other", "__row", "__n", "row", "key", "label", "component_id", "n", "id", "weight", "tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60 or doc_id % 9 = 0")
    docs = docs.unionByName(docs.limit(5))  # rows that repeat, so that every way through a stage is taken
    docs = docs.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names), name
    assert corpus_pipeline.pack(spark, docs, sf).count() >= docs.count()


def test_run_does_what_the_stages_say(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = site_quality.judged(docs, site_quality.learn(docs, labels), F.col("source"), F.col("lang"))
    left = {r.doc_id: (r.text or "", r.source, r.lang) for r in judged.filter(F.col("__posterior") >= site_quality.THRESHOLD).collect()}
    assert 0 < len(left) < docs.count()
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i][0]), i)
    rows = [(i, left[i][0]) for i in sorted(first.values())]
    rest = {i for i, n, c in brute(rows) if n == 0 or c == i}

    def cell(text, source, lang):
        topic = "tables" if " | " in text else "notes" if len(text) < 400 else "long reads" if len(text) > 6000 else "articles"
        return source or mixing.NONE, lang or mixing.NONE, topic

    tokens = defaultdict(float)
    for i in rest:
        tokens[cell(*left[i])] += len(re.findall(r"[^\x20\x09-\x0D]+", left[i][0]))
    total, target = sum(tokens.values()), []
    for k, power in enumerate(mixing.TEMPER.values()):
        margin = defaultdict(float)
        for c, n in tokens.items():
            margin[c[k]] += n
        whole = sum(n**power for n in margin.values())
        share, cap, held = {v: n**power / whole for v, n in margin.items()}, {v: n / (mixing.BUDGET * total) for v, n in margin.items()}, set()
        while True:  # values without the tokens for their share give what they have
            factor = (1 - sum(cap[v] for v in held)) / sum(share[v] for v in share if v not in held)
            more = {v for v in share if v not in held and share[v] * factor > cap[v]}
            if not more:
                break
            held |= more
        target.append({v: cap[v] if v in held else share[v] * factor for v in share})
    budget = mixing.BUDGET
    weight = {c: budget * n for c, n in tokens.items()}
    for _ in range(60):
        for k in range(3):
            held, free = defaultdict(float), defaultdict(float)
            for c, w in weight.items():
                if w >= tokens[c]:
                    held[c[k]] += tokens[c]
                else:
                    free[c[k]] += w
            for c, w in weight.items():
                want = budget * total * target[k][c[k]]
                if free[c[k]] > 0:
                    weight[c] = w * max(want - held[c[k]], 0) / free[c[k]]
                elif held[c[k]] > 0:
                    weight[c] = w * want / held[c[k]]

    def stays(i):
        c = cell(*left[i])
        p = min(1.0, weight[c] / tokens[c]) if tokens[c] else 1.0
        return int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16) / 2**52 < round(p, 9)

    want = {i for i in rest if stays(i)}
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert set(got["doc_id"]) == want and 0 < len(want) < len(rest)

    bins = got.groupby("sequence_id")["length"].sum()
    assert bins.max() <= packing.CAPACITY
    assert len(bins) == -(-bins.sum() // packing.CAPACITY) or len(bins) == packing.lower_bound(got["length"].to_numpy())
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]]
    for _, own in got.groupby("doc_id"):
        own = own.sort_values("piece")
        assert own["start"].tolist() == [packing.CAPACITY * k for k in range(len(own))] and own["piece"].tolist() == list(range(len(own)))


@pytest.mark.parametrize("k", range(5))
def test_empty_tables_and_columns(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    none = table(spark, [(1, "a")]).limit(0)
    got = stage(spark, none, "/root/testdata/sf0.001")
    assert got.count() == 0
    if k < 4:
        assert got.columns == none.columns

import numpy as np
import pytest
from pyspark.sql import functions as F

from rejoinder.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, v int, codes string"


def lloyd(x, parts, entries, rounds):
    """All distances in every round, in whole numbers."""
    x = x.reshape(len(x), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((x[:, :, None, :] - book[None].transpose(0, 1, 2, 3)) ** 2).sum(-1)
        near = d.argmin(2)
        if k < rounds:
            for p in range(parts):
                for e in range(book.shape[1]):
                    if (near[:, p] == e).any():
                        book[p, e] = x[near[:, p] == e, p].sum(0) // (near[:, p] == e).sum()
    return near, d.min(2).sum(1), book


@pytest.mark.parametrize(("spread", "entries"), [(0.3, 16), (0.01, 16), (1.0, 5), (0.004, 7)])
def test_codes_are_those_of_all_distances(spark, spread, entries):
    """Small spreads make whole components few, so that many distances tie."""
    r = np.random.default_rng(int(spread * 1000))
    rows = [(i, [float(c) for c in r.normal(0, spread, 12)], i % 3, 1, "x") for i in range(500)]
    whole = vector_codes.whole_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    x = np.array([np.floor(np.float32(v).astype(np.float64) * 1024) for _, v, *_ in rows]).astype(np.int64)
    near, error, book = lloyd(x, 4, entries, 3)
    coded, got = vector_codes.vector_codes(spark, whole, entries=entries, rounds=3)
    assert got.tolist() == book.tolist()
    out = {q.vec_id: q for q in coded.collect()}
    assert [list(out[i].codes) for i in range(500)] == near.tolist() and [out[i].error for i in range(500)] == error.tolist()
    if spread == 0.3:
        assert sum(q.measured for q in out.values()) < 0.6 * 500 * 4 * entries  # of the last round: bounds left out the rest


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.0001, 1.0, 2.0], 7, 0, ""), (2, None, 7, 0, ""), (3, [1.0, None, 1.0, 1.0], 7, 0, ""), (4, [nan, 1.0, 1.0, 1.0], None, 0, ""), (5, [1.0, -inf, 1.0, 1.0], None, 0, "")]
    rows += [(1, [0.5, 0.5, 1.0, 2.0], None, 0, ""), (None, [0.25, 0.0, 1.0, 2.0], None, 0, ""), (6, [0.5, 0.5, 1.0, 2.0], 8, 0, "")]
    whole = vector_codes.whole_vectors(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, whole.select("vec_id", "v").na.fill(-1).collect())) == [(-1, [256, 0, 1024, 2048]), (1, [512, -1, 1024, 2048]), (1, [512, 512, 1024, 2048]), (6, [512, 512, 1024, 2048])]
    coded, book = vector_codes.vector_codes(spark, whole)
    assert book.shape == (4, 4, 1) and book[1].ravel().tolist() == [-1, 512, 512, 0]
    got = vector_codes.label_errors(coded).select("vec_id", F.lower(F.hex("codes")).alias("c"), "error", "label", "label_error").collect()
    assert sorted((str(r.vec_id), r.c, r.error, r.label_error) for r in got) == [("1", "00000000", 0, 0), ("1", "00010000", 0, 0), ("6", "00010000", 0, 0), ("None", "03030000", 0, 0)]
    coded, book = vector_codes.vector_codes(spark, whole.limit(0))
    assert coded.count() == 0 and book is None and vector_codes.codebook_text(book) == ""
    for bad in ([[1.0, 2.0]], [[1e30, 0.0, 0.0, 0.0]], [[1.0] * 4, [1.0] * 8]):
        with pytest.raises(ValueError, match="vectors need one length"):
            vector_codes.vector_codes(spark, vector_codes.whole_vectors(spark.createDataFrame([(i, v, 1, 0, "") for i, v in enumerate(bad)], SCHEMA)))


def test_label_errors_sum_over_the_query(spark):
    got = queries.op13_vector_codes(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == 500 and (got.code.str.len() == 8).all() and got.codebooks_sha256.nunique() == 1 and got.label_error.sum() > 0

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rejoinder.llm import packing, separators
from rejoinder.llm.word_bpe import WordBpe, load_ranks

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, row string, part long"
ODD = ["", None, "don't we'll 's 'start ''s", "12 3é ½²", "İstanbul Σας", "a<|endoftext|>b", "\x85\xa0 q\x1c\x1dz", "it’s", "'", "日本 語", "x" * 5000, "word " * 9000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    rnd = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("ab'stmdrevl 1é\n.!\"ſ²ªŀĿǄ") for _ in range(rnd.randrange(60))) for _ in range(500)]
    ids, at = WordBpe(PATH).encode(texts)
    for i, t in enumerate(texts):
        assert library.encode(t, add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist()


def test_every_merge_splits_as_listed():
    """The premise of word_bpe: ranks below a merged token's split its bytes into the two parts of its merge."""
    ranks, _, merges = load_ranks(PATH)
    for a, b in merges:
        whole, parts = ranks[a + b], [bytes([c]) for c in a + b]
        while len(parts) > 2:
            k, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            assert k < whole
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [a, b] or len(a + b) == 2


def test_separator_scan_counts_every_document(spark, library):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "no id", "x", 1), (3, "again", "x", 1), (3, "again", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = separators.document_token_counts(spark, docs, PATH, shard_tokens=700, block_tokens=64).select("doc_id", "n_tokens").collect()
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    want = [(i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    assert sorted((str(a), b) for a, b in got) == sorted((str(a), b) for a, b in want)


def test_separator_scan_reports_an_unended_tail(spark, tmp_path):
    tokens = np.array([5, 9, 7, 9, 9, 4, 4], dtype="<u2")
    for k in range(3):
        tokens[3 * k : 3 * k + 3].tofile(tmp_path / f"{k}.bin")
    shards = spark.createDataFrame([("s", k, str(tmp_path / f"{k}.bin"), len(tokens[3 * k : 3 * k + 3])) for k in range(3)], "stream string, shard int, path string, n_tokens long")
    got = separators.separator_scan(shards, f"file://{tmp_path}", end=9, block_tokens=2).orderBy("ordinal").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 1, True), (1, 2, 1, True), (2, 4, 0, True), (3, 5, 2, False)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert separators.document_token_counts(spark, docs, PATH).count() == 0
    assert packing.pack(packing.tokenised_pieces(docs, PATH)).count() == 0


def test_bounds_and_best_fit():
    r = np.random.default_rng(0)
    for _ in range(60):
        x = r.integers(1, 33, r.integers(1, 9))
        bins, offsets, free = packing.best_fit_decreasing(x, 32)
        used = np.zeros(len(free), int)
        for b, o, n in sorted(zip(bins, offsets, x, strict=True)):
            assert used[b] == o
            used[b] += n
        assert (used + free == 32).all()
        assert packing.lower_bound(x, 32) <= _fewest(sorted(x, reverse=True), 32) <= len(free)


def _fewest(items, capacity):
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best and i < len(items):
            return
        if i == len(items):
            best = min(best, len(rooms))
            return
        for r in set(rooms):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, [*rest, r - items[i]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


def test_packing_is_whole_and_gapless(spark, library):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, None, "x", 1), (3, "again", "x", 1), (3, "again", "x", 1)]
    rows += [(100 + i, "word " * (37 * i % 900), "x", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = packing.pack(packing.tokenised_pieces(docs, PATH), part_size=40).collect()
    want = []
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(str(i), k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096])) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in got])) + 2
    assert docs.select(F.count("*")).first()[0] == len(rows)


def test_every_part_is_certified_as_it_is_left(spark):
    rnd = random.Random(4)
    lengths = [rnd.choice([9, 15, 17, 18, 23, 31, 33, 40, 49, 64]) for _ in range(1500)]
    rows = [(i, i, 0, 0, n, 7) for i, n in enumerate(lengths)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), 64, part_size=100).toPandas()
    assert sorted(got["length"]) == sorted(lengths) and got["row"].is_unique
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["length"].sum() <= 64 and own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]]
    for _, own in got.groupby("part"):
        assert own["sequence_id"].nunique() == own["part_bins"].iloc[0] >= own["part_bound"].iloc[0] == packing.lower_bound(own["length"].to_numpy(), 64)
        assert own[["part_bins", "part_bound"]].drop_duplicates().shape[0] == 1 and len(own) <= 600  # a few parts
    total = got["sequence_id"].nunique()
    assert (got["total_bins"] == total).all() and (got["total_bound"] == packing.lower_bound(np.array(lengths), 64)).all()
    apart = sum(packing.best_fit_decreasing(own["length"].to_numpy(), 64)[0].max() + 1 for _, own in got.assign(p=got["row"] * 7919 % 15).groupby("p"))
    assert got["part"].max() >= 1 << 40 and total < apart  # exchanges were taken, and they gain over parts left alone


def test_ten_rounds_and_more_of_exchanges(spark):
    """Small parts and large pieces, where groups gain in round after round."""
    rnd = random.Random(11)
    lengths = [rnd.randint(900, 2600) for _ in range(4000)]
    rounds = []
    exchanged = packing._exchanged
    packing._exchanged = lambda open_, groups, round_, capacity: rounds.append(round_) or exchanged(open_, groups, round_, capacity)
    try:
        got = packing.pack(spark.createDataFrame([(i, i, 0, 0, n, 7) for i, n in enumerate(lengths)], packing.PIECES), 4096, part_size=12).toPandas()
    finally:
        packing._exchanged = exchanged
    assert max(rounds) >= 10
    assert sorted(got["length"]) == sorted(lengths) and got["row"].is_unique
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["part"].nunique() == 1 and own["length"].sum() <= 4096 and own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]]
    for _, own in got.groupby("part"):
        assert own["sequence_id"].nunique() == own["part_bins"].iloc[0] >= own["part_bound"].iloc[0] == packing.lower_bound(own["length"].to_numpy())
    assert (got["total_bins"] == got["sequence_id"].nunique()).all() and (got["total_bound"] == packing.lower_bound(np.array(lengths))).all()

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rejoinder.llm import queries, token_shards

PATH = queries.tokenizer()


class Bytes:
    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        self.read += n
        return self.data[at : at + n]


def shard(ids, block_bits=128, lengths=None):
    return token_shards.Shard(Bytes(token_shards.file_bytes(ids, [None, *range(1, len(lengths or [0]))][: len(lengths or [0])], lengths or [len(ids)], block_bits=block_bits)))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 129, 700, 4000])
@pytest.mark.parametrize("block_bits", [64, 128, 1 << 18])
def test_access_count_and_places_are_those_of_the_plain_sequence(n, block_bits):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.3, n) % 49408).astype("u2")
    assert (shard(ids, block_bits).matrix.all() == ids).all()
    i, j = r.integers(0, max(n, 1), 40 if n else 0), r.integers(0, n + 1, 25)
    assert (shard(ids, block_bits).matrix.access(i) == ids[i]).all()
    for token in {0, 1, 7, 49407, *ids[:3].tolist()}:
        m = shard(ids, block_bits).matrix  # a new one, so that no block is there yet
        assert m.places(token).tolist() == np.flatnonzero(ids == token).tolist()
        assert m.count(token, j).tolist() == [int((ids[:x] == token).sum()) for x in j]
        a, b = sorted(r.integers(0, n + 1, 2).tolist())
        assert m.places(token, a, b).tolist() == (a + np.flatnonzero(ids[a:b] == token)).tolist()
    assert shard(ids, block_bits).matrix.places(1 << 20).tolist() == []


def test_one_question_reads_a_small_part_of_the_file():
    ids = (np.random.default_rng(1).integers(0, 49408, 400_000)).astype("u2")
    data = token_shards.file_bytes(ids, [1], [len(ids)], block_bits=1 << 12)
    file = Bytes(data)
    s = token_shards.Shard(file)
    opened = file.read
    assert s.matrix.access(np.array([123_456])).tolist() == [int(ids[123_456])]
    assert file.read - opened < len(data) / 20


def rows():
    text = ["plain words here", None, "", "Ünïcode — ツ 漢字 text", '# " # hash', "<|endoftext|> inside", "word " * 5_000, "tie", "tie", "other tie"]
    return [(i, t) for i, t in zip([9, 8, 7, 6, 5, 4, 3, 2, 2, 2], text, strict=True)] + [(None, "no id"), (None, "no id either")] + [(100 + 7 * i % 90, f"number {i} " * (i % 13)) for i in range(90)]


def test_round_trip_over_many_files(spark):
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows()], "doc_id long, text string, bucket int, base int").repartition(3)
    shards = token_shards.write_shards(docs, PATH, shard_tokens=200, block_bits=256)
    folder = shards.first()["folder"]
    assert shards.count() > 10 and shards.agg({"n_docs": "sum"}).first()[0] == len(rows())
    got = token_shards.read_documents(shards, folder).collect()
    library = Tokenizer.from_file(PATH)
    ids = {(d, t): np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for d, t in rows()}
    want = sorted((str(d), len(x), zlib.crc32(x), int((x == 2).sum())) for (d, t), x in ((k, ids[k]) for k in rows()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32, r.n_ends) for r in got) == want
    by_place = sorted(got, key=lambda r: r.place)
    assert [r.place for r in by_place] == np.concatenate([[0], np.cumsum([r.n_tokens for r in by_place])[:-1]]).tolist()
    order = [r.doc_id for r in by_place]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    crc = {zlib.crc32(x): x for x in ids.values()}
    flat = np.concatenate([crc[r.ids_crc32] for r in by_place])
    token = int(ids[3, "word " * 5_000][0])
    places = token_shards.token_places(shards, folder, [2, token]).collect()
    assert sorted(r.place for r in places if r.token == token) == np.flatnonzero(flat == token).tolist()
    assert sorted(r.place for r in places if r.token == 2) == np.flatnonzero(flat == 2).tolist()
    asked = [0, 17, len(flat) - 1, len(flat) // 2, len(flat) + 5]
    assert sorted(tuple(r) for r in token_shards.tokens_at(shards, folder, asked).collect()) == sorted((p, int(flat[p])) for p in asked if p < len(flat))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_shards.write_shards(docs, PATH).count() == 0


def test_query_on_its_table(spark):
    top = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(PATH)
    at, want = 0, []
    for r in spark.read.parquet(f"{top}/documents.parquet").orderBy("doc_id").collect():
        x = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((r.doc_id, at, len(x), zlib.crc32(x)))
        at += len(x)
    assert sorted(tuple(r)[:4] for r in queries.op12_token_shards(spark, top).collect()) == want

"""Token ids in wavelet-matrix files: one compressed file a shard that gives tokens, counts and places.

A file holds the ids of some documents as bit planes, highest bit first: each plane is the sequence's bits, and the next
plane's sequence is this one's zeros, then its ones, each in order. Planes are cut into blocks that are compressed apart;
a directory holds each block's place and the ones before it, so a question reads the blocks it needs and no others:

* ``access``: the ids at places, by one rank in each plane;
* ``count``: how often an id occurs before a place, by two;
* ``places``: where an id occurs in a range, by select from the last plane up.

``write_shards`` encodes documents, deals them to ranges of doc_id and writes each range in order; ``read_documents``
gives each document's place and checksum from the files alone, ``token_places`` and ``tokens_at`` answer for all files.
Files lie in the folder that the cluster shares; names hold a random part and only those in the written manifest are
read, so what a lost or repeated task left is ignored.

Defined cases: a null text is empty and holds the end id alone; a very long text is one document of one file; rows that
share a doc_id follow each other by the hash of their texts, null doc_ids come first; an empty table gives no files and
no rows; extra columns are ignored, whatever their names. Ids are below 2**16.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.llm.shared import in_small_batches, scratch, shuffle_partitions, stored, trimmed
from rejoinder.llm.word_bpe import encode_column, worker_bpe
from rejoinder.operators.ranges import bucket_of

END = 2
BITS = 16
#: Tokens at which a file is closed, behind a whole document.
SHARD_TOKENS = 1 << 21
BLOCK_BITS = 1 << 18
MAGIC, HEAD = b"WAVELET1", "<8sQQQIII"
MANIFEST = "bucket int, shard int, path string, n_tokens long, n_docs long"
DOCUMENTS = "doc_id long, place long, n_tokens long, ids_crc32 long, n_ends long, base long"


class Planes:
    """Bit planes with rank and select. Blocks are fetched when they are first needed."""

    def __init__(self, n: int, zeros: np.ndarray, ones: np.ndarray, block_bits: int, fetch):
        self.n, self.zeros, self.ones, self.block_bits, self.fetch = n, zeros, ones, block_bits, fetch
        words = -(-n // 64) + 1
        self.words = np.zeros((len(zeros), words), dtype=np.uint64)
        self.before = np.zeros((len(zeros), words), dtype=np.int64)  # ones before each word
        self.here = np.zeros((len(zeros), max(1, -(-n // block_bits))), dtype=bool)

    def need(self, plane: int, blocks: np.ndarray) -> None:
        for b in np.unique(blocks[~self.here[plane, blocks]]).tolist():
            words = np.frombuffer(self.fetch(plane, b), dtype="<u8")
            at = b * self.block_bits // 64
            self.words[plane, at : at + len(words)] = words
            counts = np.cumsum(np.bitwise_count(words).astype(np.int64))
            self.before[plane, at : at + len(words)] = self.ones[plane, b] + np.concatenate([[0], counts[:-1]])
            if at + len(words) < self.words.shape[1]:
                self.before[plane, at + len(words)] = self.ones[plane, b] + counts[-1]
            self.here[plane, b] = True

    def rank(self, plane: int, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits, for each i from 0 to n."""
        self.need(plane, np.maximum(i - 1, 0) // self.block_bits)
        word, low = i >> 6, (i & 63).astype(np.uint64)
        whole = low == 0  # the word itself may lie in a block that isn't here
        back = np.where(whole & (i > 0), word - 1, word)
        part = np.where(whole, np.where(i > 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)), (np.uint64(1) << low) - np.uint64(1))
        return self.before[plane, back] + np.bitwise_count(self.words[plane, back] & part).astype(np.int64)

    def bit(self, plane: int, i: np.ndarray) -> np.ndarray:
        self.need(plane, i // self.block_bits)
        return ((self.words[plane, i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

    def select(self, plane: int, k: np.ndarray, value: int) -> np.ndarray:
        """The place of the k-th (from 0) bit that is value: by halves, first of blocks' counts, then of ranks inside one."""
        starts = np.arange(len(self.here[plane]), dtype=np.int64) * self.block_bits
        ahead = self.ones[plane] if value else starts - self.ones[plane]
        block = np.searchsorted(ahead, k, side="right") - 1
        lo, hi = starts[block], np.minimum(starts[block] + self.block_bits, self.n)  # rank(lo) <= k < rank(hi)
        while (open_ := hi - lo > 1).any():
            mid = np.where(open_, (lo + hi) >> 1, lo + 1)
            r = self.rank(plane, mid)
            left = (r if value else mid - r) > k
            hi, lo = np.where(open_ & left, mid, hi), np.where(open_ & ~left, mid, lo)
        return lo


class WaveletMatrix:
    """Ids of a sequence by their bit planes."""

    def __init__(self, planes: Planes):
        self.planes, self.n, self.bits = planes, planes.n, len(planes.zeros)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The ids at places i."""
        i, out = np.asarray(i, dtype=np.int64), np.zeros(len(i), dtype=np.int64)
        for p in range(self.bits):
            bit, ones = self.planes.bit(p, i), self.planes.rank(p, i)
            out = out << 1 | bit
            i = np.where(bit == 1, self.planes.zeros[p] + ones, i - ones)
        return out

    def _down(self, token: int, i: np.ndarray) -> np.ndarray:
        """Where the first i ids' occurrences of token end (or would) in the last order."""
        for p in range(self.bits):
            ones = self.planes.rank(p, i)
            i = self.planes.zeros[p] + ones if token >> (self.bits - 1 - p) & 1 else i - ones
        return i

    def count(self, token: int, i: np.ndarray) -> np.ndarray:
        """Occurrences of token among the first i ids, for each i."""
        if not 0 <= token < 1 << self.bits:
            return np.zeros(len(i), dtype=np.int64)
        i = np.asarray(i, dtype=np.int64)
        return self._down(token, i) - self._down(token, np.zeros(1, dtype=np.int64))

    def places(self, token: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """All places of token from start to before stop, ascending."""
        if not 0 <= token < 1 << self.bits or self.n == 0:
            return np.zeros(0, dtype=np.int64)
        lo, hi = self._down(token, np.array([start, self.n if stop is None else stop], dtype=np.int64)).tolist()
        i = np.arange(lo, hi, dtype=np.int64)
        for p in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - p) & 1
            i = self.planes.select(p, i - self.planes.zeros[p] if one else i, one) if len(i) else i
        return i

    def all(self) -> np.ndarray:
        """All ids, by undoing the planes' partitions from the last up: two steps a plane rather than ranks."""
        ids = np.zeros(self.n, dtype=np.uint16)
        for p in range(self.bits - 1, -1, -1):
            if self.n:
                self.planes.need(p, np.arange(len(self.planes.here[p])))
            bit = np.unpackbits(self.planes.words[p].view(np.uint8), bitorder="little", count=self.n).astype(bool)
            up, z = np.empty(self.n, dtype=np.uint16), int(self.planes.zeros[p])
            up[~bit], up[bit] = ids[:z], ids[z:] | np.uint16(1 << (self.bits - 1 - p))
            ids = up
        return ids


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def file_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], bits: int = BITS, block_bits: int = BLOCK_BITS) -> bytes:
    """The file of a shard: head, directory, blocks."""
    codec, n = _codec(), len(ids)
    blocks = max(1, -(-n // block_bits))
    zeros, ones, sizes, body = np.zeros(bits, "<u8"), np.zeros((bits, blocks), "<u8"), np.zeros(bits * blocks, "<u8"), []
    ids = ids.astype(np.uint16)
    for p in range(bits):
        bit = (ids >> np.uint16(bits - 1 - p) & np.uint16(1)).astype(bool)
        padded = np.zeros(blocks * block_bits // 8, dtype=np.uint8)
        packed = np.packbits(bit, bitorder="little")
        padded[: len(packed)] = packed
        rows = padded.reshape(blocks, -1)
        counts = np.bitwise_count(rows).sum(1).astype(np.int64)
        ones[p], zeros[p] = np.cumsum(counts) - counts, n - int(counts.sum())
        for b in range(blocks):
            used = -(-max(1, min(block_bits, n - b * block_bits)) // 64) * 8
            body.append(codec.compress(rows[b, :used].tobytes(), asbytes=True))
            sizes[p * blocks + b] = len(body[-1])
        ids = np.concatenate([ids[~bit], ids[bit]])
    none = np.array([d is None for d in doc_ids], dtype=np.uint8)
    known = np.array([d or 0 for d in doc_ids], dtype="<i8")
    raw = known.tobytes() + none.tobytes() + np.array(lengths, "<u8").tobytes() + zeros.tobytes() + ones.tobytes() + sizes.tobytes()
    directory = codec.compress(raw, asbytes=True)
    return struct.pack(HEAD, MAGIC, n, len(doc_ids), len(directory), len(raw), bits, block_bits) + directory + b"".join(body)


class Shard:
    """An open file: its documents, and its ids as a wavelet matrix."""

    def __init__(self, file):
        head = struct.calcsize(HEAD)
        magic, n, docs, packed, size, bits, block_bits = struct.unpack(HEAD, file.read_at(head, 0))
        if magic != MAGIC:
            raise ValueError("not a file of this format")
        raw, blocks, at = bytes(_codec().decompress(file.read_at(packed, head), size)), max(1, -(-n // block_bits)), 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += got.nbytes
            return got.astype(np.int64)

        known, none, self.lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
        zeros, ones, sizes = take("<u8", bits), take("<u8", bits * blocks).reshape(bits, blocks), take("<u8", bits * blocks)
        self.doc_ids = [None if x else d for d, x in zip(known.tolist(), none.tolist(), strict=True)]
        self.starts = np.cumsum(self.lengths) - self.lengths
        first = head + packed + np.cumsum(sizes) - sizes

        def fetch(plane: int, block: int) -> bytes:
            k = plane * blocks + block
            used = -(-max(1, min(block_bits, n - block * block_bits)) // 64) * 8
            return bytes(_codec().decompress(file.read_at(int(sizes[k]), int(first[k])), used))

        self.matrix = WaveletMatrix(Planes(n, zeros, ones, block_bits, fetch))


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def write_shards(docs: DataFrame, tokenizer: str, end: int = END, shard_tokens: int = SHARD_TOKENS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Write the files; the manifest (MANIFEST, folder, base: ids in all files before) has a row for each."""
    spark = docs.sparkSession
    folder = scratch(spark, "shards")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(tokenizer)
        for batch in batches:
            for first, ids, offsets in encode_column(bpe, batch.column("text")):
                n = len(offsets) - 1
                flat = np.insert(ids, offsets[1:], end)
                if flat.max(initial=0) >= 1 << BITS:
                    raise ValueError(f"ids must be below {1 << BITS}")
                at = (2 * (offsets + np.arange(n + 1))).astype(np.int64)
                own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.astype("<u2").tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, n) for c in ("bucket", "key", "tie", "doc_id")), own], names=["bucket", "key", "tie", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        now, shard, names, held, size = None, 0, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal shard, names, held, size
            if names:
                path = f"{top}/{uuid.uuid4().hex}.wm"
                flat = np.frombuffer(b"".join(held), dtype="<u2")
                with store.open_output_stream(path) as f:
                    f.write(file_bytes(flat, names, [len(x) // 2 for x in held], block_bits=block_bits))
                yield _batch([[now], [shard], [path], [len(flat)], [len(names)]], MANIFEST)
                shard, names, held, size = shard + 1, [], [], 0

        for batch in batches:
            for bucket, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids")), strict=True):
                if bucket != now or size >= 2 * shard_tokens:
                    yield from close()
                    shard = shard if bucket == now else 0
                    now = bucket
                names.append(doc)
                held.append(ids)
                size += len(ids)
        yield from close()

    in_small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    parts = shuffle_partitions(spark)
    dealt = own.withColumn("bucket", bucket_of(own.select("key", "tie"), ["key", "tie"], 2 * parts).cast("int"))
    encoded = dealt.select("bucket", "key", "tie", "doc_id", "text").mapInArrow(trimmed(encode), "bucket int, key long, tie long, doc_id long, ids binary")
    placed = encoded.repartition(parts, "bucket").sortWithinPartitions("bucket", "key", "tie", "doc_id")
    manifest = stored(placed.mapInArrow(trimmed(write), MANIFEST), "shards", wave=False)
    totals = manifest.groupBy("bucket").agg(F.sum("n_tokens").alias("size"))  # a row for each range
    lead = totals.select("bucket", F.coalesce(F.sum("size").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("lead"))
    line = W.partitionBy("bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    inside = manifest.withColumn("inside", F.coalesce(F.sum("n_tokens").over(line), F.lit(0)))
    return inside.join(lead, "bucket").withColumn("base", F.col("lead") + F.col("inside")).drop("lead", "inside").withColumn("folder", F.lit(folder))


def _spread(shards: DataFrame) -> DataFrame:
    """A task for every few files, whatever their number."""
    spark = shards.sparkSession
    return shards.select("path", "base").repartition(max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark)), "path")


def _opened(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard]]:
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for path, base in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
            with store.open_input_file(path) as f:
                yield base, Shard(f)


def read_documents(shards: DataFrame, folder: str, end: int = END) -> DataFrame:
    """Of each document in the files: its place, its ids' number and checksum, and how many of them are the end id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, shard in _opened(folder, batches):
            ids = shard.matrix.all().astype("<u4")
            ends = np.append(shard.starts, shard.matrix.n)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            counts = np.diff(shard.matrix.count(end, ends))
            yield _batch([shard.doc_ids, shard.starts + base, shard.lengths, crc, counts, [base] * len(crc)], DOCUMENTS)

    return _spread(shards).mapInArrow(trimmed(read), DOCUMENTS)


def token_places(shards: DataFrame, folder: str, tokens: list[int]) -> DataFrame:
    """token, doc_id, place (in all files) of each occurrence of these tokens, found by select."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, shard in _opened(folder, batches):
            for token in tokens:
                at = shard.matrix.places(token)
                owner = np.searchsorted(shard.starts, at, side="right") - 1
                yield _batch([[token] * len(at), [shard.doc_ids[o] for o in owner.tolist()], at + base], "token long, doc_id long, place long")

    return _spread(shards).mapInArrow(trimmed(find), "token long, doc_id long, place long")


def tokens_at(shards: DataFrame, folder: str, places: list[int]) -> DataFrame:
    """place, token at these places (of all files), found by rank; files without one read their directory alone."""
    asked = np.array(sorted(places), dtype=np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, shard in _opened(folder, batches):
            own = asked[(asked >= base) & (asked < base + shard.matrix.n)]
            yield _batch([own, shard.matrix.access(own - base)], "place long, token long")

    return _spread(shards).mapInArrow(trimmed(find), "place long, token long")

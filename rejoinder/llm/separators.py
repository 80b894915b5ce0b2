"""Token counts of documents in flat token files, which hold ids end to end and no index.

``write_streams`` tokenises documents into flat little-endian uint16 files, each document followed by the end id, cut
into shards of a fixed size whatever documents they cut through. ``separator_scan`` finds the documents again from
nothing but the files: each block is searched for the end id with one vector comparison, and a prefix scan over the
blocks' summaries (separators so far, place of the last one) stitches documents that go over block and shard ends.

Files lie in the folder that the cluster shares. Their names hold a random part and only those in the written
manifest are read, so what a lost or repeated task left behind is ignored.

Defined cases: the string of a special token in a text is ordinary text, so only ends are end ids; a null text is empty and counts 0 tokens; a very long one may go over any
number of blocks and shards; an empty table gives no rows; rows with the same doc_id are
counted each for itself; extra columns are ignored; tokens after the last end id are reported as a last document without an end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.llm.shared import in_small_batches, scratch, stored, trimmed
from rejoinder.llm.word_bpe import encode_column, worker_bpe

END = 49407
SHARD_TOKENS = 1 << 24
BLOCK_TOKENS = 1 << 20
BLOCKS_A_TASK = 16
MANIFEST = "stream string, doc_id long, ordinal long, shard int, path string, n_tokens long"


def write_streams(docs: DataFrame, tokenizer: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the flat files; the manifest has a row per document (its place in its stream) and one per shard."""
    folder = scratch(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        bpe, stream, ordinal, shard, held, size = worker_bpe(tokenizer, False), uuid.uuid4().hex, 0, 0, [], 0
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)

        def rows(*columns) -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

        def flush(all_: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, shard
            while size >= shard_tokens or (all_ and size):
                joined = np.concatenate(held)
                own, rest = joined[:shard_tokens], joined[shard_tokens:]
                path = f"{top}/{stream}-{shard:06d}.bin"
                with store.open_output_stream(path) as f:
                    f.write(own.tobytes())
                yield rows([stream], [None], [None], [shard], [path], [len(own)])
                held, size, shard = [rest] if len(rest) else [], len(rest), shard + 1

        for batch in batches:
            n = batch.num_rows
            if n:
                yield rows([stream] * n, batch.column(0), np.arange(ordinal, ordinal + n), [None] * n, [None] * n, [None] * n)
                ordinal += n
            for _, ids, offsets in encode_column(bpe, batch.column(1)):
                flat = np.insert(ids, offsets[1:], end).astype("<u2")
                held.append(flat)
                size += len(flat)
                yield from flush(False)
        yield from flush(True)

    in_small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(own.mapInArrow(trimmed(write), MANIFEST), "manifest").withColumn("folder", F.lit(folder))


def separator_scan(shards: DataFrame, folder: str, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of flat files. shards: stream, shard (their order), path, n_tokens.

    Returns stream, ordinal, start (in tokens from the stream's begin), n_tokens, ended.
    """
    blocks = shards.select("stream", "shard", "path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("n_tokens") - 1), F.lit(block_tokens).cast("long"))).alias("at"), "n_tokens")
    found_type = "stream string, shard int, at long, size long, separators array<int>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for stream, shard, path, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as f:
                    tokens = np.frombuffer(f.read_at(2 * min(block_tokens, n - at), 2 * at), dtype="<u2")
                places = np.flatnonzero(tokens == end).astype(np.int32)
                arrays = [pa.array([stream]), pa.array([shard], pa.int32()), pa.array([at], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([places], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["stream", "shard", "at", "size", "separators"])

    tasks = max(shards.sparkSession.sparkContext.defaultParallelism, -(-blocks.count() // BLOCKS_A_TASK))  # a number, or small rows would be put together
    found = blocks.repartition(tasks, "stream", "shard", "at").mapInArrow(trimmed(search), found_type)
    order = W.partitionBy("stream").orderBy("shard", "at")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    scanned = (
        found.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("ordinal0", F.coalesce(F.sum(F.size("separators")).over(before), F.lit(0)))
        .withColumn("last", F.when(F.size("separators") > 0, F.col("base") + F.element_at("separators", -1)))
        .withColumn("carry", F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)))
        .withColumn("final", F.row_number().over(W.partitionBy("stream").orderBy(F.desc("shard"), F.desc("at"))) == 1)
    )
    ended = scanned.select("stream", "base", "ordinal0", "carry", "separators", F.posexplode("separators").alias("k", "place")).select(
        "stream",
        (F.col("ordinal0") + F.col("k")).alias("ordinal"),
        (F.when(F.col("k") > 0, F.col("base") + F.get("separators", F.col("k") - 1)).otherwise(F.col("carry")) + 1).alias("start"),
        (F.col("base") + F.col("place")).alias("stop"),
    ).select("stream", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    stop, last = F.col("base") + F.col("size"), F.coalesce("last", "carry")
    tail = scanned.filter(F.col("final") & (stop > last + 1)).select("stream", (F.col("ordinal0") + F.size("separators")).alias("ordinal"), (last + 1).alias("start"), (stop - last - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(tail)


def document_token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per document: its stream and place there, and the tokens that the scan counted."""
    manifest = write_streams(docs, tokenizer, shard_tokens=shard_tokens)
    first = manifest.select("folder").first()
    if first is None:
        return spark.createDataFrame([], "doc_id long, stream string, ordinal long, start long, n_tokens long")
    shards = manifest.filter(F.col("path").isNotNull()).select("stream", "shard", "path", "n_tokens")
    counted = separator_scan(shards, first[0], block_tokens=block_tokens)
    names = manifest.filter(F.col("path").isNull()).select("stream", "ordinal", "doc_id")
    return names.hint("merge").join(counted, ["stream", "ordinal"]).select("doc_id", "stream", "ordinal", "start", "n_tokens")

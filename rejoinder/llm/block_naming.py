"""Exact duplicates by deterministic block naming.

Each text's bytes are cut into fixed-size blocks. Equal blocks get equal integer names from their place in sorted
order, then adjacent pairs of names are named in turn until one name is left for each document. Names come from
comparing contents, never from a hash of them, so two documents have one identity only if their bytes are equal.

Blocks are dealt by hash and sorted within each task, which names them by their rank there. A block with more rows
than half a task's share is dealt over several tasks; each of these names it by itself and the names, known by the
block's bytes, are brought together afterwards. At most two such blocks for each shuffle partition and block of a
mean document can exist, as their rows alone would else exceed all rows: that bounds what is broadcast.

Defined cases: a null text is empty; the kept row of a group is that with the smallest doc_id (a null doc_id comes
last), and of rows that repeat this doc_id exactly one; a very long text is many blocks, which are dealt like any
others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.shared import in_small_batches, shuffle_partitions, stored, trimmed

BLOCK = 8192
#: Runs of these become one space: tab to carriage return, and space.
SPACES = r"[\x20\x09-\x0D]+"
NAMED = "row long, doc_id long, n_blocks long, i long, sha string, name long, hot binary"


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES, " ")


def _blocks(docs: DataFrame, block: int, with_sha: bool) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.encode(normalised(F.col("text").cast("string")), "utf-8").alias("bytes"))
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.length("bytes") / F.lit(block)))
    columns = [F.sha2("bytes", 256).alias("sha")] if with_sha else []
    own = own.select("row", "doc_id", "bytes", n.alias("n_blocks"), *columns)
    cut = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("i"))
    return cut.select("row", "doc_id", "n_blocks", "i", *(["sha"] if with_sha else []), F.expr(f"substring(bytes, cast(i * {block} + 1 as int), {block})").alias("block"))


def _name_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank of each block among those of this task, which come sorted. Columns: row .. sha, key, hot, block."""
    from pyspark import TaskContext

    name, last = (TaskContext.get().partitionId() << 40) - 1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, hot = batch.column("block"), batch.column("hot")
        new = np.ones(len(blocks), dtype=bool)
        new[1:] = np.asarray(pc.not_equal(blocks[1:], blocks[:-1]))
        new[0] = last is None or blocks[0].as_py() != last
        last = blocks[-1].as_py()
        names = name + np.cumsum(new)
        name = int(names[-1])
        shown = pc.if_else(pc.and_(hot, pa.array(new)), blocks, pa.scalar(None, blocks.type))
        columns = [batch.column(c) for c in ("row", "doc_id", "n_blocks", "i", "sha")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(names), shown], names=[c.split()[0] for c in NAMED.split(", ")])


def block_names(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per block: row, doc_id, n_blocks, i, sha (of the whole normalised text, with block 0), name."""
    spark = docs.sparkSession
    in_small_batches(spark)
    parts = shuffle_partitions(spark)
    counts = _blocks(docs, block, False).groupBy(F.xxhash64("block").alias("key")).agg(F.count("*").alias("n"))
    counts = stored(counts.filter("n > 1"), "blockcounts")
    total = docs.count()
    hot = counts.filter(F.col("n") > F.lit(max(16, total / (2 * parts)))).select("key", F.ceil(F.col("n") * 4 * parts / F.lit(max(1, total))).cast("int").alias("salts"))
    dealt = _blocks(docs, block, True).withColumn("key", F.xxhash64("block")).join(F.broadcast(hot), "key", "left")
    dealt = dealt.withColumn("hot", F.col("salts").isNotNull())
    salt = F.when(F.col("hot"), F.pmod(F.hash("row"), F.col("salts"))).otherwise(F.lit(0))
    dealt = dealt.withColumn("sha", F.when(F.col("i") == 0, F.col("sha"))).withColumn("salt", salt)
    task = dealt.repartition(parts, "key", "salt").sortWithinPartitions("block")
    named = stored(task.select("row", "doc_id", "n_blocks", "i", "sha", "hot", "block").mapInArrow(trimmed(_name_sorted), NAMED), "blocknames")
    shown = named.filter(F.col("hot").isNotNull()).select("name", F.col("hot").alias("block"))
    first = shown.groupBy("block").agg(F.min("name").alias("common"))
    same = shown.join(first, "block").filter(F.col("name") != F.col("common")).select("name", "common")
    return named.drop("hot").join(F.broadcast(same), "name", "left").withColumn("name", F.coalesce("common", "name")).drop("common")


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per document: row, doc_id, sha, n_blocks, name. (n_blocks, name) is its collision-free identity."""
    names = stored(block_names(docs, block), "names")
    heads = names.filter("i = 0").select("row", "doc_id", "sha", "n_blocks", "name")
    level = names.filter("n_blocks > 1").select("row", "i", "n_blocks", "name")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    done, met = heads.filter("n_blocks = 1").select("row", "name"), 1
    while met < most:
        half = F.floor(F.col("i") / 2)
        pairs = level.groupBy("row", half.alias("i"), "n_blocks").agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b"))
        pairs = stored(pairs, "pairs", wave=True)
        given = stored(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()), "pairnames", wave=True)
        level, met = stored(pairs.join(given, ["a", "b"]).select("row", "i", "n_blocks", "name"), "level", wave=True), 2 * met
        # a document is done at the depth of its own blocks; names of one depth are told apart by n_blocks from others
        done, level = done.unionByName(level.filter(F.col("n_blocks") <= met).select("row", "name")), level.filter(F.col("n_blocks") > met)
    return heads.drop("name").join(done, "row")


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per document: row, doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    own = stored(identities(docs, block), "identities")
    groups = own.groupBy("n_blocks", "name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count("*").alias("group_size"))
    groups = stored(groups.filter("group_size > 1"), "groups")
    joined = own.join(groups, ["n_blocks", "name"], "left")
    alone = F.col("first").isNull()
    return joined.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )

"""What the operators of this subpackage share: scratch tables, stable row keys and bounded batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that one vectorised step handles at most (a longer text is handled alone).
CHUNK_CHARS = 1 << 18
#: Bytes of rows that go to a Python worker at once; a longer row goes alone.
BATCH_BYTES = 4 << 20
#: What functions of this subpackage keep between tasks of a worker, emptied when a task ends.
CACHES: list[dict] = []
LIBC = ctypes.CDLL(None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's spark.checkpoint.dir. Where none is configured, a local session (whose executors share
    the driver's disk) takes one below /tmp, and any other raises an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, wave: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and survives lost executors.

    wave: for tables of numbers only, which are small beside the texts: write them in fewer files, 16 shuffle
    partitions to a task, but as many as there are cores at least.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.coalesce(max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark) // 16)) if wave else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of scratch that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def in_small_batches(spark: SparkSession) -> None:
    """Have the session's Arrow batches hold at most BATCH_BYTES, whatever the length of texts: JVM and worker each hold one.

    It lasts for the session, since operators are lazy; a smaller bound that is set already stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Have the JVM collect its garbage, so that the shuffle files of steps that are over are removed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind as make it differ from all columns and the others."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def trim() -> None:
    """Give memory that this worker has freed back to the system: a worker outlives its tasks, and so would its peak."""
    pa.default_memory_pool().release_unused()
    for have in CACHES:
        have.clear()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, with ``trim`` when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trim()

    run.__name__ = work.__name__  # as plans show it
    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(column: pa.Array, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about ``most`` bytes of text each; a longer text gets a range of its own."""
    if len(column) == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    yield first, len(sizes)


POWERS: dict[int, np.ndarray] = {}
CACHES.append(POWERS)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept until the task ends, up to 4 MB a base."""
    have = POWERS
    got = have.get(base)
    if got is None or len(got) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if size <= 1 << 19:
            have[base] = got
    return got[:n]


#: An odd number and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each values[start:end], from one prefix sum."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(n, BASE), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(n + 1, INVERSE)[starts]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit, one to one."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h

"""Codes of vectors by product quantisation, whose codebooks come from Lloyd's rounds with Elkan's bounds.

Components become whole numbers, so every distance, mean and tie is exact. A vector is cut into ``PARTS`` consecutive
parts; each part position has a codebook of ``ENTRIES`` entries. Each round writes a table that holds, for each vector
and part, the nearest entry, an upper bound of the distance to it and a lower bound of the distance to every entry. The
next round shifts the bounds by how far entries have moved and leaves out an entry only where it is strictly farther:
its lower bound, or half its distance from the own entry, exceeds the upper bound. What is left is measured in whole
numbers, ties go to the lower index. Sums for the means are added up in each task before they are shuffled.

The driver holds the codebooks (ENTRIES x dimension numbers) and never vectors beyond the first ENTRIES. A round's table
replaces the one before the last; each can be made again from the one before it, so a lost executor costs its tasks only.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; with fewer than ENTRIES
vectors a codebook has as many entries as there are vectors; rows that repeat a vec_id are vectors of their own, ordered
by their components among the seeds; null vec_ids come last; an empty table gives no rows; a vector without components
has code 0 and error 0; extra columns are ignored, whatever their names. Vectors of different lengths, lengths that
PARTS doesn't divide and components of more than MOST (1024 before scaling) raise a ValueError: they have no whole
distances in 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from rejoinder.llm.shared import discard, in_small_batches, scratch, trimmed

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest whole component; sums of squares then stay exact in the float64 products below.
MOST = 1 << 20
#: Lower bounds are kept in 16 bits, rounded down, so a larger one is kept as this.
FARTHEST = (1 << 16) - 1
STATE = ["codes", "upper", "lower", "error", "measured"]


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (whole components) of the rows whose vector is whole."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    own = rows.select("vec_id", "label", x.alias("x")).filter(F.col("x").isNotNull())
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return own.filter(~F.coalesce(bad, F.lit(True))).select("vec_id", "label", F.transform("x", lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(MOST + 1)), F.lit(-MOST - 1)).cast("int")).alias("v"))


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole roots of whole squares (below 2**52), rounded down and up."""
    down = np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    return down, down + (down * down < squares)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all entries; whole, as all terms are below 2**53."""
    a, b = x.astype(np.float64), entries.astype(np.float64)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def first_bounds(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry, upper bound and lower bounds, from all distances."""
    d = squares(x, entries)
    near = d.argmin(1)  # the first of equal ones
    return near, _roots(d[np.arange(len(x)), near])[1], np.minimum(_roots(d)[0], FARTHEST)


class Round:
    """What a round knows of one part's entries: where they are, how far they have moved and how far apart they are."""

    def __init__(self, entries: np.ndarray, before: np.ndarray):
        self.entries = entries
        self.moved = _roots(((entries - before) ** 2).sum(1))[1]
        self.apart = _roots(squares(entries, entries))[0]
        others = self.apart + np.diag(np.full(len(entries), np.iinfo(np.int64).max // 4))
        self.nearest = others.min(1) if len(entries) else np.zeros(0, np.int64)

    def assign(self, x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The bounds after the move, the nearest entries, and how many distances were measured."""
        upper = upper + self.moved[near]
        lower = np.maximum(lower - self.moved[None, :], 0)
        rows = np.flatnonzero(2 * upper >= self.nearest[near])
        rows = rows[self._open(near[rows], upper[rows], lower[rows]).any(1)]
        if not len(rows):
            return near, upper, lower, 0
        near = near.copy()
        own = ((x[rows] - self.entries[near[rows]]) ** 2).sum(1)
        lower[rows, near[rows]], upper[rows] = np.minimum(_roots(own)[0], FARTHEST), _roots(own)[1]
        r, c = np.nonzero(self._open(near[rows], upper[rows], lower[rows]))
        d = ((x[rows[r]] - self.entries[c]) ** 2).sum(1)
        lower[rows[r], c] = np.minimum(_roots(d)[0], FARTHEST)
        if len(r):
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            best = np.minimum.reduceat(d * ENTRIES + c, first)  # of equal distances the lower index
            at = r[first]
            better = best < own[at] * ENTRIES + near[rows[at]]
            at, best = rows[at[better]], best[better]
            near[at], upper[at] = best % ENTRIES, _roots(best // ENTRIES)[1]
        return near, upper, lower, len(rows) + len(r)

    def _open(self, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Entries that may be as near as the own one."""
        may = (upper[:, None] >= lower) & (2 * upper[:, None] >= self.apart[near])
        may[np.arange(len(near)), near] = False
        return may


def moved_entries(entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means rounded down of the entries that have vectors; the others stay."""
    used = counts > 0
    out = entries.copy()
    out[used] = sums[used] // counts[used][:, None]
    return out


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _assigned(state: DataFrame, entries: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The state after one assignment: vec_id, label, v, codes, upper, lower, error, measured."""
    parts, n_entries, width = entries.shape
    lower_kind = "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = None if before is None else [Round(entries[p], before[p]) for p in range(parts)]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("v"), "<i4", parts * width).astype(np.int64).reshape(n, parts, width)
            near, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64), np.zeros((n, parts, n_entries), lower_kind)
            error, measured = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if rounds:
                was = _matrix(batch.column("codes"), "u1", parts).astype(np.int64)
                over = _matrix(batch.column("upper"), "<i8", parts)
                under = _matrix(batch.column("lower"), lower_kind, parts * n_entries).reshape(n, parts, n_entries)
            for p in range(parts):
                if rounds:
                    a, u, below, done = rounds[p].assign(x[:, p], was[:, p], over[:, p], under[:, p].astype(np.int64))
                    measured[0] += done
                else:
                    a, u, below = first_bounds(x[:, p], entries[p])
                    measured += n_entries
                near[:, p], upper[:, p], lower[:, p] = a, u, below
                error += ((x[:, p] - entries[p][a]) ** 2).sum(1)
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("v"), _binary(near), _binary(upper.astype("<i8")), _binary(lower.reshape(n, -1)), pa.array(error), pa.array(measured)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", *STATE])

    types = [StructField(c, BinaryType() if c in STATE[:3] else LongType()) for c in STATE]
    return state.mapInArrow(trimmed(run), StructType([*state.select("vec_id", "label", "v").schema, *types]))


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of each part's entries: a row for each from each task, then added up."""
    parts, n_entries, width = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * n_entries, width), np.int64), np.zeros(parts * n_entries, np.int64)
        for batch in batches:
            n = batch.num_rows
            x = _matrix(batch.column("v"), "<i4", parts * width).astype(np.int64).reshape(n * parts, width)
            slot = (_matrix(batch.column("codes"), "u1", parts).astype(np.int64) + np.arange(parts) * n_entries).ravel()
            np.add.at(sums, slot, x)
            counts += np.bincount(slot, minlength=len(counts))
        used = np.flatnonzero(counts)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), rows], names=["slot", "n", "s"])

    each = state.select("v", "codes").mapInArrow(trimmed(add), "slot long, n long, s array<long>")
    got = each.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)]).collect()  # parts * entries rows
    sums, counts = np.zeros((parts * n_entries, width), np.int64), np.zeros(parts * n_entries, np.int64)
    for r in got:
        counts[r["slot"]], sums[r["slot"]] = r["n"], list(r)[2:]
    return sums.reshape(shape), counts.reshape(parts, n_entries)


def seeds(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The first codebooks: the parts of the vectors with the smallest vec_ids. parts x entries x width."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # at most ENTRIES rows
    if not first:
        return None
    return np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()


def checked(rows: DataFrame, parts: int) -> None:
    """Raise where vectors have no whole distances: lengths that differ or don't divide, components beyond MOST."""
    size = F.size("v")
    least, most, top = rows.agg(F.min(size), F.max(size), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()
    if least is not None and (least != most or least % parts or (top or 0) > MOST or least // parts > 1 << 10):
        raise ValueError(f"vectors need one length that {parts} divides and components of at most {MOST}; lengths {least} to {most}, largest component {top}")


def vector_codes(spark: SparkSession, rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, codes, error and measured (distances, by batch) of whole_vectors' rows, and the final codebooks."""
    in_small_batches(spark)
    top = scratch(spark, "codes")
    rows.write.parquet(f"{top}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{top}/rows")
    checked(rows, parts)
    book = seeds(rows, parts, entries)
    kept = StructType([*rows.select("vec_id", "label").schema, StructField("v", BinaryType())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(flat.reshape(batch.num_rows, book.shape[0] * book.shape[2]))], names=["vec_id", "label", "v"])

    if book is None:
        empty = StructType([*rows.select("vec_id", "label").schema, StructField("codes", BinaryType()), StructField("error", LongType()), StructField("measured", LongType())])
        return spark.createDataFrame([], empty), None
    state, before = rows.mapInArrow(packed, kept), None
    for k in range(rounds + 1):
        assigned = _assigned(state, book, before)
        assigned.write.parquet(f"{top}/{k}")
        state = spark.read.schema(assigned.schema).parquet(f"{top}/{k}")
        if k > 1:
            discard(spark, f"{top}/{k - 2}")
        if k < rounds:
            sums, counts = _sums(state, book.shape)
            before, book = book, np.array([moved_entries(book[p], sums[p], counts[p]) for p in range(len(book))])
    return state.select("vec_id", "label", "codes", "error", "measured"), book


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: the errors summed over rows of the same label, nulls together."""
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def codebook_text(book: np.ndarray | None) -> str:
    """All entries' components by part, entry and place, comma-separated."""
    return "" if book is None else ",".join(map(str, book.ravel().tolist()))


def codebook_sha256(book: np.ndarray | None) -> str:
    return hashlib.sha256(codebook_text(book).encode()).hexdigest()

"""Best-fit packing of token sequences with certified bin counts.

``tokenised_pieces`` turns documents into pieces of at most ``capacity`` tokens; ``pack`` places pieces in bins.
Packing deals pieces to parts of bounded size by hash, packs each part by best-fit decreasing and bounds its bin
count from below by dual feasible functions. Parts whose count exceeds their bound have a gap: the bins of theirs that
aren't full, and every other part's emptiest bins, are exchanged. Groups of parts, dealt by hash anew each round, put
these bins' pieces together and pack them again, and each group for itself takes its new placement, as a part of its
own, if that needs fewer bins. Rounds go on until all bins are as few as the bound of all pieces, or PATIENCE rounds in
a row gain nothing; each one's placement is a written table, and no step gathers more than one part, or a group of the
few parts whose numbers hash alike.

Every part that is left is certified as it then is: the number of its bins, and the count that no packing of its
pieces can go below. The same is told of all pieces together, from the counts of their lengths.

Defined cases: a null text is empty and gives one piece, the end token; a very long text is tokenised in segments that
end at white space and cut into pieces; pieces of equal length are placed in order of row and piece; an empty table
gives no rows; rows with the same doc_id are packed each for itself; extra columns are ignored; a null doc_id is kept
as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.shared import in_small_batches, stored, trimmed
from rejoinder.llm.word_bpe import encode_column, worker_bpe
from rejoinder.operators.ranges import running

CAPACITY = 4096
END = 1
#: Pieces that one task packs, on average.
PART = 4_000
#: Rounds in a row without a gain after which exchanges end. Each round deals parts anew.
PATIENCE = 2
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", part long, bin long, offset long, free long"
CERTIFIED = "part long, part_bins long, part_bound long, most_free long, bin_numbers long"


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece: a document's ids, then ``end``, cut only if longer than capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(tokenizer)
        for batch in batches:
            doc, row = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for first, ids, offsets in encode_column(bpe, batch.column(2)):
                for i in range(len(offsets) - 1):
                    own = np.append(ids[offsets[i] : offsets[i + 1]].astype("<u4"), np.uint32(end))
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        out.append((doc[first + i], row[first + i], k, at, len(part), zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    in_small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(trimmed(cut), PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and each bin's free room. Longest first, each into the fullest bin it fits.

    Bins with equal room are interchangeable, so open bins are kept in stacks by room and a bit mask tells which
    stacks hold any: an item costs two steps, whatever the number of bins.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    mask = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        room -= n
        free[b] = room
        if room:
            stacks[room].append(b)
            mask |= 1 << room
    return bins, offsets, np.array(free, dtype=np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """bound_of_counts of these lengths."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1], capacity) if len(lengths) else 0


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound of three families of dual feasible functions; no packing needs fewer bins.

    The identity; for each k, items over capacity - k count 1 and those below k count 0; for each q, the rounding
    x -> x if (q + 1) x is a multiple of the capacity, else floor((q + 1) x / capacity) / q. count: by length.
    """
    count = count.astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    items, tokens = np.cumsum(count), np.cumsum(count * size)
    k = np.arange(1, capacity // 2 + 1)
    large = items[capacity] - items[capacity - k]
    middle = tokens[capacity - k] - tokens[k - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for q in range(1, 33):
        exact = (q + 1) * size % capacity == 0
        scaled = np.where(exact, q * size, (q + 1) * size // capacity * capacity)  # times q * capacity
        best = max(best, -(-int((count * scaled).sum()) // (q * capacity)))
    return best


COLUMNS = [c.split()[0] for c in PLACED.split(", ")]


def _packed(pieces: pd.DataFrame, part: int, capacity: int) -> pd.DataFrame:
    pieces = pieces.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable")
    bins, offsets, free = best_fit_decreasing(pieces["length"].to_numpy(), capacity)
    return pieces.assign(part=part, bin=bins, offset=offsets, free=free[bins])[COLUMNS]


def certificates(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """CERTIFIED of each part of a placement: its bins, their lower bound, the room in its emptiest bin, numbers to its highest bin's."""

    def certify(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [own["part"].iloc[0]], "part_bins": [own["bin"].nunique()], "part_bound": [lower_bound(own["length"].to_numpy(), capacity)], "most_free": [own["free"].max()], "bin_numbers": [own["bin"].max() + 1]})

    return placed.select("part", "bin", "length", "free").groupBy("part").applyInPandas(certify, CERTIFIED)


def _exchanged(open_: DataFrame, groups: int, round_: int, capacity: int) -> DataFrame:
    """Open bins' pieces, packed anew by groups of parts where that takes fewer bins, else as they were."""

    def exchange(own: pd.DataFrame) -> pd.DataFrame:
        old, group = len(own[["part", "bin"]].drop_duplicates()), int(own["group"].iloc[0])
        new = _packed(own, (round_ << 40) + group, capacity)
        return new if new["bin"].nunique() < old else own[COLUMNS]

    dealt = open_.withColumn("group", F.pmod(F.xxhash64("part", F.lit(round_)), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(exchange, PLACED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_size: int = PART) -> DataFrame:
    """Place pieces (PIECES; each length from 1 to capacity) in bins.

    Adds sequence_id, offset, part; part_bins and part_bound of that part, total_bins and total_bound of all pieces:
    the bins, and the count that no packing of these pieces can go below.
    """
    pieces = stored(pieces, "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").agg(F.count("*")).collect():  # at most a row for each length
        counts[length] = n
    total, parts = bound_of_counts(counts, capacity) if counts.any() else 0, max(1, -(-int(counts.sum()) // part_size))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)))
    first = dealt.groupBy("part").applyInPandas(lambda p: _packed(p, int(p["part"].iloc[0]), capacity), PLACED)
    current, round_, least, idle = stored(first, "packed"), 0, None, 0
    while True:
        known = stored(certificates(current, capacity), "certificates", wave=True)
        bins, n_parts = known.agg(F.sum("part_bins"), F.count("*")).first()
        idle = 0 if least is None or bins < least else idle + 1
        if n_parts <= 1 or bins <= total or idle >= PATIENCE:  # none to exchange with, the fewest there can be, or no gain
            break
        least, round_ = bins, round_ + 1
        judged = current.join(known, "part")
        gives = (F.col("free") > 0) & ((F.col("part_bins") > F.col("part_bound")) | (F.col("free") == F.col("most_free")))
        n_open = judged.filter(gives).count()
        if not n_open:
            break
        again = _exchanged(judged.filter(gives).select(*COLUMNS), -(-n_open // part_size), round_, capacity)
        current = stored(judged.filter(~gives).select(*COLUMNS).unionByName(again), "packed")
    # each part's numbers follow those of the parts before, whatever the round that made it
    numbered = running(known, ["part"], "bin_numbers", name="first_bin")
    placed = current.join(numbered.drop("most_free", "bin_numbers"), "part")
    return placed.withColumns({"sequence_id": F.col("first_bin") + F.col("bin"), "total_bins": F.lit(bins or 0).cast("long"), "total_bound": F.lit(total).cast("long")}).drop("bin", "free", "first_bin")

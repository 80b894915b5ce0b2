"""One huge JSON object of objects, read by many tasks.

The file is read as text that is split behind each ``}``, so Spark cuts it into splits like any text. What a byte means
depends on all bytes before it: whether it stands in a string, and how deep. Two passes find that out:

1. each split is summarised for both ways it may begin (in a string or not): whether it ends in one, how much deeper it
   ends, and how many commas stand outside strings at each depth;
2. the summaries, a row a split, are composed in order of the file, which gives every split its true begin: in a string
   or not, depth, and number of records before;
3. each split is read again from its true begin and cut at the commas of depth 1. Records that lie in one split are
   whole; pieces of those that go over its ends are put together by their number.

A split is handled in steps, so a task's memory is that of an Arrow batch and of the longest record. A split behind ``}``
never begins inside an escape. Bytes after the object's end are ignored; an empty object has no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = "path string, block long, ends0 int, ends1 int, deeper0 long, deeper1 long, depths0 array<long>, depths1 array<long>, commas0 array<long>, commas1 array<long>"
BEGINS = "path string, block long, inside int, depth long, records long"
PIECES = "path string, number long, block long, whole boolean, record string"
QUOTE, ESCAPE, COMMA, OPEN, CLOSE = 34, 92, 44, (123, 91), (125, 93)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text behind each } with the split it is of; a split's rows follow each other."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[str, int, bytes]]:
    """The bytes of each split's rows in this batch."""
    path, block, value = (batch.column(i) for i in range(3))
    paths, blocks = path.to_pylist(), block.to_pylist()
    first = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or (paths[i], blocks[i]) != (paths[first], blocks[first]):
            yield paths[first], blocks[first], b"}".join([*value.slice(first, i - first).cast(pa.binary()).to_pylist(), b""])
            first = i


def automaton(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes that begin outside an escape: the bytes, whether a string's quotes before and at each are odd, steps of depth."""
    raw = np.frombuffer(data, dtype=np.uint8)
    quote = raw == QUOTE
    back = raw == ESCAPE
    if back.any():  # a quote behind an odd run of backslashes is a letter
        other = np.maximum.accumulate(np.where(back, -1, np.arange(len(raw))))
        at = np.flatnonzero(quote)
        run = np.where(at > 0, at - 1 - other[np.maximum(at - 1, 0)], 0)
        quote[at[run % 2 == 1]] = False
    odd = (np.cumsum(quote) & 1).astype(bool)
    return raw, odd, np.isin(raw, OPEN).astype(np.int64) - np.isin(raw, CLOSE)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None

    def done():
        ends, deeper, commas = state
        depths = [sorted(c) for c in commas]
        columns = [[now[0]], [now[1]], *([e] for e in ends), *([d] for d in deeper), *([d] for d in depths), *([[commas[s][d] for d in depths[s]]] for s in (0, 1))]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in SUMMARY.split(", ")])

    for batch in batches:
        for path, block, data in _steps(batch):
            if (path, block) != now:
                if now is not None:
                    yield done()
                now, state = (path, block), ([0, 1], [0, 0], ({}, {}))
            raw, odd, step = automaton(data)
            ends, deeper, commas = state
            for s in (0, 1):
                outside = ~odd if ends[s] == 0 else odd
                depth = np.cumsum(np.where(outside, step, 0)) + deeper[s]
                at, n = np.unique(depth[outside & (raw == COMMA)], return_counts=True)
                for d, k in zip(at.tolist(), n.tolist(), strict=True):
                    commas[s][d] = commas[s].get(d, 0) + k
                ends[s], deeper[s] = int(ends[s] ^ bool(odd[-1])), int(depth[-1])
    if now is not None:
        yield done()


def _composed(own: pd.DataFrame) -> pd.DataFrame:
    """The true begin of each split of a file, from all summaries before it."""
    out, inside, depth, records = [], 0, 0, 0
    for r in own.sort_values("block").to_dict("records"):
        out.append((r["path"], r["block"], inside, depth, records))
        commas = dict(zip(r[f"depths{inside}"], r[f"commas{inside}"], strict=True))
        records += int(commas.get(1 - depth, 0))
        inside, depth = r[f"ends{inside}"], depth + r[f"deeper{inside}"]
    return pd.DataFrame(out, columns=[c.split()[0] for c in BEGINS.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of splits; columns: path, block, value, then inside, depth and records at the split's begin."""
    now, held, out = None, [], []
    inside = depth = number = 0
    open_ = over = False  # whether the record that is held began in this split; whether the object is over

    def rows():
        nonlocal out
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    def rest():
        if now is not None and not over and held:
            out.append((now[0], number, now[1], False, b"".join(held).decode()))

    for batch in batches:
        begins = {(p, b): (i, d, r) for p, b, i, d, r in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True)}
        for path, block, data in _steps(batch):
            if (path, block) != now:
                rest()
                now, held, open_ = (path, block), [], False
                inside, depth, number = begins[path, block]
                over = depth == 0 and number > 0
            if over:
                continue
            raw, odd, step = automaton(data)
            outside = ~odd if inside == 0 else odd
            line = np.cumsum(np.where(outside, step, 0)) + depth
            cuts = np.flatnonzero(outside & (((raw == COMMA) & (line == 1)) | ((line == 1) & (step == 1)) | ((line == 0) & (step == -1))))
            at = 0
            for c in cuts.tolist():
                if step[c] == 1:  # the object begins
                    held, at, open_ = [], c + 1, True
                    continue
                held.append(data[at:c])
                out.append((path, number, block, open_, b"".join(held).decode()))
                held, at, open_ = [], c + 1, True
                if step[c] == -1:
                    over = True
                    break
                number += 1
            if not over:
                held.append(data[at:])
            inside, depth = int(inside ^ bool(odd[-1])), int(line[-1])
        if out:
            yield rows()
    rest()
    yield rows()


def records(spark: SparkSession, path: str) -> DataFrame:
    """The text '"key": value' of each member of the object in each file: path, number, record."""
    pieces = _pieces(spark, path)
    begins = pieces.mapInArrow(_summaries, SUMMARY).groupBy("path").applyInPandas(_composed, BEGINS)  # a row for each split
    given = {(r["path"], r["block"]): (r["inside"], r["depth"], r["records"]) for r in begins.collect()}
    known = spark.createDataFrame([(p, b, *v) for (p, b), v in given.items()], BEGINS)
    cut = pieces.join(F.broadcast(known), ["path", "block"]).select("path", "block", "value", "inside", "depth", "records").mapInArrow(_cut, PIECES)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda x: x["record"]), "")
    joined = cut.filter(~F.col("whole")).groupBy("path", "number").agg(parts.alias("record"))
    both = cut.filter("whole").select("path", "number", "record").unionByName(joined)
    return both.filter(F.trim(F.regexp_replace("record", r"[\n\r\t]", " ")) != "")


def keyed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object of objects as rows (id, meta). schema: map<string, struct<meta: ...>>."""
    member = F.from_json(F.concat(F.lit("{"), "record", F.lit("}")), schema)
    return records(spark, path).select(F.explode(member).alias("id", "v")).select("id", "v.meta")

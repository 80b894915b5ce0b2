"""Document fingerprints by winnowing.

Each k-gram of code points has a rolling hash; of every window of consecutive hashes the smallest one is chosen, the
rightmost of equal ones, and kept with its position. Two texts that share k + window - 1 code points in a row share
a chosen hash, and its positions tell where. A short text has a window that its first three quarters fill, so that it
shares a hash with the text whatever its last quarter is replaced by; from 4/3 k code points on (32 at k = 24) these
hold a k-gram, and below that an edited text may share none. One shorter than k gives the hash of the whole; an empty
text has the empty fingerprint. A smaller window chooses all that a larger one does, so texts of any length compare.

``next_documents`` pairs each document with the next one in doc_id order in one shuffle of the texts: rows go to
buckets of the key's range, the first row of each bucket also goes to the bucket before as its look-ahead, and each
bucket is read sorted, one row at a time. Bounds come from a sketch of the keys and are at most ``BUCKETS``.

Defined cases: a null text is empty; null doc_ids come first, rows with the same doc_id in the order of their texts;
the last document's next one is the first (itself if it is alone); an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.shared import BASE, INVERSE, in_small_batches, mixed, powers, shuffle_partitions, trimmed

K, WINDOW = 24, 16
BUCKETS = 4096
#: Code points hashed in one step; windows that go over its end are made in the next.
STEP = 1 << 20
HASH_BITS, PLACE_BITS = 40, 24


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-gram, rolled by a prefix sum."""
    n = len(points)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(n, BASE), out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * powers(n, INVERSE)[: n - k + 1])


def window_minima(values: np.ndarray, window: int) -> np.ndarray:
    """The smallest of each run of ``window`` values, by prefix minima and suffix minima of blocks."""
    n = len(values)
    if window == 1 or n == 0:
        return values
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, window)
    prefix = np.minimum.accumulate(grid, axis=1).ravel()
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - window + 1], prefix[window - 1 : n])


def window_of(n: int, k: int = K, window: int = WINDOW) -> int:
    """The window of a text of n code points: at most the k-grams of what is left of it when its last quarter goes."""
    return max(1, min(window, n - n // 4 - k + 1))


def winnow(text: str, k: int = K, window: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (HASH_BITS wide) and their positions, in order of position. window: window_of the text if none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    window = window or window_of(len(points), k)
    k = min(k, len(points))
    top = np.uint64((1 << PLACE_BITS) - 1)
    hashes, places, at = [], [], 0
    grams = len(points) - k + 1
    while True:
        stop = min(grams, at + STEP)
        h = gram_hashes(points[at : stop + k - 1], k) >> np.uint64(64 - HASH_BITS)
        # the place from the right in the low bits: of equal hashes the rightmost is the smallest
        ranked = (h << np.uint64(PLACE_BITS)) | (top - np.arange(len(h), dtype=np.uint64))
        least = window_minima(ranked, min(window, len(ranked)))
        chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
        hashes.append(chosen >> np.uint64(PLACE_BITS))
        places.append((top - (chosen & top)).astype(np.int64) + at)
        if stop == grams:
            break
        at = stop - window + 1
    h, p = np.concatenate(hashes), np.concatenate(places)
    keep = np.concatenate([[True], p[1:] > np.maximum.accumulate(p)[:-1]])
    return h[keep], p[keep]


def as_string(h: np.ndarray, p: np.ndarray) -> str:
    """hash@position of each choice, in hexadecimal."""
    return " ".join([f"{a:010x}@{b:x}" for a, b in zip(h.tolist(), p.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of chosen hashes; 1 of two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    a, b = np.unique(a), np.unique(b)
    met = len(np.intersect1d(a, b, assume_unique=True))
    return met / (len(a) + len(b) - met)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def next_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, ahead: sorted by bucket, ahead, doc_id, text within tasks; ahead rows end their bucket."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)
    n = min(BUCKETS, 4 * parts)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    found = own.select(key.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(found))
    # two steps: the coarse bounds tell which few of the fine ones to count
    step = 64
    coarse, fine = F.lit(cuts[::step]) if cuts else F.array().cast("array<long>"), F.lit(cuts) if cuts else F.array().cast("array<long>")
    block = F.greatest(F.lit(0), F.size(F.filter(coarse, lambda c: c <= key)) - 1) * step
    bucket = block + F.size(F.filter(F.slice(fine, block + 1, F.lit(step)), lambda c: c <= key))
    dealt = own.withColumn("bucket", bucket.cast("int")) if cuts else own.withColumn("bucket", F.lit(0))
    firsts = {r["bucket"]: (r["k"], r["t"]) for r in dealt.groupBy("bucket").agg(F.min(key).alias("k"), F.lit(0).alias("t")).collect()}  # at most BUCKETS rows
    order = sorted(firsts)
    if not order:
        return dealt.withColumn("ahead", F.lit(0))
    # rows that may be a bucket's first: those with its smallest key
    goes = {b: order[i - 1] for i, b in enumerate(order)}
    least = F.create_map(*[x for b in order for x in (F.lit(b), F.lit(firsts[b][0]))])
    to = F.create_map(*[x for b in order for x in (F.lit(b), F.lit(goes[b]))])
    leads = dealt.filter(key == F.element_at(least, F.col("bucket"))).groupBy("bucket").agg(F.min(F.struct(key.alias("k"), "text", "doc_id")).alias("x"))
    leads = leads.select(F.col("x.doc_id").alias("doc_id"), F.col("x.text").alias("text"), F.element_at(to, F.col("bucket")).alias("bucket"), F.lit(1).alias("ahead"))
    both = dealt.withColumn("ahead", F.lit(0)).unionByName(leads)
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", "doc_id", "text")


def fingerprints(docs: DataFrame, k: int = K, window: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness (OUT).

    The edited text has its last quarter replaced by as many of the first code points of the next document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        names = [c.split()[0] for c in OUT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def given(rows):
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                doc, text, bucket, ahead = (batch.column(c)[i].as_py() for c in range(4))
                own = winnow(text, k, window)
                if held is not None and held[2] == bucket:
                    n = len(held[1])
                    cut = n // 4
                    edited = held[1][: n - cut] + text[:cut]
                    changed = winnow(edited, k, window)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[0], n, sha, as_string(*held[3]), as_string(*changed), likeness(held[3][0], changed[0]), likeness(held[3][0], own[0])))
                    if len(out) >= 500:
                        yield given(out)
                        out = []
                held = None if ahead else (doc, text, bucket, own)
        yield given(out)

    in_small_batches(docs.sparkSession)
    return next_documents(docs).select("doc_id", "text", "bucket", "ahead").mapInArrow(trimmed(run), OUT)

"""WARC archives and their globally ordered capture index.

``write_archives`` writes one gzip member per record: a response with its payload, or a revisit that names the
response with the same payload (told by SHA-256; SHA-1 is what the format's headers state). ``read_archives`` parses
the archives again and gives each one's captures as a run, sorted by URL key, timestamp and page, in a file of its
own, with a sparse index: a row for every ``SPARSE`` captures. ``merge_runs`` cuts the order into ranges by these three
(so the captures of one URL can lie in many ranges) and merges all runs' parts of a range with a loser tree, reading
each run forward from the place that its sparse index gives, so a task holds one line of each run. With more runs than
``FAN_IN``, groups of runs are first merged to longer runs, in a task for each core at least while runs last.

Files lie in the folder that the cluster shares; their names hold a random part and only those in written manifests
are read, so what a lost or repeated task left behind is ignored.

Defined cases: a null html is an empty payload; a very long one is one record, which a task holds; a null url has the
key "" and a null page_id is kept (it never is the
response while its payload has a page_id); rows with the same page_id are captures each for itself, and those that
repeat the response's page_id and payload are responses too; captures that are equal in all three keep the order of
their runs' names; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.llm.shared import in_small_batches, scratch, stored, trimmed

#: Captures between two entries of a run's sparse index, the runs that one merge reads, captures of an archive, ranges.
SPARSE, FAN_IN = 512, 256
EPOCH = 1_704_067_200
CAPTURE = "url_key string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
#: A row for each entry of a run's sparse index; the first one, at place 0, has the run's number of captures.
RUN = "path string, n long, key string, place long"
RECORDS, RANGES = 50_000, 4096


def url_key(url: str | None) -> str:
    """The host's labels from the right, then the path and query, in lower case, without scheme, www, port 80 or fragment."""
    from urllib.parse import urlsplit

    try:
        parts = urlsplit((url or "").strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip().lower()
    if not host:
        return (url or "").strip().lower()
    host = host.removeprefix("www.")
    query = f"?{'&'.join(sorted(parts.query.split('&')))}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + query


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f[0] for f in fields])


def _record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; both kinds state the full payload's digest and length."""
    stamp = _stamp(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>",
        f"WARC-Date: {stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z", "WARC-Target-URI: " + json.dumps(url), f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"X-Payload-Length: {len(payload)}", "X-Page-ID: " + json.dumps(page_id), "Content-Type: text/html",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{refers_to}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    block = payload if refers_to is None else b""
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _stamp(page_id: int | None) -> str:
    """The table has no capture times: the page_id counts seconds from a fixed one."""
    from datetime import UTC, datetime, timedelta

    return (datetime.fromtimestamp(EPOCH, UTC) + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y%m%d%H%M%S")


def write_archives(pages: DataFrame, least_bytes: int = 0, records: int = RECORDS, level: int = 3) -> DataFrame:
    """Write the archives; returns their written manifest: path, n, folder."""
    in_small_batches(pages.sparkSession)
    folder = scratch(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).select("*", F.sha2("payload", 256).alias("same"), F.length("payload").cast("long").alias("size"))
    groups = own.groupBy("same", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = stored(groups.filter((F.col("n") > 1) & (F.col("size") >= least_bytes)).drop("n"), "payloadgroups")
    refers_to = F.when(~F.col("top").eqNullSafe(F.col("page_id")), F.col("top"))
    rows = own.join(groups, ["same", "size"], "left").select("page_id", "url", "payload", F.unhex(F.sha1("payload")).alias("sha1"), refers_to.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        file, path, n = None, "", 0
        for batch in batches:
            for i in range(batch.num_rows):
                if file is None:
                    path, n = f"{top}/{uuid.uuid4().hex}.warc.gz", 0
                    file = store.open_output_stream(path, compression=None)
                file.write(gzip.compress(_record(*(c[i].as_py() for c in batch.columns)), level, mtime=0))
                n += 1
                if n == records:
                    file.close()
                    yield _batch([(path, n)], "path string, n long")
                    file = None
        if file is not None:
            file.close()
            yield _batch([(path, n)], "path string, n long")

    return stored(rows.mapInArrow(trimmed(write), "path string, n long").withColumn("folder", F.lit(folder)), "archives")


def parse_archive(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record of a file of gzip members; holds one record at a time."""
    member, parts, at, begin = zlib.decompressobj(31), [], 0, 0
    data = stream.read(chunk)
    while data:
        parts.append(member.decompress(data))
        at += len(data) - len(member.unused_data)
        if not member.eof:
            data = stream.read(chunk)
            continue
        data = member.unused_data or stream.read(chunk)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield begin, headers, rest[: int(headers["Content-Length"])]
        member, parts, begin = zlib.decompressobj(31), [], at


def _write_run(store, path: str, lines: Iterator[str]) -> list[tuple[str, int | None, str, int]]:
    """Write the lines; the rows (RUN) of the run's sparse index."""
    entries, place, n = [], 0, 0
    with store.open_output_stream(path, compression=None) as f:
        held: list[bytes] = []
        for line in lines:
            if n % SPARSE == 0:
                f.write(b"".join(held))
                held = []
                entries.append([path, None, line.split("\x02", 1)[0], place])
            own = (line + "\n").encode()
            held.append(own)
            place += len(own)
            n += 1
        f.write(b"".join(held))
    if entries:
        entries[0][1] = n
    return [tuple(e) for e in entries]


def read_archives(archives: DataFrame) -> DataFrame:
    """Parse each archive into a sorted run of captures in a file; returns the runs' written manifest with folder.

    A response's payload is read back and its digest and length are taken from it; they must be those in its header.
    """
    folder = scratch(archives.sparkSession, "runs")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = []
                source, _ = fs.FileSystem.from_uri(at)
                with source.open_input_stream(path, compression=None) as f:
                    for offset, h, block in parse_archive(f):
                        page_id, digest = json.loads(h["X-Page-ID"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(h["X-Payload-Length"])
                        if h["WARC-Type"] == "response" and (base64.b32encode(hashlib.sha1(block).digest()).decode(), len(block)) != (digest, size):
                            raise ValueError(f"{path}: record at {offset} does not match its digest")
                        refers = int(h["X-Refers-To-Page-ID"]) if h["WARC-Type"] == "revisit" else None
                        key = json.dumps(url_key(json.loads(h["WARC-Target-URI"])))[1:-1]
                        lines.append(f"{key}\x01{_stamp(page_id)}\x01{page_id if page_id is not None else -1:020d}\x02" + json.dumps([page_id, size, digest, h["WARC-Type"], refers, path.rsplit("/", 1)[1], offset]))
                store, top = fs.FileSystem.from_uri(folder)
                store.create_dir(top)
                yield _batch(_write_run(store, f"{top}/{uuid.uuid4().hex}.run", sorted(lines)), RUN)

    spread = archives.select("path", "folder").repartition(max(1, archives.count()), "path")  # a number, or small rows would be put together
    return stored(spread.mapInArrow(trimmed(read), RUN).withColumn("folder", F.lit(folder)), "runmanifest")


class LoserTree:
    """Merges sorted iterators: each step replays the matches on one path from a leaf to the root."""

    def __init__(self, sources: list[Iterator[str]]):
        self.sources, self.k = sources, max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other == -1:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[str]:
        while (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.sources[w], None)
            self._replay(w)


def _lines(store, path: str, place: int, low: str, high: str | None) -> Iterator[str]:
    """Lines of a run from low on and below high, read forward from place."""
    with store.open_input_file(path) as f:
        f.seek(place)
        rest = b""
        while data := f.read(1 << 16):
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                text = line.decode()
                key = text.split("\x02", 1)[0]
                if high is not None and key >= high:
                    return
                if key >= low:
                    yield text


def merge_runs(runs: DataFrame, fan_in: int = FAN_IN, ranges: int | None = None) -> DataFrame:
    """All captures (CAPTURE) with range_no: ordered by url_key and ts within a range, and ranges in order."""
    spark = runs.sparkSession
    first = runs.select("folder").first()
    if first is None:
        return spark.createDataFrame([], CAPTURE + ", range_no long")
    folder, cores = first[0], spark.sparkContext.defaultParallelism
    n = runs.filter("place = 0").count()
    while n > fan_in:  # groups of runs to longer ones first
        def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            store, top = fs.FileSystem.from_uri(folder)
            groups: dict[int, list[str]] = {}
            for batch in batches:
                for g, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    groups.setdefault(g, []).append(path)
            for paths in groups.values():
                yield _batch(_write_run(store, f"{top}/{uuid.uuid4().hex}.run", iter(LoserTree([_lines(store, p, 0, "", None) for p in sorted(paths)]))), RUN)

        n = max(-(-n // fan_in), min(cores, n // 2))
        grouped = runs.filter("place = 0").select(F.pmod(F.xxhash64("path"), F.lit(n)).alias("g"), "path").repartition(n, "g")
        runs = stored(grouped.mapInArrow(trimmed(longer), RUN).withColumn("folder", F.lit(folder)), "runmanifest")
        n = runs.filter("place = 0").count()
    total = runs.agg(F.sum("n")).first()[0]
    ranges = min(RANGES, ranges or max(1, total // RECORDS * 4, cores))
    cuts = runs.select("key").repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("low"))
    lows = ["", *sorted({r[0] for r in cuts.select("low").collect()})[1:]]  # at most RANGES rows
    bounds = F.array(*[F.lit(x) for x in lows])
    # a run is read from its last sparse entry below the range; equal keys may begin there
    entries = runs.select("path", "place", (F.size(F.filter(bounds, lambda low: low <= F.col("key"))) - 1).alias("range_no"))
    last = entries.groupBy("path", "range_no").agg(F.max("place").alias("place"))
    every = runs.filter("place = 0").select("path", F.explode(F.sequence(F.lit(0), F.lit(len(lows) - 1))).alias("range_no"))
    below = W.partitionBy("path").orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    parts = every.join(last, ["path", "range_no"], "left").withColumn("place", F.coalesce(F.max("place").over(below), F.lit(0)))
    parts = parts.select(F.col("range_no").cast("long"), "path", "place", F.get(bounds, F.col("range_no")).alias("low"), F.get(bounds, F.col("range_no") + 1).alias("high"))
    parts = parts.repartition(len(lows), "range_no").sortWithinPartitions("range_no", "path")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)

        def merged(number: int, own: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows = []
            for line in LoserTree([_lines(store, *source) for source in own]):
                head, _, tail = line.partition("\x02")
                key, ts, _ = head.split("\x01")
                page_id, size, digest, kind, refers, archive, offset = json.loads(tail)
                rows.append((json.loads(f'"{key}"'), ts, page_id, size, digest, kind, refers, archive, offset, number))
                if len(rows) == 10_000:
                    yield _batch(rows, CAPTURE + ", range_no long")
                    rows = []
            yield _batch(rows, CAPTURE + ", range_no long")

        number, own = -1, []
        for batch in batches:
            for no, *source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if no != number and own:
                    yield from merged(number, own)
                    own = []
                number = no
                own.append(tuple(source))
        if own:
            yield from merged(number, own)

    return parts.mapInArrow(trimmed(merge), CAPTURE + ", range_no long")


def capture_histories(pages: DataFrame, least_bytes: int = 0, records: int = RECORDS) -> DataFrame:
    """Write pages to archives, read these back and merge their captures in global order."""
    return merge_runs(read_archives(write_archives(pages, least_bytes, records)))

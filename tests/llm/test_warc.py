import base64
import hashlib
import random

from rejoinder.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, top long, n int"


def test_round_trip_equals_brute_force(spark):
    rnd = random.Random(2)
    bodies = ["", None, "é" * 9, "<p>\r\n\r\nx</p>", "z" * 200_000, *[f"<b>{i}</b>" for i in range(30)]]
    rows = [(i, rnd.choice(["http://WWW.a.org/x?b=1&a=2#f", "https://b.a.org", f"http://c.org/{i % 7}", None, "no url", "http://[bad"]), rnd.choice(bodies), "p", 1, 1) for i in range(200)]
    rows += [(None, "http://n.org/", "only null", "p", 1, 1), (None, None, "z" * 200_000, "p", 1, 1)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = warc.merge_runs(warc.read_archives(warc.write_archives(pages, records=13)), fan_in=5, ranges=4).collect()
    want = []
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == body and r[0] is not None]
        top = max(same, default=None)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert sorted(map(str, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got])) == sorted(map(str, want))
    by_range = {}
    for r in got:
        by_range.setdefault(r.range_no, []).append((r.url_key, r.ts))
    joined = [x for k in sorted(by_range) for x in by_range[k]]
    assert joined == sorted(joined) and len(by_range) > 1


def test_empty_and_repeated(spark):
    assert warc.capture_histories(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, "http://a.org/", "x", "p", 1, 1)] * 2, SCHEMA)
    assert [r.record_type for r in warc.capture_histories(twice).collect()] == ["response"] * 2


def test_loser_tree():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(str(rnd.randrange(50)) for _ in range(rnd.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://www.B.a.org:443/P?z=1&a=2#x") == "org,a,b)/p?a=2&z=1"
    assert warc.url_key(None) == ""


def test_captures_of_one_url_lie_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPARSE", 8)
    pages = spark.createDataFrame([(i, "http://hot.org/", f"body {i}", "p", 1, 1) for i in range(400)], SCHEMA).repartition(2)
    got = warc.merge_runs(warc.read_archives(warc.write_archives(pages, records=50)), ranges=6).collect()
    assert len(got) == 400 and len({r.range_no for r in got}) >= 4 and len({r.url_key for r in got}) == 1
    assert [r.page_id for r in sorted(got, key=lambda r: (r.range_no, r.ts))] == list(range(400))

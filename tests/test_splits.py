"""Sources that many tasks read although one value, page or object spans the whole file."""

import html
import json
import random

import pytest

from rejoinder.sources import keyed, readers


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that everything spans them."""
    names = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def odd_value(rnd, depth=0):
    k = rnd.random()
    if k < 0.3 or depth > 3:
        return "".join(rnd.choice(["a", '"', "\\", "}", "{", ",", "é", "漢", " ", "[", "]", "\n", ":"]) for _ in range(rnd.randint(0, 12)))
    if k < 0.5:
        return rnd.randint(-5, 5)
    return {str(i) + '"}': odd_value(rnd, depth + 1) for i in range(rnd.randint(0, 3))} if k < 0.75 else [odd_value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]


@pytest.mark.parametrize(("n", "indent", "ascii_"), [(0, None, True), (1, 1, False), (200, None, False), (200, 2, True)])
def test_keyed_object_over_many_splits(spark, tmp_path, small_splits, n, indent, ascii_):
    rnd = random.Random(n)
    given = {f'k"{i}\\,}}': {"meta": {"pair_id": json.dumps(odd_value(rnd)), "split": str(i)}, "other": odd_value(rnd)} for i in range(n)}
    given |= {"long": {"meta": {"pair_id": "x{" * 2_000, "split": '"' * 700}}} if n == 200 else {}  # spans many splits itself
    path = tmp_path / "o.json"
    path.write_text(json.dumps(given, indent=indent, ensure_ascii=ascii_) + "\n" * bool(indent))
    schema = "map<string, struct<meta: struct<pair_id: string, split: string>>>"
    got = keyed.keyed_json(spark, str(path), schema).collect()
    assert sorted((r.id, r.meta.pair_id, r.meta.split) for r in got) == sorted((k, v["meta"]["pair_id"], v["meta"]["split"]) for k, v in given.items())
    assert n < 200 or keyed._pieces(spark, str(path)).rdd.getNumPartitions() > 50


def test_two_files_and_bytes_behind_the_object(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text('{"a": {"meta": {"split": "1"}}} \n } {"no": {"meta": {"split": "9"}}}')
    (tmp_path / "b.json").write_text('\n {"b": {"meta": {"split": "2"}}, "c": {"meta": {"split": "' + "y" * 900 + '"}}\n}\n\n')
    got = keyed.keyed_json(spark, str(tmp_path), "map<string, struct<meta: struct<split: string>>>").collect()
    assert sorted((r.id, r.meta.split) for r in got) == [("a", "1"), ("b", "2"), ("c", "y" * 900)]


def revision(i, rnd):
    who = rnd.choice(["<username>Ann &amp; Co</username><id>4</id>", "<ip>1.2.3.4</ip>"])
    return f'<revision>\n<id>{i}</id><parentid>{i - 1}</parentid><timestamp>2020-01-01T00:00:{i % 60:02d}Z</timestamp><contributor>{who}</contributor><comment>c{i}</comment><text bytes="7" xml:space="preserve">{html.escape(f"&lt;page> text <revision> {i} ")}</text><sha1>s</sha1></revision>\n'


def test_a_page_of_many_revisions_keeps_its_header(spark, tmp_path, small_splits):
    rnd, want, out, i = random.Random(4), [], ['<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">\n<siteinfo><sitename>W</sitename></siteinfo>\n'], 0
    for page, n in ((1, 3), (2, 0), (3, 120), (4, 1), (5, 60)):
        ns = "x" if page == 4 else 3
        out.append(f"<page>\n<title>User talk:A&amp;{page}</title><ns>{ns}</ns><id>{page}</id>\n")
        for _ in range(n):
            i += 1
            out.append(revision(i, rnd))
            want.append((str(page), f"User talk:A&{page}", None if page == 4 else 3, str(i), f"&lt;page> text <revision> {i} ".strip()))
        out.append("</page>\n")
    (tmp_path / "d.xml").write_text("".join(out) + "</mediawiki>\n")
    got = readers._revisions(spark, str(tmp_path / "d.xml"))
    assert spark.read.option("lineSep", "</revision>").text(str(tmp_path / "d.xml")).rdd.getNumPartitions() > 50
    rows = [(r.page_id, r.page_title, r.namespace, r.r.id, r.r.text._VALUE.strip()) for r in got.collect()]
    assert sorted(rows, key=lambda r: int(r[3])) == want
    names = {(r.contributor_username, r.contributor_id, r.contributor_ip) for r in readers.talk_revisions(spark, str(tmp_path / "d.xml")).collect()}
    assert names == {("Ann & Co", "4", None), (None, None, "1.2.3.4")}

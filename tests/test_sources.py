import json

from pyspark.sql import functions as F

from rejoinder.operators import scoring
from rejoinder.sources import readers, sinks


def test_keyed_json_and_utterances(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"c1": {"meta": {"pair_id": "c2", "has_removed_comment": true, "split": "train"}}, "c2": {"meta": {"pair_id": "c1"}}}')
    (tmp_path / "s.json").write_text('{"A": {"meta": {"num_posts": 3, "num_comments": 4}}}')
    lines = [{"id": "u1", "conversation_id": "c1", "speaker": "A", "text": "x", "reply-to": None, "timestamp": 5, "meta": {"score": 2}}, {"id": "u2", "conversation_id": "zz", "speaker": "B", "reply-to": "u1", "timestamp": 6, "meta": {"stickied": True, "author_flair_text": "1∆"}}]
    (tmp_path / "u.jsonl").write_text("\n".join(map(json.dumps, lines)))
    convs, people = readers.conversations(spark, str(tmp_path / "c.json")), readers.speakers(spark, str(tmp_path / "s.json"))
    got = {r.utterance_id: r for r in readers.utterances(spark, str(tmp_path / "u.jsonl"), convs, people).collect()}
    assert (got["u1"].conv_pair_id, got["u1"].speaker_num_posts, got["u1"].subreddit, got["u1"].gilded, got["u1"].stickied) == ("c2", 3, "changemyview", 0, False)
    assert (got["u2"].reply_to, got["u2"].text, got["u2"].stickied, got["u2"].conv_split) == ("u1", "", True, None)
    assert readers.count_lines(spark, str(tmp_path / "u.jsonl")) == 2 and len(got["u1"]) == 19


def test_xml_rows(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<posts><row Id="1" PostTypeId="1" Body="&lt;p&gt;How do I &lt;b&gt;mount&lt;/b&gt;?&lt;/p&gt;" Tags="&lt;mount&gt;&lt;usb&gt;" OwnerUserId="7"/><row Id="2" PostTypeId="5"/></posts>')
    got = readers.posts(spark, str(tmp_path / "p.xml")).collect()
    assert [(r.post_id, r.post_type_id, r.body_text, r.tags, r.title) for r in got] == [("1", 1, "How do I mount ?", "mount usb", "")]
    (tmp_path / "h.xml").write_text('<h><row Id="1" PostHistoryTypeId="10"/><row Id="2" PostHistoryTypeId="5"/><row Id="3" PostHistoryTypeId="x"/></h>')
    assert [r.history_id for r in readers.post_history(spark, str(tmp_path / "h.xml")).collect()] == ["1"]
    (tmp_path / "c.xml").write_text('<c><row Id="1" PostId="2"/></c>')
    assert tuple(readers.comments(spark, str(tmp_path / "c.xml")).first())[:4] == ("1", "2", None, "")


PAGE = '<page><title>{}</title><ns>{}</ns><id>{}</id><revision><id>r{}</id><timestamp>2020-01-01T00:00:00Z</timestamp><contributor>{}</contributor><comment>{}</comment><text bytes="3">{}</text><sha1>s</sha1></revision></page>'


def test_nested_dump(spark, tmp_path):
    pages = [("User talk:Ann", 3, 1, 1, "<username>Bob</username><id>9</id>", "warn", "abc"), ("User talk:Ann", 3, 2, 2, "<username>Ann</username>", "warn", "abc"), ("Art", 0, 3, 3, "<username>Ann</username>", "", "long text"), ("Art", 0, 4, 4, "<ip>1.2.3.4</ip>", "", ""), ("T", "x", 5, 5, "<ip>1.1.1.1</ip>", "", "q")]
    (tmp_path / "d.xml").write_text('<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">' + "".join(PAGE.format(*p) for p in pages) + "</mediawiki>")
    talk = readers.talk_revisions(spark, str(tmp_path / "d.xml"))
    assert sorted((r.page_id, r.revision_id, r.namespace_name, r.contributor_id, r.text_bytes) for r in talk.collect()) == [("1", "r1", "User talk", "9", "3"), ("2", "r2", "User talk", None, "3")]
    users = readers.target_users(talk)
    assert [r.contributor for r in users.collect()] == ["Ann"]
    assert [(r.page_id, r.text_content) for r in readers.article_edits(spark, str(tmp_path / "d.xml"), users, cap=4).collect()] == [("3", "long")]


def test_rating_form_and_problems(spark, tmp_path):
    head = "record_id,rater_id, Empathy,constructiveness,respect,social_cohesion,intervention_style,confidence_tier1,confidence_style,notes\n"
    (tmp_path / "f.csv").write_text(head + "bl_1,GD,3.5,nan,9,x,Punative,high ,?,a, b, c\n")
    form = readers.rating_form(spark, str(tmp_path / "f.csv"), "r1")
    r = form.first()
    assert (r.empathy, r.constructiveness, r.respect, r.social_cohesion, r.confidence_tier1, r.notes) == (3.5, None, 9.0, None, "high", "a")
    p = readers.form_problems(form).first()
    assert (p.off_grid_respect, p.off_grid_empathy, p.unlisted_styles) == (1, 0, 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("reddit", "reframe", 0.5), ("wikipedia", "warning", float("nan"))], "platform string, intervention_type string, x double")
    path = str(tmp_path / "t")
    sinks.write_parquet(df, path, 1)
    from rejoinder.functions import text as t

    assert sinks.append_column(path, spark, "role", t.role("platform", "intervention_type"), ["platform", "intervention_type"]) and not sinks.append_column(path, spark, "role", F.lit(1), [])
    assert {r.role for r in sinks.read_version(spark, path).collect()} == {"peer", "formal_authority"}
    assert json.loads(sinks.json_report({"a": df}))["a"][1]["x"] is None and "reframe" in sinks.text_report({"a": df})
    sinks.write_table(df, str(tmp_path / "csv"))
    assert "adj_empathy" in sinks.adjudication_sheet(df, ["empathy"]).columns
    assert readers.first_existing(spark, str(tmp_path / "no"), path) == path

"""Queries that write a given table in the form of a source and read it back, and those of scans, streams and sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.functions import text as t
from rejoinder.operators import reports, scoring, triples
from rejoinder.operators.membership import pruned_members
from rejoinder.operators.staged import scratch
from rejoinder.plans.catalogue import CLEAN, query
from rejoinder.sources import readers, sinks

STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def escaped(x: Column | str) -> Column:
    """Text of an XML element or attribute."""
    x = F.coalesce(t.col(x), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def element(name: str, value: Column) -> Column:
    """The element, or nothing where the value is null."""
    return F.when(value.isNotNull(), joined(f"<{name}>", escaped(value.cast("string")), f"</{name}>")).otherwise("")


def write_elements(rows: DataFrame, path: str) -> None:
    """value (an element) as XML files with a root."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ['<?xml version="1.0" encoding="utf-8"?>', "<rows>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</rows>"]})

    rows.select("value").mapInPandas(lines, "value string").write.text(path)


def write_objects(members: DataFrame, path: str) -> None:
    """id and value (JSON) as keyed objects, one over each file."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead = "{"
        for b in batches:
            out = []
            for k, v in zip(b["id"], b["value"], strict=True):
                out.append(f"{lead}{json.dumps(k, ensure_ascii=False)}: {v}")
                lead = ","
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ["{}" if lead == "{" else "}"]})

    members.select("id", "value").mapInPandas(lines, "value string").write.text(path)


# Utterances with their conversations and speakers -----------------------------------------------------------------


@query(r"""
WITH c AS (SELECT *, conv_id || ':' || turn AS id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
s AS (SELECT role, count(*) AS posts, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1)
SELECT id AS utterance_id, 'c' || conv_id AS conversation_id, c.role AS speaker, md5(coalesce(text, '')) AS text_md5, CASE WHEN p IS NOT NULL THEN conv_id || ':' || p END AS reply_to, conv_id * 1000 + turn AS timestamp,
 CASE WHEN turn % 5 <> 0 THEN turn % 7 END AS score, CASE WHEN turn % 3 = 0 THEN 0 ELSE turn % 4 END AS gilded, CASE WHEN turn % 2 = 0 THEN 'changemyview' ELSE 's' || (turn % 3) END AS subreddit, CASE WHEN turn % 3 = 1 THEN false ELSE turn % 6 = 0 END AS stickied,
 CASE WHEN turn % 4 = 2 THEN '1∆' ELSE '' END AS author_flair, 'c' || (conv_id + 1) AS conv_pair_id, conv_id % 7 = 0 AS conv_has_removed_comment, CASE conv_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' END AS conv_split,
 s.posts AS speaker_num_posts, s.n AS speaker_num_comments, (SELECT count(*) FROM conversations) AS n_lines FROM c LEFT JOIN s USING (role)""")
def ingest_utterances(tab):
    """Lines of JSON for the turns, and huge keyed objects for conversations and speakers."""
    c = tab("conversations")
    top, i, k = scratch(c.sparkSession, "utterances"), F.col("conv_id"), F.col("turn")
    back = F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn"))
    meta = F.struct(F.when(k % 5 != 0, k % 7).alias("score"), F.when(k % 3 != 0, k % 4).alias("gilded"), F.when(k % 2 != 0, joined("s", k % 3)).alias("subreddit"), F.when(k % 3 != 1, k % 6 == 0).alias("stickied"), F.when(k % 4 == 2, F.lit("1∆")).alias("author_flair_text"))
    lines = c.withColumn("p", back).select(F.to_json(F.struct(joined(i, ":", k).alias("id"), joined("c", i).alias("conversation_id"), F.col("role").alias("speaker"), "text", F.when(F.col("p").isNotNull(), joined(i, ":", F.col("p"))).alias("reply-to"), (i * 1000 + k).alias("timestamp"), meta.alias("meta"))).alias("value"))
    lines.write.text(f"{top}/lines")
    split = F.when(i % 3 == 0, "train").when(i % 3 == 1, "test")
    convs = c.select("conv_id").distinct().select(joined("c", i).alias("id"), F.to_json(F.struct(F.struct(joined("c", i + 1).alias("pair_id"), (i % 7 == 0).alias("has_removed_comment"), split.alias("split"), F.lit('a "quoted } brace').alias("note")).alias("meta"))).alias("value"))
    write_objects(convs, f"{top}/convs")
    people = c.groupBy("role").agg(F.count("*").alias("num_posts"), F.count_distinct("conv_id").alias("num_comments"))
    write_objects(people.select(F.col("role").alias("id"), F.to_json(F.struct(F.struct("num_posts", "num_comments").alias("meta"))).alias("value")), f"{top}/people")
    spark = c.sparkSession
    got = readers.utterances(spark, f"{top}/lines", readers.conversations(spark, f"{top}/convs"), readers.speakers(spark, f"{top}/people"))
    return got.withColumns({"text_md5": F.md5("text"), "n_lines": F.lit(readers.count_lines(spark, f"{top}/lines"))}).drop("text", "top_level_comment", "retrieved_on", "permalink")


# Attribute XML: posts, comments, history --------------------------------------------------------------------------


def attributes(**given: Column) -> Column:
    """A row element; attributes whose value is null are left out."""
    parts = [F.when(v.isNotNull(), joined(f' {k}="', escaped(v.cast("string")), '"')).otherwise("") for k, v in given.items()]
    return F.concat(F.lit("  <row"), *parts, F.lit(" />"))


@query(rf"""
SELECT doc_id::VARCHAR AS post_id, (1 + doc_id % 2)::INT AS post_type_id, CASE WHEN doc_id % 2 = 1 THEN (doc_id - 1)::VARCHAR END AS parent_id, md5('<p class="a > b">' || text || '</p><!-- no --><script>if (a < b) x()</script>') AS body_html_md5,
 md5({STRIPPED.format("text")}) AS body_text_md5, source AS owner_user_id, CASE WHEN doc_id % 2 = 0 THEN 'About ' || source ELSE '' END AS title, CASE WHEN doc_id % 2 = 0 THEN lang || ' ' || source ELSE '' END AS tags, strftime(make_timestamp(doc_id * 60000000), '%Y-%m-%dT%H:%M:%S') AS creation_date, n_chars::VARCHAR AS score
FROM documents WHERE doc_id % 5 < 4""")
def ingest_posts(tab):
    """Rows of kinds 1 and 2 stay; every fifth is of another kind."""
    d, i = tab("documents"), F.col("doc_id")
    path = scratch(d.sparkSession, "posts")
    body = F.concat(F.lit('<p class="a > b">'), escaped_text("text"), F.lit("</p><!-- no --><script>if (a < b) x()</script>"))
    ask = i % 2 == 0
    rows = attributes(Id=i, PostTypeId=F.when(i % 5 == 4, F.lit(5)).otherwise(1 + i % 2), ParentId=F.when(~ask, i - 1), Body=body, OwnerUserId=F.col("source"), Title=F.when(ask, joined("About ", F.col("source"))), Tags=F.when(ask, joined("<", F.col("lang"), "><", F.col("source"), ">")), CreationDate=F.date_format(F.timestamp_seconds(i * 60), "yyyy-MM-dd'T'HH:mm:ss"), Score=F.col("n_chars"))
    write_elements(d.select(rows.alias("value")), path)
    got = readers.posts(d.sparkSession, path)
    raw = F.regexp_replace(F.replace(F.replace(F.replace("body_html", F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")), "$^", "")
    return got.select("post_id", "post_type_id", "parent_id", F.md5(raw).alias("body_html_md5"), F.md5("body_text").alias("body_text_md5"), "owner_user_id", "title", "tags", "creation_date", "score")


def escaped_text(x: Column | str) -> Column:
    """Text of an HTML element."""
    x = t.col(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


_INSIDE = """(?:[^"''>]|"[^"]*"|''[^'']*'')*"""
_RAW = "|".join(rf"<{tag}(?:[\s/]{_INSIDE})?>.*?(?:</{tag}[^>]*>|\z)" for tag in ("script", "style"))
_MARKUP = rf"<!--(?:-?>|.*?(?:--!?>|\z))|{_RAW}|</?[a-z]{_INSIDE}>|</?[a-z][^>]*>|<[!?/][^>]*>|<(?:[a-z!?]|/[a-z])[^>]*\z"
_PLAIN = """regexp_replace(regexp_replace(replace(replace(y, '&middot;', '·'), '&copy;', '©'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')"""


@query(rf"""
WITH n AS (SELECT page_id, string_split(regexp_replace(coalesce(html, ''), '{_MARKUP}', chr(64976), 'gis'), chr(64976)) AS x FROM pages)
SELECT page_id, md5(array_to_string(list_filter(list_transform(x, lambda y: {STRIPPED.format(_PLAIN)}), lambda y: y <> ''), ' ')) AS h FROM n""")
def html_nodes(tab):
    """Pages' text nodes; some pages are cut off inside a reference or a tag."""
    from rejoinder.functions.html import html_nodes as nodes

    return tab("pages").select("page_id", F.md5(nodes("html")).alias("h"))


@query(r"""
SELECT conv_id || ':' || turn AS comment_id, conv_id::VARCHAR AS post_id, md5(coalesce(text, '')) AS text_md5, role AS user_id, CASE WHEN turn % 2 = 0 THEN 'name "' || role || '"' ELSE '' END AS user_display_name, CASE WHEN turn % 3 > 0 THEN (turn % 3)::VARCHAR END AS score FROM conversations""")
def ingest_comments(tab):
    c, k = tab("conversations"), F.col("turn")
    path = scratch(c.sparkSession, "comments")
    rows = attributes(Id=joined(F.col("conv_id"), ":", k), PostId=F.col("conv_id"), Text=F.col("text"), UserId=F.col("role"), UserDisplayName=F.when(k % 2 == 0, joined('name "', F.col("role"), '"')), Score=F.when(k % 3 > 0, k % 3))
    write_elements(c.select(rows.alias("value")), path)
    return readers.comments(c.sparkSession, path).select("comment_id", "post_id", F.md5("text").alias("text_md5"), "user_id", "user_display_name", "score")


@query(f"""
SELECT conv_id || ':' || turn AS history_id, conv_id::VARCHAR AS post_id, ((conv_id + turn) % 23)::INT AS history_type_id, role AS user_id, md5(coalesce(text, '')) AS comment_md5, '' AS text FROM conversations WHERE (conv_id + turn) % 23 IN {readers.MODERATION}""")
def ingest_history(tab):
    """Kinds of moderation stay; a kind that isn't a number goes."""
    c, k = tab("conversations"), F.col("turn")
    path = scratch(c.sparkSession, "history")
    n = (F.col("conv_id") + k) % 23
    kind = F.when(n == 0, F.lit("none")).otherwise(n.cast("string"))
    rows = attributes(Id=joined(F.col("conv_id"), ":", k), PostId=F.col("conv_id"), PostHistoryTypeId=kind, UserId=F.col("role"), Comment=F.col("text"))
    write_elements(c.select(rows.alias("value")), path)
    return readers.post_history(c.sparkSession, path).select("history_id", "post_id", "history_type_id", "user_id", F.md5("comment").alias("comment_md5"), "text")


# Nested XML: talk pages and articles ------------------------------------------------------------------------------

#: Revisions of a page that a stand-in dump has at most; a conversation of more is several pages.
PAGE_TURNS = 5_000


def _dump(rows: DataFrame, path: str) -> None:
    """rows: page, ns, title, at, revision (id), parent, username, user_id, ip, comment, text. Pages follow each other."""
    line = W.partitionBy("page").orderBy("at")
    first, last = F.row_number().over(line) == 1, F.lead("at").over(line).isNull()
    head = joined("<page>\n<title>", escaped("title"), "</title><ns>", F.col("ns"), "</ns><id>", F.col("page"), "</id>\n")
    who = F.concat(F.lit("<contributor>"), element("username", F.col("username")), element("id", F.col("user_id")), element("ip", F.col("ip")), F.lit("</contributor>"))
    stamp = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.concat(F.lit("<revision>"), element("id", F.col("revision")), element("parentid", F.col("parent")), element("timestamp", stamp), who, element("comment", F.col("comment")), joined('<text bytes="', F.length("text"), '" xml:space="preserve">', escaped("text"), "</text><sha1>", F.md5("text"), "</sha1></revision>"))
    marked = rows.repartition("page").withColumns({"first": first, "last": last})
    marked.select(F.concat(F.when(F.col("first"), head).otherwise(""), body, F.when(F.col("last"), "\n</page>").otherwise("")).alias("value")).write.text(path)


def _talk_rows(c: DataFrame) -> DataFrame:
    i, k = F.col("conv_id"), F.col("turn")
    spaces = F.array(*[F.lit(x) for x in ("1", "3", "5", "0", "x", "3")])
    return c.select(
        (i * 1000 + F.floor(k / PAGE_TURNS)).alias("page"), F.get(spaces, (i % 6).cast("int")).alias("ns"), joined("User talk:U", i % 97).alias("title"), (i * 10 + k).alias("at"), joined(i, ":", k).alias("revision"), F.when(k > 0, joined(i, ":", k - 1)).alias("parent"),
        F.when(k % 5 != 0, joined("U", k % 89)).alias("username"), F.when(k % 5 != 0, k % 89).alias("user_id"), F.when(k % 5 == 0, joined("10.0.0.", k % 200)).alias("ip"), F.when(k % 4 != 0, joined("undid & <warn> ", k)).alias("comment"), "text",
    )


TALK = f"""(SELECT conv_id * 1000 + turn // {PAGE_TURNS} AS page, ['1', '3', '5', '0', 'x', '3'][conv_id % 6 + 1] AS ns, 'User talk:U' || (conv_id % 97) AS title, strftime(make_timestamp((conv_id * 10 + turn) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp, conv_id || ':' || turn AS revision,
 CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent, CASE WHEN turn % 5 <> 0 THEN 'U' || (turn % 89) END AS username, CASE WHEN turn % 5 <> 0 THEN (turn % 89)::VARCHAR END AS user_id, CASE WHEN turn % 5 = 0 THEN '10.0.0.' || (turn % 200) END AS ip, CASE WHEN turn % 4 <> 0 THEN 'undid & <warn> ' || turn END AS comment, coalesce(text, '') AS text FROM conversations)"""


@query(f"""
SELECT page::VARCHAR AS page_id, title AS page_title, CASE ns WHEN 'x' THEN 0 ELSE ns::INT END AS namespace, CASE ns WHEN '1' THEN 'Talk' WHEN '3' THEN 'User talk' WHEN '5' THEN 'Wikipedia talk' END AS namespace_name, revision AS revision_id, parent AS parent_revision_id, stamp AS timestamp,
 username AS contributor_username, user_id AS contributor_id, ip AS contributor_ip, comment AS edit_comment, md5({STRIPPED.format("text")}) AS text_md5, length(text)::VARCHAR AS text_bytes, md5(text) AS sha1 FROM {TALK} WHERE ns IN ('1', '3', '5')""")
def ingest_talk(tab):
    """Pages of any number of revisions, read by revisions."""
    c = tab("conversations")
    path = scratch(c.sparkSession, "talk")
    _dump(_talk_rows(c), path)
    return readers.talk_revisions(c.sparkSession, path).withColumn("text_md5", F.md5(t.strip(F.coalesce("text_content", F.lit(""))))).drop("text_content")


EDITS = r"""(SELECT doc_id, 'A' || source AS title, doc_id || '' AS revision, CASE WHEN doc_id % 5 <> 0 THEN 'U' || (doc_id % 97) END AS username, CASE WHEN doc_id % 5 = 0 THEN '10.0.0.' || (doc_id % 200) END AS ip, CASE WHEN doc_id % 3 = 0 THEN lang END AS comment, coalesce(text, '') AS text FROM documents)"""
TEMPLATES = r"'\{\{uw-|\{\{welcome|\{\{warning|\{\{bansummary|\{\{indef-block|\{\{blocked|wp:civil'"


@query(f"""
WITH u AS (SELECT DISTINCT substr(title, 11) AS who FROM {TALK} WHERE ns = '3' AND coalesce(username, ip) <> substr(title, 11) AND (comment IS NOT NULL OR regexp_matches(lower(text), {TEMPLATES})))
SELECT revision AS revision_id, title AS page_title, username AS contributor_username, ip AS contributor_ip, coalesce(username, '') = '' AS is_ip, comment AS edit_comment, md5({STRIPPED.format("text")}) AS text_md5 FROM {EDITS} e WHERE coalesce(username, ip) IN (SELECT who FROM u)""")
def ingest_article_edits(tab):
    """Article revisions by users whose talk page got an intervention by another."""
    c, d = tab("conversations"), tab("documents")
    spark, i = c.sparkSession, F.col("doc_id")
    top = scratch(spark, "articles")
    _dump(_talk_rows(c), f"{top}/talk")
    page = F.pmod(F.xxhash64("source", F.floor(i / PAGE_TURNS)), F.lit(1 << 40))
    none = F.lit(None).cast("string")
    rows = d.select(page.alias("page"), F.lit("0").alias("ns"), joined("A", F.col("source")).alias("title"), i.alias("at"), i.cast("string").alias("revision"), none.alias("parent"), F.when(i % 5 != 0, joined("U", i % 97)).alias("username"), none.alias("user_id"), F.when(i % 5 == 0, joined("10.0.0.", i % 200)).alias("ip"), F.when(i % 3 == 0, F.col("lang")).alias("comment"), "text")
    _dump(rows, f"{top}/edits")
    users = readers.target_users(readers.talk_revisions(spark, f"{top}/talk"))
    got = readers.article_edits(spark, f"{top}/edits", users, cap=1 << 30)
    is_ip = F.coalesce("contributor_username", F.lit("")) == ""
    return got.select("revision_id", "page_title", "contributor_username", "contributor_ip", is_ip.alias("is_ip"), "edit_comment", F.md5(t.strip(F.coalesce("text_content", F.lit("")))).alias("text_md5"))


@query("SELECT doc_id, source, md5(text) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def members_pruned(tab):
    """Rows of a set of keys: the scan skips what lies between the keys' ranges, then the exact semi-join."""
    got = pruned_members(tab("documents"), "doc_id", tab("labels").filter("toxic = 1").select("doc_id"))
    return got.select("doc_id", "source", F.md5("text").alias("h"))


# Neighbours on one key and on streams -----------------------------------------------------------------------------


@query("""
WITH c AS (SELECT conv_id * 100000 + turn AS us, role, md5(coalesce(text, '')) AS h FROM conversations),
r AS (SELECT us, h, role, CASE WHEN role = 'assistant' THEN us END AS mark FROM c),
p AS (SELECT *, max(mark) OVER (ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre, min(mark) OVER (ORDER BY us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS post FROM r)
SELECT p.us, p.h AS h, CASE WHEN p.us - pre <= 172800000000 THEN pre END AS pre_at, a.h AS pre_h, post AS post_at, b.h AS post_h FROM p LEFT JOIN c a ON a.us = p.pre LEFT JOIN c b ON b.us = p.post WHERE p.role <> 'assistant'""")
def asof_one_key(tab):
    """The as-of join where one key has all rows of the table, with texts' checksums as payload."""
    c = tab("conversations").select(F.lit("all").alias("key"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("us"), "role", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    rows = c.filter("role = 'assistant'").select("key", "us", F.col("us").alias("id"), "h")
    got = triples.as_of(c.filter("role <> 'assistant'").select("key", "us", "h"), rows, "key")
    return got.select("us", "h", F.col("pre.us").alias("pre_at"), F.col("pre.h").alias("pre_h"), F.col("post.us").alias("post_at"), F.col("post.h").alias("post_h"))


@query("""
WITH d AS (SELECT doc_id, lang, doc_id * 60000000 + 1000000000000 AS us, n_chars % 3 = 0 AS asks FROM documents WHERE lang IS NOT NULL)
SELECT lang AS key, us, doc_id::VARCHAR AS event_id,
 (max(CASE WHEN NOT asks THEN us END) OVER (PARTITION BY lang ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) // 60000000 - 16666)::VARCHAR AS pre_id,
 (min(CASE WHEN NOT asks THEN us END) OVER (PARTITION BY lang ORDER BY us RANGE BETWEEN 1 FOLLOWING AND 3600000000 FOLLOWING) // 60000000 - 16666)::VARCHAR AS post_id FROM d QUALIFY asks""")
def stream_neighbours(tab):
    """The as-of join of two streams, events being the documents of a length that 3 divides, rows the others."""
    from rejoinder.streaming.as_of_stream import HOUR, as_of_stream

    d = tab("documents")
    spark, top = d.sparkSession, scratch(d.sparkSession, "neighbours")
    own = d.select("lang", F.timestamp_seconds(F.col("doc_id") * 60 + 1_000_000).alias("at"), F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("n_chars") % 3 == 0, F.lit(False)).alias("asks"))
    end = spark.range(1).select(F.lit("").alias("lang"), F.timestamp_seconds(F.lit(8 * 10**9)).alias("at"), F.lit("end").alias("id"), F.lit(False).alias("asks"))  # moves the watermark past all others
    own.unionByName(end).write.parquet(f"{top}/in")
    stream = spark.readStream.schema(own.schema).parquet(f"{top}/in")
    got = as_of_stream(stream.filter("asks"), stream.filter("not asks"), "lang", "at", "id", back=HOUR, ahead=HOUR)
    write = got.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{top}/out/batch={n}")).option("checkpointLocation", f"{top}/check")
    write.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, us long, event_id string, pre_id string, post_id string").parquet(f"{top}/out").drop("batch")


# Scoring, forms and sinks -----------------------------------------------------------------------------------------

_THIRDS = {"pre_intervention_text": "substr(text, 1, length(text) // 3)", "intervention_text": "substr(text, length(text) // 3 + 1, length(text) // 3)", "post_intervention_text": "substr(text, 2 * (length(text) // 3) + 1)"}
_LINES = "'Corrected on ' || source || ' by a peer, in the form of a reframe.'" + "".join(f" || chr(10) || chr(10) || '## {h}' || chr(10) || {STRIPPED.format(x)}" for h, x in zip(("Written before", "The correction", "Written after, to be scored"), _THIRDS.values(), strict=True)) + " || chr(10)"


@query(f"""
WITH p AS (SELECT doc_id, {_LINES} AS p FROM documents), s AS (SELECT doc_id::VARCHAR AS record_id, least(5.0, 1.0 + (length(p) % 9) / 2.0)::DOUBLE AS x, length(p) < 150 AS invalid_triple, length(p) - length(replace(p, '?', '')) AS marks, length(p) // 4 AS n FROM p)
SELECT record_id, x AS empathy, round(0.5 + (marks % 5) / 10.0, 6)::DOUBLE AS confidence, invalid_triple, NULL::VARCHAR AS label_error, n AS input_tokens FROM s""")
def scores_streamed(tab):
    """Records that arrive as files, each twice, scored once by a stream that is stopped and started again."""
    from rejoinder.streaming.scoring_stream import score_stream, scores

    d = tab("documents")
    spark, top = d.sparkSession, scratch(d.sparkSession, "scores")
    records = d.select(F.col("doc_id").cast("string").alias("record_id"), F.col("source").alias("platform"), F.lit("reframe").alias("intervention_type"), F.lit("peer").alias("intervener_role"), *[x.alias(k) for k, x in thirds("text").items()])
    for _ in range(2):
        records.write.mode("append").parquet(f"{top}/in")
        score_stream(spark.readStream.schema(records.schema).parquet(f"{top}/in"), f"{top}/out", f"{top}/check", scoring.stub_scorer).awaitTermination()
    return scores(spark, f"{top}/out").select("record_id", "empathy", F.round("confidence", 6).alias("confidence"), "invalid_triple", "label_error", "input_tokens")


def thirds(x: str) -> dict[str, Column]:
    """A text cut in three: stand-ins for what was written before, in between and after."""
    n = F.floor(F.length(x) / 3).cast("int")
    return {"pre_intervention_text": F.substring(x, F.lit(1), n), "intervention_text": F.substring(x, n + 1, n), "post_intervention_text": F.substring(x, 2 * n + 1, F.length(x))}


@query("""
SELECT (vec_id % 997) || '_' || vec_id AS record_id, 'r1' AS rater, CASE vec_id % 4 WHEN 0 THEN 3.5 WHEN 1 THEN 9 END::DOUBLE AS empathy, CASE WHEN vec_id % 7 > 0 THEN vec_id % 5 + 1 END::DOUBLE AS respect, CASE vec_id % 3 WHEN 0 THEN 'educative' WHEN 1 THEN 'punative' END AS intervention_style,
 CASE vec_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'low' END AS confidence_tier1, CASE WHEN vec_id % 2 = 0 THEN 'a, "quoted" note' || chr(10) || 'of two lines' END AS notes FROM embeddings""")
def rating_forms(tab):
    """CSV forms with blanks, words for null, numbers that are none and quoted line ends; the first path that exists is read."""
    e, i = tab("embeddings"), F.col("vec_id")
    spark, path = e.sparkSession, scratch(e.sparkSession, "forms")
    pick = lambda k, *xs: F.get(F.array(*map(F.lit, xs)), (i % k).cast("int"))
    form = e.select(joined(i % 997, "_", i).alias(" Record_ID"), F.lit("GD").alias("rater_id"), pick(4, " 3.5 ", "9", "nan", "x").alias("Empathy"), F.lit("None").alias("constructiveness"), F.when(i % 7 > 0, (i % 5 + 1).cast("string")).otherwise("").alias("respect"), F.lit(None).cast("string").alias("social_cohesion"), pick(3, "Educative", "PUNATIVE ", "").alias("intervention_style"), pick(3, "High", " low", "nan").alias("confidence_tier1"), F.lit("?").alias("confidence_style"), F.when(i % 2 == 0, 'a, "quoted" note\nof two lines').alias("notes"))
    form.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    got = readers.rating_form(spark, readers.first_existing(spark, f"{path}-none", path), "r1")
    return got.select("record_id", "rater", "empathy", "respect", "intervention_style", "confidence_tier1", "notes")


@query("""
SELECT 'mn_' || doc_id AS record_id, 'r2' AS rater, CASE WHEN doc_id % 4 < 3 THEN 1 + doc_id % 9 / 2.0 END::DOUBLE AS empathy, lower(nullif(source, '')) AS intervention_style, md5(regexp_replace(regexp_replace(text, '^ +| +$', '', 'g'), '^(nan|None)?$', '')) AS notes FROM documents""")
def rating_workbooks(tab):
    """Forms as workbooks: texts of any length as shared strings, numbers as numbers or as words."""
    from rejoinder.sources.xlsx import write_workbooks

    d, i = tab("documents"), F.col("doc_id")
    path = scratch(d.sparkSession, "workbooks") + ".xlsx"
    score = (1 + i % 9 / 2).cast("double")
    form = d.select(joined("mn_", i).alias("Record_ID "), F.lit("TL").alias("rater_id"), F.when(i % 4 < 2, score.cast("string")).when(i % 4 == 2, F.format_string(" %.1f ", score)).otherwise("none").alias("empathy"), F.col("source").alias("intervention_style"), F.lit("extra").alias("comment of no one"), F.col("text").alias("Notes"))
    write_workbooks(form, path, 2_000)
    got = readers.rating_form(d.sparkSession, path, "r2")
    return got.select("record_id", "rater", "empathy", "intervention_style", F.md5(F.coalesce("notes", F.lit(""))).alias("notes"))


@query("""
SELECT platform, count(*) AS n, count(*) FILTER (WHERE broken) AS failed FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'reddit' WHEN 1 THEN 'stackexchange' ELSE 'wikipedia' END AS platform, doc_id % 50 = 7 AS broken FROM documents) GROUP BY 1""")
def platform_parts(tab):
    """The main and the Wikipedia part of the records, with the records whose score failed."""
    i = F.col("doc_id")
    d = tab("documents").select(F.when(i % 3 == 0, "reddit").when(i % 3 == 1, "stackexchange").otherwise("wikipedia").alias("platform"), F.when(i % 50 == 7, "unparsed").alias("label_error"))
    main, wikipedia = reports.main_and_wikipedia(d)
    count = lambda x: x.groupBy("platform").agg(F.count("*").alias("n"), F.count("label_error").alias("failed"))
    return count(main).unionByName(count(wikipedia))


@query(f"SELECT doc_id, lang, md5(coalesce(text, '')) AS h, CASE WHEN lang = 'en' THEN 1 ELSE 2 END::INT AS kind, {CLEAN.format('source')} AS label FROM documents")
def migrated_columns(tab):
    """A versioned table of files of at most 1,000 rows, to which two columns are added; each reader sees a whole version."""
    d = tab("documents")
    spark, path = d.sparkSession, scratch(d.sparkSession, "table")
    sinks.write_version(d.select("doc_id", "lang", "source", F.md5(F.coalesce("text", F.lit(""))).alias("h")), path, rows_per_file=1_000)
    assert sinks.append_column(path, spark, "kind", F.when(F.col("lang") == "en", 1).otherwise(2), ["lang"])
    assert sinks.append_column(path, spark, "label", t.clean("source"), ["source"])
    assert not sinks.append_column(path, spark, "label", F.lit(None), ["source"]) and not sinks.append_column(path, spark, "other", F.lit(None), ["missing"])
    return sinks.read_version(spark, path).drop("source")

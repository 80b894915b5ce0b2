"""Readers with explicit schemas: nothing is inferred, so a column that is null for a while keeps its type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.functions import text as t
from rejoinder.functions.html import html_nodes
from rejoinder.sources.keyed import keyed_json
from rejoinder.sources.xlsx import workbook_table

UTTERANCES = (
    "id string, conversation_id string, speaker string, text string, `reply-to` string, timestamp long, "
    "meta struct<score: long, top_level_comment: string, retrieved_on: long, gilded: long, subreddit: string, stickied: boolean, permalink: string, author_flair_text: string>"
)
CONVERSATIONS = "map<string, struct<meta: struct<pair_id: string, has_removed_comment: boolean, split: string>>>"
SPEAKERS = "map<string, struct<meta: struct<num_posts: long, num_comments: long>>>"
# Attributes of the rows of each file, as the format has them (fixed values).
POSTS = [
    "Id", "PostTypeId", "ParentId", "AcceptedAnswerId", "CreationDate", "Score", "ViewCount", "Body", "OwnerUserId",
    "LastEditorUserId", "LastEditDate", "LastActivityDate", "Title", "Tags", "AnswerCount", "CommentCount",
    "ClosedDate", "ContentLicense",
]
COMMENTS = [
    "Id", "PostId", "Score", "Text", "CreationDate", "UserId", "UserDisplayName", "ContentLicense",
]
HISTORY = [
    "Id", "PostId", "PostHistoryTypeId", "CreationDate", "UserId", "UserDisplayName", "Comment", "Text",
    "RevisionGUID", "ContentLicense",
]
#: Kinds of history rows that are moderation (fixed values).
MODERATION = (10, 11, 12, 13, 14, 15, 19, 20)
HEADER = "title string, ns string, id string"
REVISION = "id string, parentid string, timestamp string, contributor struct<username: string, id: string, ip: string>, comment string, text struct<_VALUE: string, _bytes: string>, sha1 string"
FORM = "record_id string, rater_id string, empathy string, constructiveness string, respect string, social_cohesion string, intervention_style string, confidence_tier1 string, confidence_style string, notes string"


def conversations(spark: SparkSession, path: str) -> DataFrame:
    return keyed_json(spark, path, CONVERSATIONS).select("id", F.col("meta.pair_id").alias("conv_pair_id"), F.col("meta.has_removed_comment").alias("conv_has_removed_comment"), F.col("meta.split").alias("conv_split"))


def speakers(spark: SparkSession, path: str) -> DataFrame:
    return keyed_json(spark, path, SPEAKERS).select("id", F.col("meta.num_posts").alias("speaker_num_posts"), F.col("meta.num_comments").alias("speaker_num_comments"))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def utterances(spark: SparkSession, path: str, convs: DataFrame, people: DataFrame) -> DataFrame:
    """The 19 columns of an utterance with its conversation's and speaker's."""
    m = F.col("meta")
    rows = spark.read.schema(UTTERANCES).json(path).select(
        F.col("id").alias("utterance_id"), "conversation_id", "speaker", F.coalesce("text", F.lit("")).alias("text"), F.col("`reply-to`").alias("reply_to"), "timestamp",
        m["score"].alias("score"), m["top_level_comment"].alias("top_level_comment"), m["retrieved_on"].alias("retrieved_on"), F.coalesce(m["gilded"], F.lit(0)).alias("gilded"),
        F.coalesce(m["subreddit"], F.lit("changemyview")).alias("subreddit"), F.coalesce(m["stickied"], F.lit(False)).alias("stickied"), F.coalesce(m["permalink"], F.lit("")).alias("permalink"), F.coalesce(m["author_flair_text"], F.lit("")).alias("author_flair"),
    )
    joined = rows.join(convs.withColumnRenamed("id", "conversation_id"), "conversation_id", "left").join(people.withColumnRenamed("id", "speaker"), "speaker", "left")
    return joined.select(*rows.columns, "conv_pair_id", "conv_has_removed_comment", "conv_split", "speaker_num_posts", "speaker_num_comments")


def xml_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """<row .../> elements: an attribute a column, all strings."""
    schema = ", ".join(f"_{n} string" for n in names)
    return spark.read.format("xml").option("rowTag", "row").schema(schema).load(path).select(*[F.col(f"_{n}").alias(n) for n in names])


def posts(spark: SparkSession, path: str) -> DataFrame:
    """Questions and answers."""
    kind = F.coalesce(F.expr("try_cast(PostTypeId as int)"), F.lit(0))
    return xml_rows(spark, path, POSTS).filter(kind.isin(1, 2)).select(
        F.col("Id").alias("post_id"), kind.alias("post_type_id"), F.col("ParentId").alias("parent_id"), F.col("AcceptedAnswerId").alias("accepted_answer_id"), F.col("CreationDate").alias("creation_date"), F.col("Score").alias("score"), F.col("ViewCount").alias("view_count"),
        F.coalesce("Body", F.lit("")).alias("body_html"), html_nodes("Body").alias("body_text"), F.col("OwnerUserId").alias("owner_user_id"), F.col("LastEditorUserId").alias("last_editor_user_id"), F.col("LastEditDate").alias("last_edit_date"), F.col("LastActivityDate").alias("last_activity_date"),
        F.coalesce("Title", F.lit("")).alias("title"), t.tag_list("Tags").alias("tags"), F.col("AnswerCount").alias("answer_count"), F.col("CommentCount").alias("comment_count"), F.col("ClosedDate").alias("closed_date"), F.col("ContentLicense").alias("content_license"),
    )


def comments(spark: SparkSession, path: str) -> DataFrame:
    return xml_rows(spark, path, COMMENTS).select(
        F.col("Id").alias("comment_id"), F.col("PostId").alias("post_id"), F.col("Score").alias("score"), F.coalesce("Text", F.lit("")).alias("text"), F.col("CreationDate").alias("creation_date"),
        F.col("UserId").alias("user_id"), F.coalesce("UserDisplayName", F.lit("")).alias("user_display_name"), F.col("ContentLicense").alias("content_license"),
    )


def post_history(spark: SparkSession, path: str) -> DataFrame:
    """Moderation events only."""
    kind = F.expr("try_cast(PostHistoryTypeId as int)")
    return xml_rows(spark, path, HISTORY).filter(kind.isin(*MODERATION)).select(
        F.col("Id").alias("history_id"), F.col("PostId").alias("post_id"), kind.alias("history_type_id"), F.col("CreationDate").alias("creation_date"), F.col("UserId").alias("user_id"), F.coalesce("UserDisplayName", F.lit("")).alias("user_display_name"),
        F.coalesce("Comment", F.lit("")).alias("comment"), F.coalesce("Text", F.lit("")).alias("text"), F.col("RevisionGUID").alias("revision_guid"), F.col("ContentLicense").alias("content_license"),
    )


def _revisions(spark: SparkSession, path: str) -> DataFrame:
    """A row for each revision with its page's header, however many revisions a page has.

    The dump is read as text that is split behind each revision, so a page's revisions lie in any number of splits. A
    revision that follows a page's begin has its header; the others take the last header before them, in their split by
    a window, or else that of the last split with one, by a scan over a row a split.
    """
    text = spark.read.option("lineSep", "</revision>").text(path)
    lead = F.regexp_extract("value", r"(?s).*<page(?:\s[^>]*)?>(.*?)<revision[\s>]", 1)
    head = F.when(F.col("value").contains("<page"), F.from_xml(F.concat(F.lit("<page>"), lead, F.lit("</page>")), HEADER))
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), head.alias("head"), "value")
    rows = rows.filter(F.col("value").rlike(r"<revision[\s>]"))
    ends = rows.groupBy("path", "block").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("at"))).alias("head"))
    before = F.last("head", ignorenulls=True).over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    into = ends.select("path", "block", before.alias("into"))
    here = F.last("head", ignorenulls=True).over(W.partitionBy("path", "block").orderBy("at"))
    placed = rows.withColumn("head", here).join(into, ["path", "block"]).withColumn("head", F.coalesce("head", "into"))
    body = F.concat(F.lit("<revision"), F.substring_index("value", "<revision", -1), F.lit("</revision>"))
    return placed.select(F.col("head.id").alias("page_id"), F.col("head.title").alias("page_title"), F.expr("try_cast(head.ns as int)").alias("namespace"), F.from_xml(body, REVISION).alias("r"))


def _flat(rows: DataFrame, *lead, text) -> DataFrame:
    r = F.col("r")
    return rows.select(
        *lead, r["id"].alias("revision_id"), r["parentid"].alias("parent_revision_id"), r["timestamp"].alias("timestamp"), r["contributor"]["username"].alias("contributor_username"), r["contributor"]["id"].alias("contributor_id"), r["contributor"]["ip"].alias("contributor_ip"),
        r["comment"].alias("edit_comment"), text.alias("text_content"), r["text"]["_bytes"].alias("text_bytes"), r["sha1"].alias("sha1"),
    )


def talk_revisions(spark: SparkSession, path: str, namespaces=(1, 3, 5)) -> DataFrame:
    """Revisions of talk pages; a namespace that isn't a number counts as 0."""
    rows = _revisions(spark, path).withColumn("namespace", F.coalesce("namespace", F.lit(0))).filter(F.col("namespace").isin(*namespaces))
    return _flat(rows, "page_id", "page_title", "namespace", t.namespace_name("namespace").alias("namespace_name"), text=F.col("r")["text"]["_VALUE"])


def article_edits(spark: SparkSession, path: str, targets: DataFrame, cap: int = 5000) -> DataFrame:
    """Article revisions by the contributors in targets (column contributor), texts cut to cap."""
    rows = _revisions(spark, path).filter(F.coalesce("namespace", F.lit(-1)) == 0)
    flat = _flat(rows, "page_id", "page_title", text=F.substring(F.coalesce(F.col("r")["text"]["_VALUE"], F.lit("")), 1, cap))
    who = t.first_truthy("contributor_username", "contributor_ip")
    return flat.withColumn("contributor", who).join(targets.select("contributor").distinct(), "contributor", "left_semi").drop("contributor")


def target_users(talk: DataFrame) -> DataFrame:
    """Users whose talk page got an intervention by someone else (column contributor)."""
    target, actor = t.talk_target("page_title"), t.first_truthy("contributor_username", "contributor_ip")
    hit = (F.col("namespace") == 3) & target.isNotNull() & (target != "") & (actor != target) & t.is_intervention("edit_comment", "text_content")
    return talk.filter(hit).select(target.alias("contributor")).distinct()


def blank_to_null(df: DataFrame) -> DataFrame:
    """Headers and cells stripped, headers in lower case; '', 'nan' and 'None' become null."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    return df.select(*[F.when(F.trim(F.col(c)).isin("", "nan", "None"), None).otherwise(F.trim(F.col(c))).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes])


def rating_form(spark: SparkSession, path: str, rater: str) -> DataFrame:
    """A rater's form, CSV (whose cells may hold line ends) or, where the path ends in .xlsx, workbooks; scores that aren't
    numbers become null, fields beyond the last column are dropped."""
    if path.endswith(".xlsx"):
        raw = workbook_table(spark, path, [c.split()[0] for c in FORM.split(", ")]).drop("path", "row")
    else:
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"').schema(FORM).csv(path)
    form = blank_to_null(raw)
    dims = ("empathy", "constructiveness", "respect", "social_cohesion")
    return form.withColumns({d: F.expr(f"try_cast({d} as double)") for d in dims} | {"rater": F.lit(rater), "intervention_style": F.lower("intervention_style")})


def form_problems(form: DataFrame, styles=("punitive", "educative", "suggestive", "positive", "structural")) -> DataFrame:
    """Per rater: scores off the half-point grid from 1 to 5 and styles that aren't listed. Rows are kept, only counted."""
    dims = ("empathy", "constructiveness", "respect", "social_cohesion")
    off = [F.count_if(F.col(d).isNotNull() & ~((F.col(d) >= 1) & (F.col(d) <= 5) & (F.col(d) * 2 == F.floor(F.col(d) * 2)))).alias(f"off_grid_{d}") for d in dims]
    return form.groupBy("rater").agg(*off, F.count_if(F.col("intervention_style").isNotNull() & ~F.col("intervention_style").isin(*styles)).alias("unlisted_styles"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists: chooses the plan where a source is optional."""
    return next((p for p in paths if exists(spark, p)), None)

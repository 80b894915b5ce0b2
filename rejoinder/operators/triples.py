"""Builders of intervention triples: what someone wrote, the correction by another, what the first wrote next.

Each builder finds neighbours by a segmented scan (``carry``) over ranges of key and order, so that a key with any share
of all rows is worked on by many tasks; none joins a key's rows with each other. Orders end in unique tie-break ids, so
results don't depend on the order of input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rejoinder.functions import text as t
from rejoinder.operators.carry import Nearest, carried
from rejoinder.operators.ranges import running

HOURS_48 = 48 * 3_600_000_000
MAX_PER_POST = 3
#: Characters of an intervention's text in a Wikipedia record, as in the study's records; added_content itself is whole.
ADDED = 3000
RECORD = ["platform", "user_id", "pre_intervention_text", "intervention_text", "intervention_type", "post_intervention_text", "timestamp", "response_time_minutes", "platform_metadata"]


def metadata(**columns: Column) -> Column:
    """A JSON text of the columns, nulls too."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]), {"ignoreNullFields": "false"})


def one_per_key(df: DataFrame, key: list[str] | str, order: list[Column | str]) -> DataFrame:
    """DISTINCT ON: the first row of each key."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def reply_chain(utterances: DataFrame) -> DataFrame:
    """Replies to another's utterance with that speaker's earliest later utterance in the reply's conversation.

    utterances: utterance_id (unique), conversation_id, speaker, reply_to, timestamp (seconds). The parent may lie in
    any conversation. The later utterance is strictly later and not the parent. Adds pre_id, pre_speaker, post_id.
    """
    u = utterances
    parents = u.select(F.col("utterance_id").alias("reply_to"), F.col("utterance_id").alias("pre_id"), F.col("speaker").alias("pre_speaker"))
    replies = u.filter(F.col("reply_to").isNotNull() & F.col("timestamp").isNotNull()).join(parents, "reply_to").filter(F.col("pre_speaker") != F.col("speaker"))
    # what each speaker said, with what they said next in case the first later one is the parent itself
    said = u.filter(F.col("timestamp").isNotNull()).select("conversation_id", F.col("speaker").alias("who"), F.col("timestamp").cast("long").alias("timestamp"), F.col("utterance_id").cast("string").alias("id"))
    line = ["conversation_id", "who"]
    said = carried(said, line, ["timestamp", "id"], next=Nearest(F.col("id"), "after"))
    asked = replies.select("conversation_id", F.col("pre_speaker").alias("who"), F.col("timestamp").cast("long").alias("timestamp"), F.col("utterance_id").cast("string").alias("id"), F.col("pre_id").cast("string").alias("pre_id"), F.lit(None).cast("struct<id:string,next:string>").alias("said"))
    both = asked.unionByName(said.select("conversation_id", "who", "timestamp", "id", F.lit(None).cast("string").alias("pre_id"), F.struct("id", "next").alias("said")))
    # replies stand behind what was said at the same time, so what comes after is strictly later
    found = carried(both, line, ["timestamp"], first=Nearest(F.col("said"), "after", [F.col("said").isNull(), F.col("id")]))
    found = found.filter("pre_id is not null and first is not null")
    post = F.when(F.col("first.id") == F.col("pre_id"), F.col("first.next")).otherwise(F.col("first.id"))
    found = found.select(F.col("id").alias("utterance_id"), post.alias("post_id")).filter("post_id is not null")
    return replies.withColumn("utterance_id", F.col("utterance_id").cast("string")).join(found, "utterance_id")


def reddit_triples(utterances: DataFrame) -> DataFrame:
    """Unified records of reply chains with three texts of MIN_TEXT characters."""
    u = one_per_key(utterances, "utterance_id", ["timestamp", F.xxhash64("text")])
    chain = reply_chain(u)
    texts = u.select("utterance_id", "text", "timestamp")
    pre = texts.select(F.col("utterance_id").alias("pre_id"), F.col("text").alias("pre_raw"))
    post = texts.select(F.col("utterance_id").alias("post_id"), F.col("text").alias("post_raw"), F.col("timestamp").alias("post_ts"))
    rows = chain.join(pre, "pre_id").join(post, "post_id")
    rows = rows.withColumns({"pre": t.clean("pre_raw"), "mid": t.clean("text"), "post": t.clean("post_raw")}).filter(t.is_valid("pre", "mid", "post"))
    meta = metadata(conversation_id=F.col("conversation_id"), pre_utterance_id=F.col("pre_id"), intervention_utterance_id=F.col("utterance_id"), post_utterance_id=F.col("post_id"), conv_split=F.col("conv_split"), conv_has_removed_comment=F.coalesce("conv_has_removed_comment", F.lit(False)), intervention_score=F.col("score"))
    return rows.select(
        F.lit("reddit").alias("platform"), F.col("pre_speaker").alias("user_id"), F.col("pre").alias("pre_intervention_text"), F.col("mid").alias("intervention_text"), t.reddit_type("stickied", "author_flair").alias("intervention_type"),
        F.col("post").alias("post_intervention_text"), F.timestamp_seconds("timestamp").alias("timestamp"), ((F.col("post_ts") - F.col("timestamp")) / 60.0).alias("response_time_minutes"), meta.alias("platform_metadata"),
    )


def owner_next(comments: DataFrame, thread: str, order: list[str], author: str, owner: str, payload: list[str]) -> DataFrame:
    """Comments by others with the owner's next comment by position (struct next: payload), null without one."""
    own = F.when(F.col(author) == F.col(owner), F.struct(*payload))
    placed = carried(comments, [thread], order, next=Nearest(own, "after"))
    return placed.filter(F.col(author).isNotNull() & (F.col(author).cast("string") != "") & (F.col(author) != F.col(owner)))


def first_n(df: DataFrame, key: str, order: list[str], n: int = MAX_PER_POST) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def stackexchange_triples(posts: DataFrame, comments: DataFrame, cap: int = MAX_PER_POST) -> DataFrame:
    """Unified records of comments on a post that its owner answered, the first ``cap`` valid ones of each post."""
    p = posts.withColumns({"pre": t.clean("body_text")}).filter(F.col("owner_user_id").isNotNull() & F.col("body_text").isNotNull() & (F.length(t.strip("body_text")) >= t.MIN_TEXT) & t.is_valid("pre"))
    c = comments.filter(F.col("text").isNotNull() & (F.length(t.strip("text")) >= t.MIN_TEXT)).select("comment_id", "post_id", "user_id", "text", F.try_to_timestamp("creation_date").alias("at")).filter("at is not null")
    joined = c.join(p.select("post_id", "owner_user_id", "pre", "post_type_id", F.col("score").alias("post_score"), "title"), "post_id")
    rows = owner_next(joined, "post_id", ["at", "comment_id"], "user_id", "owner_user_id", ["comment_id", "text", "at"])
    rows = rows.withColumns({"mid": t.clean("text"), "post": t.clean("next.text")}).filter(F.col("next").isNotNull() & t.is_valid("mid", "post"))
    rows = first_n(rows, "post_id", ["at", "comment_id"], cap)
    meta = metadata(post_id=F.col("post_id"), post_type_id=F.col("post_type_id"), post_score=F.col("post_score"), post_title=F.col("title"), intervention_comment_id=F.col("comment_id"), response_comment_id=F.col("next.comment_id"))
    return rows.select(
        F.lit("stackexchange").alias("platform"), F.col("owner_user_id").alias("user_id"), F.col("pre").alias("pre_intervention_text"), F.col("mid").alias("intervention_text"), F.lit("reframe").alias("intervention_type"),
        F.col("post").alias("post_intervention_text"), F.col("at").alias("timestamp"), t.minutes_between("at", "next.at").alias("response_time_minutes"), meta.alias("platform_metadata"),
    )


def as_of(events: DataFrame, rows: DataFrame, key: str, back_us: int = HOURS_48) -> DataFrame:
    """events with the latest row strictly before, at most back_us ago (pre), and the first strictly after (post).

    Both sides: key and us (microseconds); rows: id and any payload. One shuffle by ranges of key and us; no range join.
    """
    payload = [c for c in rows.columns if c not in (key, "us", "id")]
    kept = rows.select(key, "us", F.struct("us", "id", *payload).alias("row"))
    asked = events.select(key, "us", F.struct(*[c for c in events.columns if c not in (key, "us")]).alias("event"))
    both = asked.select("*", F.lit(None).cast(kept.schema["row"].dataType).alias("row")).unionByName(kept.select(key, "us", F.lit(None).cast(asked.schema["event"].dataType).alias("event"), "row"))
    # events stand before rows of their own time for what was before, and behind them for what comes after
    of_row = F.col("row").isNotNull()
    found = carried(both, [key], ["us"], pre=Nearest(F.col("row"), "before", [of_row, F.col("row.id")]), post=Nearest(F.col("row"), "after", [~of_row, F.col("row.id")]))
    found = found.filter("event is not null").drop("row")
    near = F.when(F.col("us") - F.col("pre.us") <= F.lit(back_us), F.col("pre"))
    return found.select(key, "us", "event.*", near.alias("pre"), "post")


def talk_events(talk: DataFrame, cap: int = 10_000) -> DataFrame:
    """Interventions on user talk pages: target, us, intervention texts; the text added since the revision before."""
    rows = talk.filter(F.col("namespace") == 3).withColumn("at", F.try_to_timestamp("timestamp")).filter(F.col("at").isNotNull() & F.col("text_content").isNotNull())
    rows = carried(rows, ["page_id"], ["at", "revision_id"], before=Nearest(F.col("text_content")))
    rows = rows.withColumn("before", F.coalesce("before", F.lit("")))
    actor, target = t.first_truthy("contributor_username", "contributor_id", "contributor_ip"), t.talk_target("page_title")
    rows = rows.withColumns({"target": target, "actor": actor}).filter(F.col("target").isNotNull() & F.col("actor").isNotNull() & (F.col("actor") != F.col("target")) & t.is_intervention("edit_comment", "text_content"))
    comment = F.coalesce("edit_comment", F.lit(""))
    return rows.select(F.col("target").alias("who"), F.unix_micros("at").alias("us"), t.clean(F.substring(t.added_content("before", "text_content"), 1, min(cap, ADDED))).alias("intervention_text"), t.wiki_type(comment).alias("intervention_type"), F.col("revision_id").alias("intervention_revision_id"), F.col("page_title").alias("talk_page_title"), comment.alias("edit_comment"))


def wikipedia_triples(talk: DataFrame, edits: DataFrame) -> DataFrame:
    """Unified records: the target's last article edit within 48 hours before an intervention, and the first after."""
    events = talk_events(talk)
    at = F.try_to_timestamp("timestamp")
    who = t.first_truthy("contributor_username", "contributor_id", "contributor_ip")
    made = edits.select(who.alias("who"), F.unix_micros(at).alias("us"), F.col("revision_id").alias("id"), "page_title", t.article_edit("edit_comment", "text_content").alias("text"), (F.coalesce("contributor_username", F.lit("")) == "").alias("is_ip")).filter("who is not null and us is not null")
    rows = as_of(events, made.join(events.select("who").distinct(), "who", "left_semi"), "who").filter("pre is not null")
    rows = rows.filter(t.is_valid(F.col("pre.text"), "intervention_text"))
    meta = metadata(talk_page_title=F.col("talk_page_title"), pre_article_title=F.col("pre.page_title"), post_article_title=F.col("post.page_title"), intervention_revision_id=F.col("intervention_revision_id"), pre_article_revision_id=F.col("pre.id"), post_article_revision_id=F.col("post.id"), edit_comment=F.col("edit_comment"), wiki_user_is_ip=F.col("pre.is_ip"))
    return rows.select(
        F.lit("wikipedia").alias("platform"), F.col("who").alias("user_id"), F.col("pre.text").alias("pre_intervention_text"), "intervention_text", "intervention_type", F.coalesce("post.text", F.lit("")).alias("post_intervention_text"),
        F.timestamp_micros("us").alias("timestamp"), ((F.col("post.us") - F.col("us")) / F.lit(6e7)).alias("response_time_minutes"), meta.alias("platform_metadata"),
    )


def turn_pairs(rows: DataFrame, thread: str, order: list[str], author: str, payload: list[str]) -> DataFrame:
    """Adjacent rows by different authors (row, then next) with the first author's next row after those two (post)."""
    me = F.struct(F.col(author).alias("author"), *payload)
    placed = carried(rows.filter(F.col(author).isNotNull()), [thread], order, next=Nearest(me, "after"))
    # the author's own next row lies beyond the pair, as the pair's second is another's
    placed = carried(placed, [thread, author], order, post=Nearest(me, "after"))
    return placed.filter((F.col("next.author") != F.col(author)) & F.col("post").isNotNull())


def wikipedia_triples_legacy(talk: DataFrame, cap: int = 2000) -> DataFrame:
    """Records from talk pages alone: adjacent revisions by different users and the first user's next one."""
    rows = talk.withColumn("at", F.try_to_timestamp("timestamp")).filter(F.col("at").isNotNull() & F.col("text_content").isNotNull())
    rows = rows.withColumn("who", t.first_truthy("contributor_username", "contributor_id", "contributor_ip"))
    pairs = turn_pairs(rows, "page_id", ["at", "revision_id"], "who", ["text_content", F.col("at").alias("when"), "edit_comment", "revision_id"])
    pairs = pairs.withColumns({"pre": t.strip(F.substring("text_content", 1, cap)), "mid": F.substring(t.added_content("text_content", "next.text_content"), 1, ADDED), "last": t.strip(F.substring("post.text_content", 1, cap))}).filter(t.is_valid("pre", "mid", "last"))
    meta = metadata(page_title=F.col("page_title"), intervention_revision_id=F.col("next.revision_id"))
    return pairs.select(
        F.lit("wikipedia").alias("platform"), F.col("who").alias("user_id"), F.col("pre").alias("pre_intervention_text"), F.col("mid").alias("intervention_text"), t.wiki_type(F.coalesce("next.edit_comment", F.lit(""))).alias("intervention_type"),
        F.col("last").alias("post_intervention_text"), F.col("next.when").alias("timestamp"), t.minutes_between("next.when", "post.when").alias("response_time_minutes"), meta.alias("platform_metadata"),
    )


def numbered(df: DataFrame, order: list[str], prefix: Column, name: str = "record_id") -> DataFrame:
    """A sequential key prefix_000000 over a total order, without a single task: places in key ranges are offset."""
    return running(df, order, name="__place").withColumn(name, F.format_string("%s_%06d", prefix, "__place")).drop("__place")


def unified(*parts: DataFrame) -> DataFrame:
    """All records with record_id and intervener_role."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("intervener_role", t.role("platform", "intervention_type"))
    return numbered(rows, ["platform", "timestamp", "user_id", "platform_metadata"], F.col("platform")).select("record_id", *RECORD, "intervener_role")

"""The ``posts`` adapter: community posts derived from the driver's ``documents`` and ``events``.

One message per event, its body the document of the same number (``doc_id = event_id``, FIXTURES.md §4);
an event without a document is a title-only post (NULL ``selftext``). Replayed copies (every tenth
event, arriving 45 minutes later with a higher score) and invalid rows (null author, empty title)
are part of the log. ``landing`` is the raw message log as it arrives from the topic;
``posts`` is the clean table: required fields present, first write wins per id, permalink built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import fixtures as fx
from .tables import read

MESSAGE_COLUMNS = [
    "id", "title", "selftext", "author", "subreddit", "created_utc", "score", "num_comments", "url",
    "permalink", "upvote_ratio", "is_self", "link_flair_text", "ingested_at",
]
REQUIRED_FIELDS = ["id", "title", "author", "created_utc", "subreddit"]


def _raw_permalink(doc_id: Column, post_id: Column, community: Column) -> Column:
    path = F.concat(F.lit("r/"), community, F.lit("/comments/"), post_id, F.lit("/"))
    k = doc_id % 5
    return (
        F.when(k == 0, F.lit(None).cast("string"))
        .when(k == 1, F.lit(""))
        .when(k == 2, F.concat(F.lit("https://www.reddit.com/"), path))
        .when(k == 3, F.concat(F.lit("/"), path))
        .otherwise(path)
    )


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw message log: (msg_offset, 14 message fields). Contains copies and invalid rows."""
    return _messages(spark, sf_dir).select("msg_offset", *MESSAGE_COLUMNS)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message log with the event that each message comes from (event_id)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    j = ev.join(docs, docs.doc_id == ev.event_id, "left")

    d = e = F.col("event_id")
    phrase_no = F.when(d % 61 < 13, d % 61).otherwise(F.lit(9))
    title = F.when(d % 41 == 0, F.lit("")).otherwise(F.element_at(F.array(*[F.lit(p) for p in fx.PHRASES]), (phrase_no + 1).cast("int")))
    minute_off = F.when(F.hour("ts") % 8 == 0, F.lit(0)).otherwise(e % 10)
    created = tx.hour_bucket("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minute_off.cast("int"), (e % 60).cast("decimal(18,6)"))
    post_id = F.concat(F.lit("p"), d.cast("string"))
    community = F.concat(F.lit("c"), (d % 7).cast("string"))

    # Replayed copies come from a generator in the same pass: one scan, one join, no union.
    copy_no = F.explode(F.when(d % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    base = j.select("*", copy_no.alias("_copy"))
    c = F.col("_copy")
    created_col = created
    return base.select(
        "event_id",
        (d * 2 + c).alias("msg_offset"),
        post_id.alias("id"),
        title.alias("title"),
        F.col("text").alias("selftext"),
        F.when(d % 37 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("author"),
        community.alias("subreddit"),
        created_col.alias("created_utc"),
        (F.floor("value").cast("int") + c * 5).alias("score"),
        (F.get_json_object("props", "$.k").cast("int") + c * 2).alias("num_comments"),
        F.concat(F.lit("https://example.com/p/"), d.cast("string")).alias("url"),
        _raw_permalink(d, post_id, community).alias("permalink"),
        ((e % 101) / F.lit(100.0)).alias("upvote_ratio"),
        (e % 2 == 0).alias("is_self"),
        F.when(e % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("link_flair_text"),
        (created_col + F.make_dt_interval(F.lit(0), F.lit(0), ((e % 180) + c * 45).cast("int"), F.lit(0))).alias("ingested_at"),
    )


def required_present(df: DataFrame, fields: list[str] | None = None) -> Column:
    """Required fields present and non-null (an empty string passes)."""
    cond = F.lit(True)
    for f in fields or REQUIRED_FIELDS:
        cond = cond & F.col(f).isNotNull()
    return cond


def first_write_wins(df: DataFrame, key: str = "id", order: tuple[str, ...] = ("ingested_at", "msg_offset")) -> DataFrame:
    """K2 in-batch: keep the earliest arrival per key.

    Written as an aggregate (``min_by`` over the arrival order) rather than a window, so the
    partial aggregate collapses copies map-side: a key replayed millions of times never lands
    in one task as millions of rows.
    """
    others = [c for c in df.columns if c != key]
    rank = F.struct(*[F.col(c) for c in order])
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*[F.col(c) for c in others]), rank).alias("_w"))
        .select(key, *[F.col(f"_w.{c}").alias(c) for c in others])
    )


def shaped(clean: DataFrame) -> DataFrame:
    """Accepted messages as posts: absolute permalink, minute bucket."""
    return clean.withColumn("permalink", tx.build_permalink("permalink")).withColumn("minute", tx.minute_bucket("created_utc"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean posts: valid, de-duplicated (first write wins), permalink absolute, minute bucket.

    An id is an event's number, so copies are told by that: the messages lie by it since the bodies were joined, and the
    texts move only that once.
    """
    valid = _messages(spark, sf_dir).where(required_present(None))
    return shaped(first_write_wins(valid, key="event_id").select("id", "msg_offset", *(c for c in MESSAGE_COLUMNS if c != "id")))


def post_times(log: DataFrame) -> DataFrame:
    """(id, created_utc) of the clean posts, from the log's narrow columns alone."""
    return first_write_wins(log.where(required_present(log)).select("id", "created_utc", "ingested_at", "msg_offset")).select("id", "created_utc")


def as_of(posts_df: DataFrame) -> Column:
    """Reproducible NOW(): the hour after the newest post.

    Evaluated once (one scalar to the driver) and used as a literal, so the many predicates
    that compare against it do not each re-run the posts pipeline as a subquery.
    """
    text = posts_df.select(F.date_format(tx.hour_bucket(F.max("created_utc")) + F.expr("INTERVAL 1 HOUR"),
                                         "yyyy-MM-dd HH:mm:ss").alias("t")).first()["t"]
    return F.lit(text).cast("timestamp_ntz")

"""Forum JSON listings → post rows, and the K1 message payload.

A listing is ``{"data": {"children": [{"kind": ..., "data": {...post...}}, ...]}}``. Defaults
apply only when a key is *absent* (a JSON null stays null), so child objects are read as
``map<string,string>`` and key presence is tested with ``map_contains_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

LISTING_SCHEMA = "struct<data: struct<children: array<struct<kind: string, data: map<string, string>>>>>"

# FIXED VALUES: defaults of the normaliser when a key is absent (None = no default).
DEFAULTS = [
    ("id", None), ("title", ""), ("selftext", ""), ("author", "[deleted]"), ("subreddit", None),
    ("created_utc", "0"), ("score", "0"), ("num_comments", "0"), ("url", ""), ("permalink", ""),
    ("upvote_ratio", "0.0"), ("is_self", "false"), ("link_flair_text", None),
]
LISTING_PAGE = 100  # children per listing page, as the forum API serves them


def _field(m: Column, key: str, default: str | None) -> Column:
    if default is None:
        return m[key]
    return F.when(F.map_contains_key(m, key), m[key]).otherwise(F.lit(default))


def normalize(listings: DataFrame, fetched_at: Column, value: str = "value") -> DataFrame:
    """Explode ``data.children[].data`` and project the 14 message fields with absent-key defaults."""
    parsed = listings.select(F.from_json(F.col(value), LISTING_SCHEMA).alias("_l"))
    kids = parsed.select(F.explode("_l.data.children").alias("_c")).select(F.col("_c.data").alias("m"))
    m = F.col("m")
    f = {k: _field(m, k, d) for k, d in DEFAULTS}
    return kids.select(
        f["id"].alias("id"), f["title"].alias("title"), f["selftext"].alias("selftext"), f["author"].alias("author"),
        f["subreddit"].alias("subreddit"),
        tx.epoch_to_ts(f["created_utc"].cast("double")).alias("created_utc"),
        f["score"].cast("int").alias("score"), f["num_comments"].cast("int").alias("num_comments"),
        f["url"].alias("url"), tx.build_permalink(f["permalink"]).alias("permalink"),
        f["upvote_ratio"].cast("double").alias("upvote_ratio"), f["is_self"].cast("boolean").alias("is_self"),
        f["link_flair_text"].alias("link_flair_text"), fetched_at.cast("timestamp_ntz").alias("ingested_at"))


def listings_from_messages(landing: DataFrame) -> DataFrame:
    """Listing pages built from a message log (for tests and replays).

    Children are grouped into pages of at most ``LISTING_PAGE`` consecutive rows of one input
    partition (``monotonically_increasing_id`` packs the partition id in the high bits), so a
    page never gathers more than a hundred rows whatever the key distribution. Null fields are
    left out of the child objects (absent keys), exactly as ``to_json`` writes them.
    """
    child = F.struct(
        F.lit("t3").alias("kind"),
        F.struct(
            "id", "title", "selftext", "author", "subreddit",
            (F.unix_micros(F.col("created_utc").cast("timestamp")) / F.lit(1e6)).alias("created_utc"),
            "score", "num_comments", "url", "permalink", "upvote_ratio", "is_self", "link_flair_text",
        ).alias("data"))
    paged = landing.select(F.floor(F.monotonically_increasing_id() / LISTING_PAGE).alias("_page"), child.alias("_c"))
    pages = paged.groupBy("_page").agg(F.collect_list("_c").alias("children"))
    return pages.select(F.to_json(F.struct(F.struct(F.col("children")).alias("data"))).alias("value"))


def message_value(keep_nulls: bool = True, overrides: dict | None = None) -> Column:
    """The message JSON: the 14 fields, times as ISO-8601 text (``overrides`` replace fields)."""
    iso = lambda c: F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss")
    fields = {
        "id": F.col("id"), "title": F.col("title"), "selftext": F.col("selftext"), "author": F.col("author"),
        "subreddit": F.col("subreddit"), "created_utc": iso("created_utc"), "score": F.col("score"),
        "num_comments": F.col("num_comments"), "url": F.col("url"), "permalink": F.col("permalink"),
        "upvote_ratio": F.col("upvote_ratio"), "is_self": F.col("is_self"),
        "link_flair_text": F.col("link_flair_text"), "ingested_at": iso("ingested_at"),
    }
    fields.update(overrides or {})
    msg = F.struct(*[v.alias(k) for k, v in fields.items()])
    return F.to_json(msg, {"ignoreNullFields": "false" if keep_nulls else "true"})


def message_payload(df: DataFrame, keep_nulls: bool = True) -> DataFrame:
    """K1: (key, value) rows for the topic: key = post id, value = the message JSON."""
    return df.select(F.col("id").alias("key"), message_value(keep_nulls).alias("value"))


def write_topic(payload: DataFrame, servers: str, topic: str) -> None:
    """K1 sink: publish to a keyed topic (needs the Kafka connector on the classpath)."""
    (payload.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
     .option("kafka.compression.type", "gzip").option("kafka.acks", "all").option("kafka.retries", "3").save())

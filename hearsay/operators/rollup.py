"""Enrichment and time rollups: A1-A6, K4, J1, J2, V5, W2, W6.

Rollups are algebraic: they keep integer partials (count, sum of scores in 1e-4 units,
category counts), so map-side partial aggregation does the heavy lifting, merging stored
partials is exact, and a hot community costs one partial row per partition, not a hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entities as en
from ..functions import scoring as sc
from ..functions import text as tx

SCORE_UNITS = 10_000  # compound is rounded to 4 places, so x * 1e4 is an exact integer

POST_COLUMNS = ["subreddit", "created_utc", "minute", "title", "author", "score", "num_comments",
                "permalink", "url", "ingested_at"]


def enrich(posts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Posts + entities + primary_product + compound + category (one row per id, no text).

    The scoring text is built once, in a projection of its own (an expensive expression used many times is not collapsed
    into its consumers).
    """
    staged = posts.withColumn("_text", tx.combine_for_scoring())
    tagged = staged.withColumn("entities", en.entities(F.col("_text"))).withColumn(
        "primary_product", en.primary_product(F.col("entities"))
    )
    carry = [c for c in POST_COLUMNS if c in posts.columns] + ["entities", "primary_product"]
    scored = sc.score(tagged, lexicon, text=F.col("_text"), key="id", carry=carry)
    return scored.withColumn("category", tx.sentiment_category("compound"))


def units(c: str | Column) -> Column:
    return F.round(tx.col(c) * F.lit(float(SCORE_UNITS))).cast("bigint")


def mean_from_units(total: Column, n: Column) -> Column:
    """Exact integer sum, one IEEE division chain: the same double in every engine."""
    return total / F.lit(float(SCORE_UNITS)) / n


def minute_partials(scored: DataFrame, keys: tuple[str, ...] = ("minute", "subreddit")) -> DataFrame:
    """K4 ledger rows: integer partials per (minute, subreddit); merge = sum."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("posts_count"),
        F.sum(units("compound")).alias("score_units"),
        F.count_if(F.col("category") == "positive").alias("positive_count"),
        F.count_if(F.col("category") == "negative").alias("negative_count"),
        F.count_if(F.col("category") == "neutral").alias("neutral_count"),
    )


def merge_partials(partials: DataFrame, keys: tuple[str, ...] = ("minute", "subreddit")) -> DataFrame:
    return partials.groupBy(*keys).agg(
        F.sum("posts_count").alias("posts_count"),
        F.sum("score_units").alias("score_units"),
        F.sum("positive_count").alias("positive_count"),
        F.sum("negative_count").alias("negative_count"),
        F.sum("neutral_count").alias("neutral_count"),
    )


def finish(partials: DataFrame) -> DataFrame:
    cols = [c for c in partials.columns if c != "score_units"]
    out = partials.withColumn("avg_sentiment", mean_from_units(F.col("score_units"), F.col("posts_count")))
    return out.select(*cols[: cols.index("posts_count") + 1], "avg_sentiment", *cols[cols.index("posts_count") + 1:])


def minute_rollup(scored: DataFrame) -> DataFrame:
    """A1: (minute, subreddit, posts_count, avg_sentiment, positive/negative/neutral counts)."""
    return finish(minute_partials(scored))


def hourly_timeline(minutes: DataFrame, since: Column | None = None, community: str | None = None) -> DataFrame:
    """V5: posts-weighted hourly sentiment from minute rows (exact through integer partials)."""
    m = minutes
    if since is not None:
        m = m.where(F.col("minute") >= since)
    if community is not None:
        m = m.where(F.col("subreddit") == community)
    h = m.groupBy(tx.hour_bucket("minute").alias("time")).agg(
        F.sum(F.round(F.col("avg_sentiment") * F.col("posts_count") * F.lit(1e6)).cast("bigint")).alias("_u"),
        F.sum("posts_count").alias("posts"),
    )
    return h.select("time", (F.col("_u") / F.lit(1e6) / F.col("posts")).alias("sentiment"), "posts")


def sentiment_baseline(minutes: DataFrame, value: str = "avg_sentiment") -> DataFrame:
    """A3/A4 per community: mean (exact), sample stddev (rounded 9), count, max, min."""
    return minutes.groupBy("subreddit").agg(
        (F.sum(F.round(F.col(value) * F.lit(1e6)).cast("bigint")) / F.lit(1e6) / F.count(F.lit(1))).alias("mean"),
        tx.rnd(F.stddev_samp(value), 9).alias("std"),
        F.count(F.lit(1)).alias("sample_size"),
        F.max(value).alias("max_value"),
        F.min(value).alias("min_value"),
    )


def moving_average(timeline: DataFrame, rows: int = 24, part: list[str] | None = None,
                   order: str = "time", value: str = "sentiment") -> DataFrame:
    """Trailing ``rows``-row mean (partial at the start), NULL counted as 0, rounded 3."""
    w = (Window.partitionBy(*part) if part else Window.partitionBy()).orderBy(order).rowsBetween(-(rows - 1), 0)
    v = F.coalesce(F.col(value), F.lit(0.0))
    return timeline.withColumn("moving_avg", tx.rnd(F.sum(F.round(v * F.lit(1e6)).cast("bigint")).over(w) / F.lit(1e6) / F.count(F.lit(1)).over(w), 3))

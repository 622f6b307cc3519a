"""Anomaly detectors C1-C4 (+P14-P22) over the minute rollup, and the rolling detector W6.

Each detector returns rows in the common alert shape (``ALERT_COLUMNS``) plus ``detector``
and ``rank`` (its order inside the detector), which fix the suppression order of K9.
Statistics per community are tiny (one row per community) and are joined back on the
community key; the planner may broadcast them from measured sizes. Top-k cuts use a total
order (value, community, time/id) so both engines pick the same rows on ties, and every double
that feeds a threshold or an ordering is rounded first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import rollup as ru

ALERT_COLUMNS = ["alert_id", "alert_type", "severity", "subreddit", "message", "metric_value", "threshold",
                 "metadata", "detected_at"]
# FIXED VALUES: alert types, and below the wording of their messages.
DETECTOR_ORDER = {"SENTIMENT_ANOMALY": 1, "VOLUME_ANOMALY": 2, "KEYWORD_ANOMALY": 3, "EXTREME_POST": 4}
JSON_OPTS = {"ignoreNullFields": "false"}


def fmt(pattern: str, *vals: Column) -> Column:
    return F.format_string(pattern, *vals)


def ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def alert_id(alert_type: Column, community: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", alert_type, F.coalesce(community, F.lit("")), key), 256), 1, 16)


def z_severity(z: Column) -> Column:
    """P14."""
    return F.when(z > 3, "CRITICAL").when(z > 2.5, "HIGH").otherwise("MEDIUM")


def volume_severity(volume: Column, avg: Column, ratio: Column) -> Column:
    """LOW is unreachable while the multiplier is >= 2 (kept for fidelity)."""
    return F.when(volume > avg, F.when(ratio > 3, "HIGH").otherwise("MEDIUM")).otherwise(
        F.when(ratio < 0.5, "MEDIUM").otherwise("LOW")
    )


def engagement_severity(comments: Column, score: Column, sentiment: Column) -> Column:
    """Engagement is tested first, so a loud very negative post is HIGH, not CRITICAL."""
    return F.when((comments > 50) | (score > 100), "HIGH").when(sentiment < -0.7, "CRITICAL").otherwise("MEDIUM")


def sentiment_candidates(minutes: DataFrame, threshold: float = 2.0) -> DataFrame:
    stats = ru.sentiment_baseline(minutes)
    j = minutes.join(stats, "subreddit")
    z = tx.rnd(F.abs(F.col("avg_sentiment") - F.col("mean")) / F.col("std"), 6)
    return j.where(F.col("std") > 0).withColumn("z_score", z).where(F.col("z_score") > threshold)


def top_posts_per_bucket(posts: DataFrame, buckets: DataFrame, k: int = 5) -> DataFrame:
    """J5 without N+1: posts of the chosen buckets, newest ``k`` per bucket, as ordered arrays.

    ``buckets`` is a top-k result (bounded by its limit), so it is broadcast; the per-bucket
    cut is ``row_number() <= k``, which Spark plans with a partial WindowGroupLimit.
    """
    keys = buckets.select("subreddit", "minute")
    p = posts.select("subreddit", "minute", "created_utc", "id", "title", "permalink").join(F.broadcast(keys), ["subreddit", "minute"])
    w = Window.partitionBy("subreddit", "minute").orderBy(F.col("created_utc").desc(), F.col("id").desc())
    top = p.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return top.groupBy("subreddit", "minute").agg(
        F.array_sort(F.collect_list(F.struct("rn", "id", "title", "permalink"))).alias("_posts")
    ).select(
        "subreddit", "minute",
        F.transform("_posts", lambda s: s["id"]).alias("post_ids"),
        F.transform("_posts", lambda s: F.substring(s["title"], 1, 100)).alias("post_titles"),
        F.transform("_posts", lambda s: s["permalink"]).alias("post_links"),
    )


def sentiment_anomalies(minutes: DataFrame, posts: DataFrame, detected_at: Column,
                        threshold: float = 2.0, limit: int = 10) -> DataFrame:
    """Minute buckets more than ``threshold`` sample std devs from their community mean."""
    top = (sentiment_candidates(minutes, threshold)
           .orderBy(F.col("z_score").desc(), "subreddit", "minute").limit(limit)
           .withColumn("rank", F.row_number().over(Window.orderBy(F.col("z_score").desc(), "subreddit", "minute"))))
    linked = top.join(F.broadcast(top_posts_per_bucket(posts, top)), ["subreddit", "minute"], "left")
    empty = F.array().cast("array<string>")
    meta = F.struct(
        F.col("z_score"), F.col("std").alias("std_dev"), F.col("posts_count").alias("post_count"),
        ts_text(F.col("minute")).alias("timestamp"),
        F.coalesce("post_ids", empty).alias("post_ids"),
        F.coalesce("post_titles", empty).alias("post_titles"),
        F.coalesce("post_links", empty).alias("post_links"),
    )
    direction = F.when(F.col("avg_sentiment") < F.col("mean"), "negative").otherwise("positive")
    msg = fmt("r/%s sentiment (%.3f) is %.2f std devs from mean (%.3f), trending %s",
              F.col("subreddit"), tx.rnd("avg_sentiment", 3), tx.rnd("z_score", 2), tx.rnd("mean", 3), direction)
    return linked.select(
        alert_id(F.lit("SENTIMENT_ANOMALY"), F.col("subreddit"), ts_text(F.col("minute"))).alias("alert_id"),
        F.lit("SENTIMENT_ANOMALY").alias("alert_type"),
        z_severity(F.col("z_score")).alias("severity"),
        "subreddit",
        msg.alias("message"),
        F.col("avg_sentiment").alias("metric_value"),
        F.col("mean").alias("threshold"),
        F.to_json(meta, JSON_OPTS).alias("metadata"),
        detected_at.alias("detected_at"),
        F.lit(DETECTOR_ORDER["SENTIMENT_ANOMALY"]).alias("detector"),
        "rank",
    )


def volume_candidates(minutes: DataFrame, multiplier: float = 2.0) -> DataFrame:
    stats = minutes.groupBy("subreddit").agg((F.sum("posts_count") / F.count(F.lit(1))).alias("avg_volume"))
    j = minutes.join(stats, "subreddit")
    v, a = F.col("posts_count"), F.col("avg_volume")
    return (j.where((a > 0) & ((v > a * multiplier) | (v < a / multiplier)))
            .withColumn("ratio", tx.rnd(v / a, 6))
            .withColumn("gap", tx.rnd(F.abs(v - a), 6)))


def volume_anomalies(minutes: DataFrame, detected_at: Column, multiplier: float = 2.0, limit: int = 5) -> DataFrame:
    """Minute buckets with posts_count above ``multiplier``× or below 1/``multiplier`` of the mean."""
    order = [F.col("gap").desc(), F.col("subreddit"), F.col("minute")]
    top = volume_candidates(minutes, multiplier).orderBy(*order).limit(limit).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order)))
    v, a = F.col("posts_count"), F.col("avg_volume")
    direction = F.when(v > a, "spike").otherwise("drop")
    msg = fmt("r/%s volume %s: %d posts vs %.1f average (%.2fx)",
              F.col("subreddit"), direction, v, tx.rnd(a, 1), tx.rnd("ratio", 2))
    meta = F.struct(F.col("ratio"), ts_text(F.col("minute")).alias("timestamp"))
    return top.select(
        alert_id(F.lit("VOLUME_ANOMALY"), F.col("subreddit"), ts_text(F.col("minute"))).alias("alert_id"),
        F.lit("VOLUME_ANOMALY").alias("alert_type"),
        volume_severity(v, a, F.col("ratio")).alias("severity"),
        "subreddit", msg.alias("message"),
        v.cast("double").alias("metric_value"), tx.rnd(a, 6).alias("threshold"),
        F.to_json(meta, JSON_OPTS).alias("metadata"), detected_at.alias("detected_at"),
        F.lit(DETECTOR_ORDER["VOLUME_ANOMALY"]).alias("detector"), "rank",
    )


def cluster_anomalies(clusters: DataFrame, detected_at: Column, top_n: int = 5) -> DataFrame:
    """Negative or severe issue clusters; community is NULL, threshold 0.0."""
    order = [F.col("avg_sentiment").asc(), F.col("cluster_id").asc()]
    top = (clusters.where((F.col("avg_sentiment") < -0.1) | F.col("severity").isin("HIGH", "CRITICAL"))
           .orderBy(*order).limit(top_n).withColumn("rank", F.row_number().over(Window.orderBy(*order))))
    sev = F.when(F.col("severity").isin("HIGH", "CRITICAL"), F.col("severity")).otherwise(F.lit("MEDIUM"))
    meta = F.struct(F.col("cluster_id"), F.slice("keywords", 1, 3).alias("keywords"), F.col("post_count"),
                    F.slice("first_post_ids", 1, 10).alias("post_ids"))
    msg = fmt("Issue cluster '%s' has negative sentiment (%.3f) across %d posts",
              F.col("cluster_name"), tx.rnd("avg_sentiment", 3), F.col("post_count"))
    return top.select(
        alert_id(F.lit("KEYWORD_ANOMALY"), F.lit(None).cast("string"), F.col("cluster_id").cast("string")).alias("alert_id"),
        F.lit("KEYWORD_ANOMALY").alias("alert_type"), sev.alias("severity"),
        F.lit(None).cast("string").alias("subreddit"), msg.alias("message"),
        F.col("avg_sentiment").alias("metric_value"), F.lit(0.0).alias("threshold"),
        F.to_json(meta, JSON_OPTS).alias("metadata"), detected_at.alias("detected_at"),
        F.lit(DETECTOR_ORDER["KEYWORD_ANOMALY"]).alias("detector"), "rank",
    )


def extreme_candidates(scored: DataFrame, minutes: DataFrame, threshold: float = -0.5) -> DataFrame:
    """Posts joined to their (community, minute) bucket; the bucket mean is the signal."""
    neg = minutes.where(F.col("avg_sentiment") < threshold).select("subreddit", "minute", "avg_sentiment")
    return scored.join(neg, ["subreddit", "minute"], "inner")


def extreme_posts(scored: DataFrame, minutes: DataFrame, detected_at: Column,
                  threshold: float = -0.5, limit: int = 5) -> DataFrame:
    """C4: posts in very negative buckets, most negative first."""
    order = [F.col("avg_sentiment").asc(), F.col("id").asc()]
    top = extreme_candidates(scored, minutes, threshold).orderBy(*order).limit(limit).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order)))
    s = F.col("avg_sentiment")
    msg = fmt("r/%s: Very negative post (%.3f) - '%s...'", F.col("subreddit"), tx.rnd(s, 3), F.substring("title", 1, 100))
    meta = F.struct(F.col("id").alias("post_id"), F.col("score"), F.col("num_comments").alias("comments"),
                    F.substring("title", 1, 200).alias("title"), F.col("permalink"))
    return top.select(
        alert_id(F.lit("EXTREME_POST"), F.col("subreddit"), F.col("id")).alias("alert_id"),
        F.lit("EXTREME_POST").alias("alert_type"),
        engagement_severity(F.col("num_comments"), F.col("score"), s).alias("severity"),
        "subreddit", msg.alias("message"), s.alias("metric_value"), F.lit(float(threshold)).alias("threshold"),
        F.to_json(meta, JSON_OPTS).alias("metadata"), detected_at.alias("detected_at"),
        F.lit(DETECTOR_ORDER["EXTREME_POST"]).alias("detector"), "rank",
    )


def all_alerts(parts: list[DataFrame]) -> DataFrame:
    """The detectors' candidates in fixed detector order (the order K9 suppresses in)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rolling_anomalies(minutes: DataFrame, window_minutes: int = 60, threshold: float = 2.5) -> DataFrame:
    """Each minute bucket against the trailing ``window_minutes`` of its own community.

    A range frame on epoch seconds, partitioned by community: rows are minute buckets, so a
    partition holds at most one row per minute of history for that community.
    """
    t = F.unix_seconds(F.col("minute").cast("timestamp"))
    w = Window.partitionBy("subreddit").orderBy(t).rangeBetween(-window_minutes * 60, -1)
    u = F.round(F.col("avg_sentiment") * F.lit(1e6)).cast("bigint")
    m = (minutes
         .withColumn("prior_n", F.count(F.lit(1)).over(w))
         .withColumn("prior_mean", F.sum(u).over(w) / F.lit(1e6) / F.col("prior_n"))
         .withColumn("prior_std", tx.rnd(F.stddev_samp("avg_sentiment").over(w), 9)))
    z = tx.rnd(F.abs(F.col("avg_sentiment") - F.col("prior_mean")) / F.col("prior_std"), 6)
    return (m.where(F.col("prior_std") > 0).withColumn("z_score", z).where(F.col("z_score") > threshold)
            .select("subreddit", "minute", "avg_sentiment", "prior_n", "prior_mean", "prior_std", "z_score",
                    z_severity(F.col("z_score")).alias("severity")))


def micro(c: str) -> Column:
    """A sentiment in whole millionths."""
    return F.round(F.col(c) * F.lit(1e6)).cast("bigint")


def expanding_anomalies(minutes: DataFrame, threshold: float = 2.0, state: DataFrame | None = None) -> DataFrame:
    """Each minute bucket against all earlier ones of its community, by exact moments.

    ``state`` (subreddit, n, s1, s2) stands for the buckets before these; with it a stream judges a batch of settled
    windows as one pass over everything would. Buckets are rows of a rollup: one a minute and community.
    """
    before = Window.partitionBy("subreddit").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    u = micro("avg_sentiment")
    whole = "decimal(38,0)"
    x = minutes
    if state is not None:
        x = x.join(state.select("subreddit", F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2")), "subreddit", "left")
    prior = (("_n", F.lit(0)), ("_s1", F.lit(0)), ("_s2", F.lit(0)))
    n0, s10, s20 = (F.coalesce(F.col(c), z) if state is not None else z for c, z in prior)
    x = x.select(
        "subreddit", "minute", "avg_sentiment", (n0 + F.count(F.lit(1)).over(before)).alias("prior_n"),
        (s10 + F.coalesce(F.sum(u).over(before), F.lit(0))).cast(whole).alias("_a"),
        (s20.cast(whole) + F.coalesce(F.sum((u * u).cast("decimal(20,0)")).over(before), F.lit(0).cast("decimal(30,0)"))).cast(whole).alias("_b"))
    n = F.col("prior_n").cast("double")
    # n * sum of squares - square of the sum, in whole numbers: what is lost is lost in one division
    spread = (F.col("prior_n").cast("decimal(18,0)") * F.col("_b").cast("decimal(19,0)")).cast(whole) - (F.col("_a").cast("decimal(19,0)") * F.col("_a").cast("decimal(19,0)")).cast(whole)
    x = x.where((F.col("prior_n") >= 2) & (spread > 0)).select(
        "subreddit", "minute", "avg_sentiment", "prior_n", (F.col("_a").cast("double") / n / F.lit(1e6)).alias("prior_mean"),
        tx.rnd(F.sqrt(spread.cast("double") / (n * (n - 1))) / F.lit(1e6), 9).alias("prior_std"))
    z = tx.rnd(F.abs(F.col("avg_sentiment") - F.col("prior_mean")) / F.col("prior_std"), 6)
    return x.where(F.col("prior_std") > 0).withColumn("z_score", z).where(F.col("z_score") > threshold).withColumn("severity", z_severity(F.col("z_score")))

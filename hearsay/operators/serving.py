"""Dashboard queries V1-V14, views T5-T6, rankings T10-T11, labels P29-P30.

Each is a small aggregate over the enriched posts or the minute rollup. Global totals over
per-group rows use ``sum(...) over ()`` only on already-aggregated rows (one per community or
severity), never on row-level data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import fixtures as fx


def _units_mean(c: str, units: float = 1e4) -> Column:
    return F.sum(F.round(F.col(c) * F.lit(units)).cast("bigint")) / F.lit(units) / F.count(c)


def stats(scored: DataFrame, ledger: DataFrame) -> DataFrame:
    """V1: total posts, mean sentiment, open CRITICAL alerts, extraction rate (% with a product)."""
    p = scored.agg(
        F.count(F.lit(1)).alias("total_posts"), _units_mean("compound").alias("avg_sentiment"),
        (F.count_if(F.col("primary_product").isNotNull()) * F.lit(100.0) / F.count(F.lit(1))).alias("extraction_rate"))
    crit = ledger.where((F.col("severity") == "CRITICAL") & ~F.col("resolved")).select(F.count(F.lit(1))).scalar()
    return p.select("total_posts", "avg_sentiment", crit.alias("critical_alerts"), tx.rnd("extraction_rate", 1).alias("extraction_rate"))


def products(scored: DataFrame, sentiments: DataFrame) -> DataFrame:
    """V4: post count and mean bucket sentiment per primary product."""
    j = scored.where(F.col("primary_product").isNotNull()).select("id", "primary_product").join(
        sentiments.select("id", "sentiment"), "id")
    return j.groupBy("primary_product").agg(F.count(F.lit(1)).alias("post_count"),
                                            (F.sum(F.round(F.col("sentiment") * F.lit(1e6)).cast("bigint")) / F.lit(1e6)
                                             / F.count(F.lit(1))).alias("avg_sentiment"))


def products_ranked(prod: DataFrame) -> DataFrame:
    """Rank by posts and by sentiment (NULL → 0), best product flagged."""
    by_posts = Window.orderBy(F.col("post_count").desc(), "primary_product")
    by_sent = Window.orderBy(F.coalesce(F.col("avg_sentiment"), F.lit(0.0)).desc(), "primary_product")
    return prod.select("primary_product", "post_count", "avg_sentiment",
                       F.row_number().over(by_posts).alias("rank_by_posts"),
                       F.row_number().over(by_sent).alias("rank_by_sentiment")).withColumn(
        "is_best", F.col("rank_by_sentiment") == 1)


def product_categories(prod: DataFrame) -> DataFrame:
    """Category by the display-name lists. Stored labels are slugs (``model_y``), so the
    faithful test (``category_as_stored``) puts everything in *other*; ``category`` first maps the
    slug to its display name (``model_y`` → ``Model Y``)."""
    display = F.initcap(F.replace(F.col("primary_product"), F.lit("_"), F.lit(" ")))

    def cat(name: Column) -> Column:
        return (F.when(name.isin(*fx.VEHICLE_DISPLAY), "vehicle").when(name.isin(*fx.ENERGY_DISPLAY), "energy")
                .otherwise("other"))

    return prod.select("primary_product", display.alias("display_name"),
                       cat(F.col("primary_product")).alias("category_as_stored"), cat(display).alias("category"))


def community_stats(minutes: DataFrame) -> DataFrame:
    """V8: per community posts, posts-weighted mean, category percentages (1 place), total posts."""
    g = minutes.groupBy("subreddit").agg(
        F.sum("posts_count").alias("post_count"),
        F.sum(F.round(F.col("avg_sentiment") * F.col("posts_count") * F.lit(1e4)).cast("bigint")).alias("_u"),
        F.sum("positive_count").alias("_p"), F.sum("negative_count").alias("_n"), F.sum("neutral_count").alias("_z"))
    pct = lambda c: tx.rnd(F.col(c) * F.lit(100.0) / F.col("post_count"), 1)
    return g.select("subreddit", "post_count", (F.col("_u") / F.lit(1e4) / F.col("post_count")).alias("avg_sentiment"),
                    pct("_p").alias("positive_percent"), pct("_n").alias("negative_percent"),
                    pct("_z").alias("neutral_percent"),
                    F.sum("post_count").over(Window.partitionBy()).alias("all_posts"))


def distribution(minutes: DataFrame) -> DataFrame:
    """V9: category totals."""
    return minutes.agg(F.sum("positive_count").alias("positive_count"), F.sum("negative_count").alias("negative_count"),
                       F.sum("neutral_count").alias("neutral_count"), F.sum("posts_count").alias("total"))


def posts_by_community(scored: DataFrame, k: int = 10) -> DataFrame:
    """Post counts per community, top ``k``."""
    return (scored.groupBy("subreddit").agg(F.count(F.lit(1)).alias("post_count"))
            .orderBy(F.col("post_count").desc(), "subreddit").limit(k))


def timeline(minutes: DataFrame, at: Column, days: int = 7, community: str | None = None) -> DataFrame:
    """V5: hourly posts-weighted sentiment of the last ``days`` days (optional community)."""
    m = minutes.where(F.col("minute") >= at - F.expr(f"INTERVAL {days} DAYS"))
    if community is not None:
        m = m.where(F.col("subreddit") == community)
    h = m.groupBy(tx.hour_bucket("minute").alias("time")).agg(
        F.sum(F.round(F.col("avg_sentiment") * F.col("posts_count") * F.lit(1e4)).cast("bigint")).alias("_u"),
        F.sum("posts_count").alias("posts"))
    return h.select("time", (F.col("_u") / F.lit(1e4) / F.col("posts")).alias("sentiment"), "posts")


def volume_timeline(minutes: DataFrame) -> DataFrame:
    """Posts per hour and community."""
    return minutes.groupBy(tx.hour_bucket("minute").alias("hour"), "subreddit").agg(F.sum("posts_count").alias("posts"))


def realtime_24h(minutes: DataFrame, at: Column) -> DataFrame:
    """T5: minute rows of the last 24 h (the anomaly flag is never written upstream: FALSE)."""
    return minutes.where(F.col("minute") >= at - F.expr("INTERVAL 24 HOURS")).select(
        F.col("minute").alias("timestamp"), "subreddit", "posts_count", "avg_sentiment", "positive_count",
        "negative_count", "neutral_count", F.lit(False).alias("anomaly_detected"))


def top_posts_weekly(scored: DataFrame, at: Column, k: int = 100) -> DataFrame:
    """Top ``k`` posts by score of the last 7 days (a global limit, as in the reference)."""
    return (scored.where(F.col("created_utc") >= at - F.expr("INTERVAL 7 DAYS"))
            .orderBy(F.col("score").desc(), "id").limit(k)
            .select("id", "subreddit", "title", "author", "score", "num_comments", "created_utc", "url"))


def top_engagement(scored: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` posts by score + comments."""
    e = F.col("score") + F.col("num_comments")
    return (scored.select("id", "subreddit", "title", "score", "num_comments", e.alias("engagement"))
            .orderBy(F.col("engagement").desc(), "id").limit(k))


def product_detail(scored: DataFrame, sentiments: DataFrame) -> DataFrame:
    """Per product all its issues, most common first, and the communities it appears in."""
    p = scored.where(F.col("primary_product").isNotNull())
    issues = (p.select("primary_product", F.explode("entities.issues").alias("issue"))
              .groupBy("primary_product", "issue").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("primary_product").orderBy(F.col("n").desc(), "issue")
    top = (issues.withColumn("_r", F.row_number().over(w))
           .groupBy("primary_product").agg(F.sort_array(F.collect_list(F.struct("_r", "issue"))).alias("_i"))
           .select("primary_product", F.transform("_i", lambda s: s["issue"]).alias("common_issues")))
    comms = (p.select("primary_product", "subreddit").distinct().groupBy("primary_product")
             .agg(F.sort_array(F.collect_list("subreddit")).alias("related_subreddits")))
    base = products(scored, sentiments)
    return base.join(top, "primary_product", "left").join(comms, "primary_product", "left").select(
        "primary_product", "post_count", "avg_sentiment",
        F.coalesce("common_issues", F.array().cast("array<string>")).alias("common_issues"), "related_subreddits")


def community_entities(scored: DataFrame) -> DataFrame:
    """Entity mentions per community (sum of family sizes)."""
    return scored.groupBy("subreddit").agg(
        F.sum(F.size("entities.vehicles")).alias("vehicles"),
        F.sum(F.size("entities.energy_products")).alias("energy_products"),
        F.sum(F.size("entities.issues")).alias("issues"))


def sentiment_labels(minutes: DataFrame) -> DataFrame:
    """The four threshold sets side by side on minute means."""
    s = "avg_sentiment"
    return minutes.select(
        "minute", "subreddit", s,
        tx.sentiment_category(s).alias("category"),
        tx.sentiment_label(s, 0.1, -0.1).alias("distribution_bucket"),
        tx.sentiment_label(s, 0.2, 0.0).alias("badge"),
        tx.sentiment_label(s, 0.2, -0.2, labels=("Positive", "Negative", "Neutral")).alias("chart_label"))


def _hourly(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hourly mean of post sentiments and number of posts, by ``keys``."""
    return rows.groupBy(*keys, tx.hour_bucket("minute").alias("time")).agg(_units_mean("sentiment", 1e6).alias("sentiment"), F.count(F.lit(1)).alias("posts"))


def _top_posts(scored: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "id")
    top = scored.where(F.col(key).isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select(*dict.fromkeys([key, "rank", "id", "title", "subreddit", "created_utc", "score", "num_comments", "permalink"]))


def product_timeline(scored: DataFrame, sentiments: DataFrame, at: Column, days: int = 7) -> DataFrame:
    """Per product and hour of the last ``days`` days the mean sentiment and the posts."""
    recent = scored.where(F.col("primary_product").isNotNull() & (F.col("minute") >= at - F.expr(f"INTERVAL {days} DAYS")))
    return _hourly(recent.select("id", "primary_product", "minute").join(sentiments.select("id", "sentiment"), "id"), ["primary_product"])


def product_top_posts(scored: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` posts of the highest score per product."""
    return _top_posts(scored, "primary_product", k)


def community_timeline(minutes: DataFrame, at: Column, days: int = 7) -> DataFrame:
    """Per community and hour of the last ``days`` days, from minute rows."""
    h = minutes.where(F.col("minute") >= at - F.expr(f"INTERVAL {days} DAYS")).groupBy("subreddit", tx.hour_bucket("minute").alias("time")).agg(
        F.sum(F.round(F.col("avg_sentiment") * F.col("posts_count") * F.lit(1e4)).cast("bigint")).alias("_u"), F.sum("posts_count").alias("posts"))
    return h.select("subreddit", "time", (F.col("_u") / F.lit(1e4) / F.col("posts")).alias("sentiment"), "posts")


def community_top_posts(scored: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` posts of the highest score per community."""
    return _top_posts(scored, "subreddit", k)


def community_detail(minutes: DataFrame, scored: DataFrame, ledger: DataFrame) -> DataFrame:
    """A community's numbers, its entity mentions and its open alerts (count, and ids newest first)."""
    newest = F.sort_array(F.collect_list(F.struct(F.col("detected_at"), F.col("alert_id"))), asc=False)
    alerts = ledger.where(~F.col("resolved") & F.col("subreddit").isNotNull()).groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("_n"), F.slice(F.transform(newest, lambda a: a["alert_id"]), 1, 10).alias("_ids"))
    out = community_stats(minutes).join(community_entities(scored), "subreddit", "left").join(alerts, "subreddit", "left")
    return out.select("subreddit", "post_count", "avg_sentiment", "positive_percent", "negative_percent", "neutral_percent", "vehicles", "energy_products", "issues",
                      F.coalesce("_n", F.lit(0)).alias("active_alerts"), F.coalesce("_ids", F.array().cast("array<string>")).alias("alert_ids"))


def communities_ranked(minutes: DataFrame) -> DataFrame:
    """Communities by posts and by sentiment (NULL → 0), the first of either flagged. One row a community."""
    x = community_stats(minutes).select("subreddit", "post_count", "avg_sentiment")
    by_posts = Window.orderBy(F.col("post_count").desc(), "subreddit")
    by_sentiment = Window.orderBy(F.coalesce(F.col("avg_sentiment"), F.lit(0.0)).desc(), "subreddit")
    x = x.withColumns({"rank_by_posts": F.row_number().over(by_posts), "rank_by_sentiment": F.row_number().over(by_sentiment)})
    return x.withColumns({"most_posts": F.col("rank_by_posts") == 1, "best_sentiment": F.col("rank_by_sentiment") == 1})

"""Query catalog: one plan per key of SURVEY §2, each ``fn(run) -> DataFrame``.

Keys match ``plans.oracle.ORACLE`` (DuckDB SQL of the same meaning) where one exists; the
key of ``pyspark.ml``'s K-Means has no SQL twin and is checked on rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import entities as en
from ..functions import text as tx
from ..functions import validate as va
from ..operators import alerts as al
from ..operators import anomaly as an
from ..operators import clusters as cl
from ..operators import daily as dy
from ..operators import incremental as inc
from ..operators import quality as qu
from ..operators import rollup as ru
from ..operators import serving as sv
from ..operators import sinks as sk
from ..operators import topics as tp
from ..sources import adapter, listing, tables
from ..sources import fixtures as fx
from .context import Run

PLANS: dict[str, Callable[[Run], DataFrame]] = {}
ROWS_ONLY: set[str] = set()


def plan(key: str, rows_only: bool = False):
    def deco(fn):
        PLANS[key] = fn
        if rows_only:
            ROWS_ONLY.add(key)
        return fn
    return deco


def run(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return PLANS[key](Run(spark, sf_dir))


def h24():
    return F.expr("INTERVAL 24 HOURS")

# ---------------------------------------------------------------------------------------------
# Sources, validation, scalar projections
# ---------------------------------------------------------------------------------------------


@plan("posts_scan")
def _posts_scan(r: Run) -> DataFrame:
    """S3: the clean posts table (valid, first write wins, permalink built)."""
    return r.posts.drop("msg_offset")


@plan("listing_normalize")
def _listing_normalize(r: Run) -> DataFrame:
    """Listings built from the landing log, parsed back with absent-key defaults."""
    return listing.normalize(listing.listings_from_messages(r.landing), r.as_of)


@plan("kafka_payload")
def _kafka_payload(r: Run) -> DataFrame:
    """K1: the keyed message frame of the clean posts."""
    return listing.message_payload(r.posts)


def _payloads(r: Run) -> DataFrame:
    """Landing messages as JSON with null fields absent; every 43rd document sends num_comments
    as text — the type error the schema check must catch."""
    odd = F.substring("id", 2, 20).cast("bigint") % 43 == 0
    as_text = listing.message_value(False, {"num_comments": F.col("num_comments").cast("string")})
    return r.landing.select(F.col("id").alias("key"),
                            F.when(odd, as_text).otherwise(listing.message_value(False)).alias("value"))


@plan("schema_validate")
def _schema_validate(r: Run) -> DataFrame:
    """P5: JSON-schema check of each message; at most one error."""
    p = _payloads(r)
    v = va.validate(F.col("value"))
    return p.select(F.col("key").alias("id"), v["is_valid"].alias("is_valid"), v["errors"].alias("errors"))


@plan("missing_fields")
def _missing_fields(r: Run) -> DataFrame:
    """Completeness of each message."""
    p = _payloads(r)
    m = va.missing_fields(F.col("value"))
    return p.select(F.col("key").alias("id"), (F.size(m) == 0).alias("is_complete"), m.alias("missing"))


@plan("required_fields_filter")
def _required_fields_filter(r: Run) -> DataFrame:
    """Messages with all required fields present (empty strings pass)."""
    return r.landing.where(adapter.required_present(r.landing)).select("msg_offset", "id", "title", "author")


@plan("permalink_build")
def _permalink_build(r: Run) -> DataFrame:
    """Raw permalink shapes → absolute URLs."""
    return r.landing.select("msg_offset", F.col("permalink").alias("raw"), tx.build_permalink("permalink").alias("permalink"))


@plan("epoch_to_ts")
def _epoch_to_ts(r: Run) -> DataFrame:
    """Epoch seconds and ISO text → TIMESTAMP (UTC)."""
    e = F.unix_seconds(F.col("created_utc").cast("timestamp"))
    iso = F.date_format("created_utc", "yyyy-MM-dd'T'HH:mm:ss")
    return r.posts.select("id", e.alias("epoch"), tx.epoch_to_ts(e).alias("from_epoch"), tx.iso_to_ts(iso).alias("from_iso"))


@plan("combine_text")
def _combine_text(r: Run) -> DataFrame:
    """The scoring text and the topics text (lengths and digests of the whole texts)."""
    s, t = tx.combine_for_scoring(), tx.combine_for_topics()
    return r.posts.select("id", F.length(s).alias("scoring_len"), F.length(t).alias("topics_len"),
                          F.sha2(s.cast("binary"), 256).alias("scoring_sha256"), F.sha2(t.cast("binary"), 256).alias("topics_sha256"))


@plan("entity_tags")
def _entity_tags(r: Run) -> DataFrame:
    """Entity families per post."""
    return r.scored.select("id", F.col("entities.vehicles").alias("vehicles"),
                           F.col("entities.energy_products").alias("energy_products"),
                           F.col("entities.issues").alias("issues"), "primary_product")


@plan("primary_product")
def _primary_product(r: Run) -> DataFrame:
    """Posts per primary product (NULL included)."""
    return r.scored.groupBy("primary_product").agg(F.count(F.lit(1)).alias("posts"))


@plan("sentiment_score")
def _sentiment_score(r: Run) -> DataFrame:
    """P9/J9."""
    return r.scored.select("id", "subreddit", "minute", "compound", "category")


@plan("sentiment_lexicon")
def _sentiment_lexicon(r: Run) -> DataFrame:
    """P9 with another lexicon, passed as a table."""
    return Run(r.spark, r.sf_dir, fx.SERVICE_LEXICON).scored.select("id", "compound", "category")


@plan("sentiment_category")
def _sentiment_category(r: Run) -> DataFrame:
    """P10: posts per category."""
    return r.scored.groupBy("category").agg(F.count(F.lit(1)).alias("posts"))


@plan("minute_bucket")
def _minute_bucket(r: Run) -> DataFrame:
    """P25: minute truncation."""
    return r.posts.select("id", "created_utc", tx.minute_bucket("created_utc").alias("minute"))


@plan("date_parts")
def _date_parts(r: Run) -> DataFrame:
    """DATE(), EXTRACT(HOUR), minutes between ingest and creation."""
    return r.posts.select("id", F.to_date("ingested_at").alias("ingest_date"), F.hour("created_utc").alias("hour"),
                          tx.minutes_between(F.col("ingested_at"), F.col("created_utc")).alias("ingest_lag_minutes"))


# ---------------------------------------------------------------------------------------------
# Sinks and ingestion bookkeeping (batch 1 = arrived before as_of - 24h, batch 2 = the rest)
# ---------------------------------------------------------------------------------------------


def _batches(r: Run):
    return sk.batch_split(r.landing, r.as_of - h24())


@plan("insert_if_absent")
def _insert_if_absent(r: Run) -> DataFrame:
    """K2: batch 2 rows appended to the table built from batch 1 (first write wins)."""
    b1, b2 = _batches(r)
    stored = sk.insert_if_absent(b1, b1.limit(0))
    return sk.insert_if_absent(b2, stored).select("id", "score", "num_comments", "ingested_at")


@plan("ingest_counts")
def _ingest_counts(r: Run) -> DataFrame:
    """K3: inserted / duplicate / error counts of batch 2."""
    b1, b2 = _batches(r)
    stored = sk.insert_if_absent(b1, b1.limit(0))
    return sk.ingest_counts(b2, sk.insert_if_absent(b2, stored))


@plan("rollup_merge")
def _rollup_merge(r: Run) -> DataFrame:
    """K4: per-batch integer partials merged by sum equal the one-shot rollup."""
    cut = r.as_of - h24()
    p1 = ru.minute_partials(r.scored.where(F.col("ingested_at") < cut))
    p2 = ru.minute_partials(r.scored.where(F.col("ingested_at") >= cut))
    return ru.finish(ru.merge_partials(p1.unionByName(p2)))


def _slices(r: Run, n: int = 4) -> list[int]:
    """The offsets that cut the log into ``n`` batches."""
    top = r.landing.agg(F.max("msg_offset")).first()[0]
    return [] if top is None else [top * (k + 1) // n for k in range(n)]


@plan("rollup_incremental")
def _rollup_incremental(r: Run) -> DataFrame:
    """The log processed in four batches, partials of dirty minutes appended, folded once on the way."""
    rollup = inc.IncrementalRollup(r.spark, r.scratch("incremental"), r.lexicon)
    for k, upto in enumerate(_slices(r)):
        rollup.advance(r.landing, upto)
        if k == 1:
            rollup.compact()
    return rollup.minutes()


@plan("ingest_batches")
def _ingest_batches(r: Run) -> DataFrame:
    """K2/K3: inserted / duplicate / error counts of each of the four batches."""
    rollup = inc.IncrementalRollup(r.spark, r.scratch("incremental"), r.lexicon)
    for upto in _slices(r):
        rollup.advance(r.landing, upto)
    return rollup.batches()


@plan("unscored_posts")
def _unscored_posts(r: Run) -> DataFrame:
    """Posts of batch 2 whose (community, minute) bucket batch 1 has not created yet."""
    cut = r.as_of - h24()
    old = ru.minute_rollup(r.scored.where(F.col("ingested_at") < cut)).select("subreddit", "minute")
    new = r.posts.where(F.col("ingested_at") >= cut).select("id", "subreddit", "minute")
    return new.join(old, ["subreddit", "minute"], "left_anti")


@plan("enrich_update")
def _enrich_update(r: Run) -> DataFrame:
    """K6: entities and primary product set by id on the posts table."""
    e = sk.enrich_update(r.posts.select("id", "subreddit"), r.scored.select("id", "entities", "primary_product"))
    return e.select("id", F.col("entities.vehicles").alias("vehicles"),
                    F.col("entities.energy_products").alias("energy_products"), F.col("entities.issues").alias("issues"),
                    "primary_product")


@plan("lake_partitions")
def _lake_partitions(r: Run) -> DataFrame:
    """Posts written as a year/month/day/hour Parquet lake; rows per partition read back."""
    root = r.scratch("lake")
    sk.lake_write(r.posts, root)
    return sk.lake_counts(r.spark, root)


# ---------------------------------------------------------------------------------------------
# Rollups, baselines, distributions, quality
# ---------------------------------------------------------------------------------------------


@plan("minute_rollup")
def _minute_rollup(r: Run) -> DataFrame:
    return r.minutes


@plan("sentiment_run_summary")
def _sentiment_run_summary(r: Run) -> DataFrame:
    """A2: run totals, percentages (guarded by max(total, 1)), entities extracted."""
    g = r.scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("category") == "positive").alias("positive"),
                     F.count_if(F.col("category") == "negative").alias("negative"),
                     F.count_if(F.col("category") == "neutral").alias("neutral"),
                     F.count_if(F.col("primary_product").isNotNull()).alias("entities_extracted"))
    d = F.greatest(F.col("total"), F.lit(1))
    pct = lambda c: tx.rnd(F.col(c) * F.lit(100.0) / d, 1)
    return g.select("*", pct("positive").alias("positive_pct"), pct("negative").alias("negative_pct"),
                    pct("neutral").alias("neutral_pct"), pct("entities_extracted").alias("entities_pct"))


@plan("sentiment_baseline")
def _sentiment_baseline(r: Run) -> DataFrame:
    """A3."""
    return ru.sentiment_baseline(r.minutes).select("subreddit", F.col("mean").alias("mean_sentiment"),
                                                   F.col("std").alias("std_sentiment"), "sample_size")


@plan("volume_baseline")
def _volume_baseline(r: Run) -> DataFrame:
    """A4."""
    return r.minutes.groupBy("subreddit").agg(
        (F.sum("posts_count") / F.count(F.lit(1))).alias("avg_volume"), tx.rnd(F.stddev_samp("posts_count"), 9).alias("std_volume"),
        F.max("posts_count").alias("max_volume"), F.min("posts_count").alias("min_volume"))


@plan("sentiment_distribution")
def _sentiment_distribution(r: Run) -> DataFrame:
    """A5/F1/W1 over the last 7 days."""
    return qu.distribution(r.minutes, r.as_of - F.expr("INTERVAL 7 DAYS"), r.as_of)


@plan("data_freshness")
def _data_freshness(r: Run) -> DataFrame:
    """A6/F2."""
    return qu.freshness(r.posts, r.as_of).orderBy(F.col("minutes_ago").desc(), "subreddit")


def _checks(r: Run) -> DataFrame:
    return qu.run_checks(r.landing, r.as_of)


@plan("dq_freshness")
def _dq_freshness(r: Run) -> DataFrame:
    return _checks(r).where(F.col("check_name") == "data_freshness")


@plan("dq_duplicates")
def _dq_duplicates(r: Run) -> DataFrame:
    return _checks(r).where(F.col("check_name") == "duplicate_detection")


@plan("dq_schema")
def _dq_schema(r: Run) -> DataFrame:
    return _checks(r).where(F.col("check_name") == "schema_validation")


@plan("dq_completeness")
def _dq_completeness(r: Run) -> DataFrame:
    return _checks(r).where(F.col("check_name") == "completeness")


@plan("dq_overall")
def _dq_overall(r: Run) -> DataFrame:
    return qu.overall(_checks(r))


@plan("dq_metrics_log")
def _dq_metrics_log(r: Run) -> DataFrame:
    return r.quality_log


@plan("dq_weekly_summary")
def _dq_weekly_summary(r: Run) -> DataFrame:
    return qu.weekly_summary(r.quality_log, r.as_of)


@plan("dq_latest")
def _dq_latest(r: Run) -> DataFrame:
    return qu.latest(r.quality_log)


# ---------------------------------------------------------------------------------------------
# Anomalies and alerts
# ---------------------------------------------------------------------------------------------


@plan("anomaly_sentiment")
def _anomaly_sentiment(r: Run) -> DataFrame:
    return an.sentiment_anomalies(r.minutes, r.scored, r.as_of)


@plan("anomaly_sentiment_posts")
def _anomaly_sentiment_posts(r: Run) -> DataFrame:
    """Newest five posts of each flagged bucket."""
    top = an.sentiment_candidates(r.minutes).orderBy(F.col("z_score").desc(), "subreddit", "minute").limit(10)
    return an.top_posts_per_bucket(r.scored, top)


@plan("anomaly_volume")
def _anomaly_volume(r: Run) -> DataFrame:
    return an.volume_anomalies(r.minutes, r.as_of)


@plan("anomaly_clusters")
def _anomaly_clusters(r: Run) -> DataFrame:
    return an.cluster_anomalies(r.clusters, r.as_of)


@plan("anomaly_extreme_posts")
def _anomaly_extreme_posts(r: Run) -> DataFrame:
    return an.extreme_posts(r.scored, r.minutes, r.as_of)


@plan("alerts_all")
def _alerts_all(r: Run) -> DataFrame:
    """Current candidates of the four detectors in detector order."""
    return r.current_candidates


@plan("alerts_dedupe")
def _alerts_dedupe(r: Run) -> DataFrame:
    """Candidates accepted after suppression against the stored ledger."""
    return r.alert_ledger.raised(r.run_id(0))


@plan("alerts_autoresolve")
def _alerts_autoresolve(r: Run) -> DataFrame:
    """The stored ledger's state after the current run."""
    return r.ledger


@plan("anomaly_run_summary")
def _anomaly_run_summary(r: Run) -> DataFrame:
    return al.run_summary(r.current_candidates)


@plan("alert_messages")
def _alert_messages(r: Run) -> DataFrame:
    """P20."""
    return r.current_candidates.select("alert_id", "alert_type", "message")


@plan("alert_metadata")
def _alert_metadata(r: Run) -> DataFrame:
    """P22."""
    return r.current_candidates.select("alert_id", "metadata")


@plan("alerts_by_severity")
def _alerts_by_severity(r: Run) -> DataFrame:
    return al.by_severity(r.ledger, r.as_of)


@plan("alerts_by_type")
def _alerts_by_type(r: Run) -> DataFrame:
    return al.by_type(r.ledger, r.as_of)


@plan("critical_alert_gate")
def _critical_alert_gate(r: Run) -> DataFrame:
    return al.critical_gate(r.ledger, r.as_of)


@plan("recent_critical")
def _recent_critical(r: Run) -> DataFrame:
    return al.recent_critical(r.ledger)


@plan("alerts_feed")
def _alerts_feed(r: Run) -> DataFrame:
    return al.feed(r.ledger).select(*al.LEDGER_COLUMNS)


@plan("alert_counts")
def _alert_counts(r: Run) -> DataFrame:
    return al.open_counts(r.ledger)


@plan("alert_resolve")
def _alert_resolve(r: Run) -> DataFrame:
    """Resolve the open alert with the smallest id, in a copy of the ledger; the resolution is one more event."""
    ledger = r.alert_ledger.copy(r.scratch("ledger-copy"))
    target = ledger.state().where(~F.col("resolved")).agg(F.min("alert_id")).first()[0]
    matched = ledger.resolve(target, r.as_of, "by-hand") if target is not None else 0
    return ledger.state().select("alert_id", "resolved", "resolved_at", F.coalesce((F.col("alert_id") == F.lit(target)) & F.lit(matched > 0), F.lit(False)).alias("matched"))


@plan("alert_links")
def _alert_links(r: Run) -> DataFrame:
    return al.links(r.ledger)


@plan("notify_candidates")
def _notify_candidates(r: Run) -> DataFrame:
    return al.notify_candidates(r.ledger, r.as_of)


@plan("rolling_anomaly")
def _rolling_anomaly(r: Run) -> DataFrame:
    return an.rolling_anomalies(r.minutes)


@plan("declared_alert_rules")
def _declared_alert_rules(r: Run) -> DataFrame:
    """C11: the configured alert rules evaluated as threshold filters."""
    fresh = qu.freshness(r.posts, r.as_of).where(F.col("minutes_ago") > 10).select(
        F.lit("data_freshness").alias("rule"), F.lit("high").alias("severity"), "subreddit",
        tx.rnd("minutes_ago", 2).alias("value"), F.lit(10.0).alias("threshold"))
    neg = sv.community_stats(r.minutes).where(F.col("negative_percent") / 100 > 0.5).select(
        F.lit("negative_sentiment_spike").alias("rule"), F.lit("medium").alias("severity"), "subreddit",
        (F.col("negative_percent") / 100).alias("value"), F.lit(0.5).alias("threshold"))
    b1, b2 = _batches(r)
    counts = sk.ingest_counts(b2, sk.insert_if_absent(b2, sk.insert_if_absent(b1, b1.limit(0))))
    rate = F.col("errors") / (F.col("inserted") + F.col("duplicates") + F.col("errors"))
    err = counts.where(rate > 0.05).select(
        F.lit("processing_error_rate").alias("rule"), F.lit("high").alias("severity"),
        F.lit(None).cast("string").alias("subreddit"), tx.rnd(rate, 6).alias("value"), F.lit(0.05).alias("threshold"))
    vol = an.volume_candidates(r.minutes, 3.0).where(F.col("posts_count") > F.col("avg_volume")).groupBy("subreddit").agg(
        F.max("ratio").alias("value")).select(F.lit("volume_spike_3x").alias("rule"), F.lit("medium").alias("severity"),
                                              "subreddit", "value", F.lit(3.0).alias("threshold"))
    hourly = r.minutes.groupBy("subreddit", tx.hour_bucket("minute").alias("hour")).agg(
        F.sum(F.round(F.col("avg_sentiment") * F.col("posts_count") * F.lit(1e4)).cast("bigint")).alias("_u"),
        F.sum("posts_count").alias("_n")).withColumn("s", F.col("_u") / F.lit(1e4) / F.col("_n"))
    prev = F.lag("s").over(Window.partitionBy("subreddit").orderBy("hour"))  # hourly rows per community
    drop = hourly.withColumn("prev", prev).where((F.col("prev") > 0) & (F.col("s") < F.col("prev") * F.lit(0.5))).groupBy(
        "subreddit").agg(F.max(tx.rnd((F.col("prev") - F.col("s")) / F.col("prev"), 6)).alias("value")).select(
        F.lit("sentiment_drop").alias("rule"), F.lit("medium").alias("severity"), "subreddit", "value",
        F.lit(0.5).alias("threshold"))
    words = tp.keyword_bursts(r.keyword_hits).groupBy("subreddit").agg(F.max("ratio").alias("value")).select(
        F.lit("keyword_frequency").alias("rule"), F.lit("medium").alias("severity"), "subreddit", "value", F.lit(2.0).alias("threshold"))
    return fresh.unionByName(neg).unionByName(err).unionByName(vol).unionByName(drop).unionByName(words)


@plan("keyword_frequency_anomaly")
def _keyword_frequency_anomaly(r: Run) -> DataFrame:
    """C11: days on which a keyword bursts against the week before."""
    return tp.keyword_bursts(r.keyword_hits)


# ---------------------------------------------------------------------------------------------
# Daily metrics
# ---------------------------------------------------------------------------------------------


@plan("daily_peak_hour")
def _daily_peak_hour(r: Run) -> DataFrame:
    return dy.peak_hour(r.scored, r.minutes)


@plan("daily_top_posts")
def _daily_top_posts(r: Run) -> DataFrame:
    return dy.top_posts(r.scored)


@plan("daily_metrics")
def _daily_metrics(r: Run) -> DataFrame:
    """True whole-day metrics."""
    return dy.whole_day(r.scored)


@plan("daily_metrics_full")
def _daily_metrics_full(r: Run) -> DataFrame:
    """daily_metrics table rows for every date and community."""
    return dy.daily_table(r.scored, r.minutes)


@plan("upsert_replace")
def _upsert_replace(r: Run) -> DataFrame:
    """K5: yesterday's stored table (batch 1 data), of which the days that batch 2 touches are recomputed and overwritten."""
    cut = r.as_of - h24()
    s1 = r.scored.where(F.col("ingested_at") < cut)
    root = sk.overwrite_days(dy.daily_table(s1, ru.minute_rollup(s1)), r.scratch("daily"))
    return r.spark.read.parquet(sk.overwrite_days(dy.daily_table(r.scored, r.minutes).where(F.col("date") >= F.to_date(cut)), root))


@plan("distinct_communities")
def _distinct_communities(r: Run) -> DataFrame:
    """A9."""
    return r.posts.select("subreddit").distinct()


# ---------------------------------------------------------------------------------------------
# Topics and clusters
# ---------------------------------------------------------------------------------------------


@plan("tfidf_keywords")
def _tfidf_keywords(r: Run) -> DataFrame:
    """C6/W5."""
    return r.topics


@plan("keyword_stats")
def _keyword_stats(r: Run) -> DataFrame:
    """The topics table."""
    return r.topic_stats


def _topics_table(r: Run) -> DataFrame:
    return r.topic_stats


@plan("topic_counts")
def _topic_counts(r: Run) -> DataFrame:
    """Keywords per community."""
    return _topics_table(r).groupBy("subreddit").agg(F.count(F.lit(1)).alias("keyword_count"))


@plan("topic_report")
def _topic_report(r: Run) -> DataFrame:
    """Keywords per community, with the numbers of communities and clusters."""
    per = _topics_table(r).groupBy("subreddit").agg(F.count(F.lit(1)).alias("keyword_count"))
    return per.select("subreddit", "keyword_count", F.count(F.lit(1)).over(Window.partitionBy()).alias("communities"),
                      r.clusters.select(F.count(F.lit(1))).scalar().alias("clusters"))


@plan("top_keywords")
def _top_keywords(r: Run) -> DataFrame:
    """The five best keywords overall."""
    return _topics_table(r).orderBy(F.col("score").desc(), "keyword", "subreddit").limit(5).select("keyword", "subreddit", "score")


@plan("topics_feed")
def _topics_feed(r: Run) -> DataFrame:
    """V6: top 20 topics by score."""
    return _topics_table(r).orderBy(F.col("score").desc(), "keyword", "subreddit").limit(20)


@plan("posts_with_sentiment")
def _posts_with_sentiment(r: Run) -> DataFrame:
    """J2/A21."""
    return r.sentiments


@plan("cluster_summary")
def _cluster_summary(r: Run) -> DataFrame:
    """The summaries of the stored model's clusters, over all posts."""
    return r.clusters


@plan("cluster_model")
def _cluster_model(r: Run) -> DataFrame:
    """The stored centres."""
    return r.model


@plan("cluster_totals")
def _cluster_totals(r: Run) -> DataFrame:
    """Posts, assigned posts and the sum of the clusters' sizes are one number."""
    n = r.clusters.agg(F.count(F.lit(1)).alias("clusters"), F.sum("post_count").alias("posts_in_clusters"))
    return n.select("clusters", "posts_in_clusters", r.labels.select(F.count_distinct("id")).scalar().alias("assigned_posts"),
                    r.posts.select(F.count(F.lit(1))).scalar().alias("posts"))


@plan("topics_run")
def _topics_run(r: Run) -> DataFrame:
    """The whole extraction (A21, C6, A19, K7, C7, C8, K8): what each stored table holds."""
    tables = [("topics", r.topic_stats), ("cluster_model", r.model), ("cluster_labels", r.labels), ("issue_clusters", r.clusters)]
    parts = [t.select(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for name, t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@plan("cluster_severity")
def _cluster_severity(r: Run) -> DataFrame:
    """Severity score parts per cluster."""
    score = (F.greatest(F.lit(0.0), -F.col("avg_sentiment")) * F.lit(0.7)
             + F.least(F.col("post_count") / F.lit(10.0), F.lit(1.0)) * F.lit(0.3))
    return r.clusters.select("cluster_id", tx.rnd(score, 9).alias("severity_score"), "severity")


@plan("cluster_posts_unnest")
def _cluster_posts_unnest(r: Run) -> DataFrame:
    """Cluster membership rows."""
    return r.labels.select("cluster_id", F.col("id").alias("post_id"))


@plan("array_slice")
def _array_slice(r: Run) -> DataFrame:
    """First three keywords of each cluster."""
    return r.clusters.select("cluster_id", F.slice("keywords", 1, 3).alias("top_keywords"))


@plan("clusters_by_severity")
def _clusters_by_severity(r: Run) -> DataFrame:
    """A15."""
    return r.clusters.groupBy("severity").agg(
        F.count(F.lit(1)).alias("cluster_count"), (F.sum("post_count") / F.count(F.lit(1))).alias("avg_posts"),
        tx.rnd(F.avg("avg_sentiment"), 9).alias("avg_sentiment"))


@plan("clusters_feed")
def _clusters_feed(r: Run) -> DataFrame:
    """V7."""
    return r.clusters.orderBy("cluster_id")


@plan("topic_verify")
def _topic_verify(r: Run) -> DataFrame:
    """Extraction verification in one aggregate."""
    t = _topics_table(r).select(F.count(F.lit(1))).scalar()
    c = r.clusters.agg(F.count(F.lit(1)).alias("cluster_count"), F.min("post_count").alias("min_posts"),
                       F.max("post_count").alias("max_posts"),
                       *(F.count_if(F.col("severity") == x).alias(f"{x.lower()}_clusters") for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")))
    issues = F.array_compact(F.array(
        F.when(t == 0, F.lit("No keywords extracted")), F.when(F.col("cluster_count") == 0, F.lit("No clusters created")),
        F.when(F.col("min_posts") < 1, F.format_string("Cluster with too few posts: %d", F.col("min_posts")))))
    return c.select(t.alias("keyword_count"), "cluster_count", "min_posts", "max_posts", issues.alias("issues"),
                    "critical_clusters", "high_clusters", "medium_clusters", "low_clusters")


@plan("existence_gate")
def _existence_gate(r: Run) -> DataFrame:
    """The DAGs' 'COUNT(*) = 0 → fail' gates."""
    n_posts = r.posts.select(F.count(F.lit(1))).scalar()
    n_ts = r.minutes.select(F.count(F.lit(1))).scalar()
    return r.spark.range(1).select(n_posts.alias("posts"), n_ts.alias("minute_rows"),
                                   (n_posts > 0).alias("posts_ok"), (n_ts > 0).alias("sentiment_ok"))


@plan("cluster_posts", rows_only=True)
def _cluster_posts(r: Run) -> DataFrame:
    """C7 with ``pyspark.ml``: sparse tf-idf, K-Means, the best cost of ten seeds; rows-only check."""
    return cl.kmeans_model(r.tokens)[1]


# ---------------------------------------------------------------------------------------------
# Serving
# ---------------------------------------------------------------------------------------------


@plan("stats")
def _stats(r: Run) -> DataFrame:
    return sv.stats(r.scored, r.ledger)


@plan("products")
def _products(r: Run) -> DataFrame:
    return sv.products(r.scored, r.sentiments)


@plan("products_ranked")
def _products_ranked(r: Run) -> DataFrame:
    return sv.products_ranked(sv.products(r.scored, r.sentiments))


@plan("product_categories")
def _product_categories(r: Run) -> DataFrame:
    return sv.product_categories(sv.products(r.scored, r.sentiments))


@plan("product_detail")
def _product_detail(r: Run) -> DataFrame:
    return sv.product_detail(r.scored, r.sentiments)


@plan("community_stats")
def _community_stats(r: Run) -> DataFrame:
    return sv.community_stats(r.minutes)


@plan("product_timeline")
def _product_timeline(r: Run) -> DataFrame:
    return sv.product_timeline(r.scored, r.sentiments, r.as_of)


@plan("product_top_posts")
def _product_top_posts(r: Run) -> DataFrame:
    return sv.product_top_posts(r.scored)


@plan("community_timeline")
def _community_timeline(r: Run) -> DataFrame:
    return sv.community_timeline(r.minutes, r.as_of)


@plan("community_top_posts")
def _community_top_posts(r: Run) -> DataFrame:
    return sv.community_top_posts(r.scored)


@plan("community_detail")
def _community_detail(r: Run) -> DataFrame:
    return sv.community_detail(r.minutes, r.scored, r.ledger)


@plan("communities_ranked")
def _communities_ranked(r: Run) -> DataFrame:
    return sv.communities_ranked(r.minutes)


@plan("target_communities")
def _target_communities(r: Run) -> DataFrame:
    """The target list with each community's posts; a community without posts is shown with none."""
    n = r.posts.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n"))
    targets = tables.communities_frame(r.spark, [*fx.COMMUNITIES[:2], *(f"c{k}" for k in range(7))])
    return targets.join(n, "subreddit", "left").select("subreddit", "ord", F.coalesce("n", F.lit(0)).alias("posts"))


@plan("community_entities")
def _community_entities(r: Run) -> DataFrame:
    return sv.community_entities(r.scored)


@plan("distribution")
def _distribution(r: Run) -> DataFrame:
    return sv.distribution(r.minutes)


@plan("posts_by_community")
def _posts_by_community(r: Run) -> DataFrame:
    return sv.posts_by_community(r.scored)


@plan("timeline_hourly")
def _timeline_hourly(r: Run) -> DataFrame:
    return sv.timeline(r.minutes, r.as_of)


@plan("timeline_moving_avg")
def _timeline_moving_avg(r: Run) -> DataFrame:
    """24-row trailing mean per community over hourly points."""
    t = r.minutes.groupBy("subreddit", tx.hour_bucket("minute").alias("time")).agg(
        F.sum(F.round(F.col("avg_sentiment") * F.col("posts_count") * F.lit(1e4)).cast("bigint")).alias("_u"),
        F.sum("posts_count").alias("posts"))
    t = t.select("subreddit", "time", (F.col("_u") / F.lit(1e4) / F.col("posts")).alias("sentiment"), "posts")
    return ru.moving_average(t, 24, part=["subreddit"])


@plan("volume_timeline")
def _volume_timeline(r: Run) -> DataFrame:
    return sv.volume_timeline(r.minutes)


@plan("realtime_24h")
def _realtime_24h(r: Run) -> DataFrame:
    return sv.realtime_24h(r.minutes, r.as_of).orderBy(F.col("timestamp").desc(), "subreddit")


@plan("top_posts_weekly")
def _top_posts_weekly(r: Run) -> DataFrame:
    return sv.top_posts_weekly(r.scored, r.as_of)


@plan("top_engagement")
def _top_engagement(r: Run) -> DataFrame:
    return sv.top_engagement(r.scored)


@plan("sentiment_labels")
def _sentiment_labels(r: Run) -> DataFrame:
    return sv.sentiment_labels(r.minutes)


# ---------------------------------------------------------------------------------------------
# Streaming: four arrival-time slices, each a micro-batch of every query
# ---------------------------------------------------------------------------------------------


def _stream(r: Run, table: str) -> DataFrame:
    """A table of the one streamed run of this input, stored like any derived table."""
    from ..streaming import ingest as st

    def build() -> DataFrame:
        made = st.run_pipeline(r.spark, r.landing, r.scratch("streams"))
        for name, path in made.items():
            if name not in ("in", table):
                r.stored(f"stream-{name}", lambda p=path: r.spark.read.parquet(p))
        return r.spark.read.parquet(made[table])

    return r.stored(f"stream-{table}", build)


@plan("stream_ingest")
def _stream_ingest(r: Run) -> DataFrame:
    """Messages → parse → watermark/dedupe → foreachBatch enrichment."""
    batch = F.dense_rank().over(Window.orderBy("batch_id"))
    order = _stream(r, "scored").select("batch_id").distinct().select("batch_id", batch.alias("slice"))
    return _stream(r, "scored").join(order, "batch_id").select("id", "subreddit", "minute", "compound", "category", "slice")


@plan("stream_dedupe")
def _stream_dedupe(r: Run) -> DataFrame:
    """Ids kept by the stream (each exactly once)."""
    return _stream(r, "scored").groupBy("id").agg(F.count(F.lit(1)).alias("copies"))


@plan("stream_quarantine")
def _stream_quarantine(r: Run) -> DataFrame:
    """Rejected messages by reason."""
    return _stream(r, "quarantine").groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


@plan("stream_minute_rollup")
def _stream_minute_rollup(r: Run) -> DataFrame:
    """Settled 1-minute windows per community."""
    return _stream(r, "minutes").drop("batch_id")


@plan("stream_anomaly")
def _stream_anomaly(r: Run) -> DataFrame:
    """Alerts raised in the batch that settled their window."""
    return _stream(r, "alerts").drop("batch_id")


@plan("expanding_anomaly")
def _expanding_anomaly(r: Run) -> DataFrame:
    """X6's detector in one pass over the rollup."""
    return an.expanding_anomalies(r.minutes)

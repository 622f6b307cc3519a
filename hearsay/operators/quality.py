"""Data-quality checks Q1-Q5, the metric log K12/K14, and the views A5, A6, A18, V14.

All four checks read the raw landing log (where replays and invalid rows still exist) as it
stood at a check time ``at``; each is one aggregation pass (``count_if`` per field instead of
five scans). Check rows share the log shape ``LOG_COLUMNS``; ``details`` is JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..sources import fixtures as fx
from .store import RunLog

LOG_COLUMNS = ["check_timestamp", "check_name", "status", "metric_value", "threshold_value", "details", "error_message"]
# FIXED VALUES: the required fields; names of the checks and of the fields of their details stand in each check.
REQUIRED = ["id", "title", "author", "subreddit", "created_utc"]
JSON_OPTS = {"ignoreNullFields": "false"}


def _log_row(df: DataFrame, at: Column, name: str, status: Column, metric: Column, threshold: float,
             details: Column) -> DataFrame:
    return df.select(
        at.cast("timestamp_ntz").alias("check_timestamp"), F.lit(name).alias("check_name"), status.alias("status"),
        metric.cast("double").alias("metric_value"), F.lit(float(threshold)).alias("threshold_value"),
        F.to_json(details, JSON_OPTS).alias("details"), F.lit(None).cast("string").alias("error_message"))


def freshness(posts: DataFrame, at: Column, threshold_minutes: int = 10) -> DataFrame:
    """Per community newest post, minutes since ``at``, stale flag; most stale first."""
    g = posts.groupBy("subreddit").agg(F.max("created_utc").alias("last_post_time"))
    mins = tx.minutes_between(at, F.col("last_post_time"))
    return g.select("subreddit", "last_post_time", mins.alias("minutes_ago"),
                    (mins > threshold_minutes).alias("is_stale"))


def check_freshness(posts: DataFrame, at: Column, threshold_minutes: int = 10) -> DataFrame:
    """Q1: FAILED when any community is stale; metric = number of stale communities."""
    f = freshness(posts, at, threshold_minutes)
    g = f.agg(
        F.sort_array(F.collect_list(F.when(F.col("is_stale"), F.struct(
            F.col("subreddit"), tx.rnd(F.col("minutes_ago"), 2).alias("minutes_ago"))))).alias("stale"),
        F.count(F.lit(1)).alias("checked"))
    n_stale = F.size("stale")
    details = F.struct(F.col("stale").alias("stale_subreddits"), F.lit(threshold_minutes).alias("threshold_minutes"),
                       F.col("checked").alias("total_subreddits_checked"))
    return _log_row(g, at, "data_freshness", F.when(n_stale == 0, "PASSED").otherwise("FAILED"), n_stale,
                    threshold_minutes, details)


def check_duplicates(rows: DataFrame, at: Column, sample: int = 10) -> DataFrame:
    """Q2: ids seen more than once; WARNING when any; first ``sample`` ids (smallest) listed."""
    d = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    first = d.select("id").orderBy("id").limit(sample).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    cnt = d.agg(F.count(F.lit(1)).alias("dups"))
    g = cnt.select("dups", first.select("ids").scalar().alias("ids"))
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    details = F.struct(F.col("dups").alias("duplicate_count"), ids.alias("duplicate_ids"))
    return _log_row(g, at, "duplicate_detection", F.when(F.col("dups") == 0, "PASSED").otherwise("WARNING"),
                    F.col("dups"), 0, details)


def null_counts(rows: DataFrame) -> DataFrame:
    """One pass: NULL-or-empty count per required field (created_utc: NULL only)."""
    aggs = []
    for f in REQUIRED:
        bad = F.col(f).isNull() if f == "created_utc" else (F.col(f).isNull() | (F.col(f) == ""))
        aggs.append(F.count_if(bad).alias(f))
    return rows.agg(*aggs)


def check_schema(rows: DataFrame, at: Column) -> DataFrame:
    """Q3: FAILED when any required field is NULL/empty; metric = total violations."""
    n = null_counts(rows)
    total = sum((F.col(f) for f in REQUIRED[1:]), F.col(REQUIRED[0]))
    details = F.struct(F.struct(*[F.col(f) for f in REQUIRED]).alias("null_counts"), total.alias("total_null_violations"))
    return _log_row(n, at, "schema_validation", F.when(total == 0, "PASSED").otherwise("FAILED"), total, 0, details)


def check_completeness(rows: DataFrame, at: Column, hours: int = 24, expected: int = fx.EXPECTED_COMMUNITIES) -> DataFrame:
    """Q4: posts and distinct communities in the last ``hours``; ratio to ``expected`` >= 0.8."""
    recent = rows.where(F.col("created_utc") >= at - F.expr(f"INTERVAL {hours} HOURS"))
    g = recent.agg(F.count(F.lit(1)).alias("total_posts"), F.count_distinct("subreddit").alias("unique_subreddits"))
    ratio = F.col("unique_subreddits") / F.lit(float(expected))
    details = F.struct("total_posts", "unique_subreddits", F.lit(expected).alias("expected_subreddits"),
                       tx.rnd(ratio, 2).alias("completeness_ratio"), F.lit(hours).alias("time_window_hours"))
    return _log_row(g, at, "completeness", F.when(ratio >= 0.8, "PASSED").otherwise("WARNING"), ratio, 0.8, details)


def run_checks(landing: DataFrame, at: Column) -> DataFrame:
    """The four checks on the landing log as of ``at``, in a fixed order."""
    rows = landing.where(F.col("ingested_at") <= at)
    return (check_freshness(rows, at).unionByName(check_duplicates(rows, at))
            .unionByName(check_schema(rows, at)).unionByName(check_completeness(rows, at)))


def overall(checks: DataFrame) -> DataFrame:
    """Q5: overall pass = every check PASSED (``bool_and`` over the union)."""
    return checks.groupBy("check_timestamp").agg(
        F.bool_and(F.col("status") == "PASSED").alias("overall_passed"),
        F.count_if(F.col("status") != "PASSED").alias("not_passed"))


def init_row(df: DataFrame, at: Column) -> DataFrame:
    """The schema-initialisation row."""
    return df.limit(1).select(
        at.cast("timestamp_ntz").alias("check_timestamp"), F.lit("schema_initialization").alias("check_name"),
        F.lit("PASSED").alias("status"), F.lit(None).cast("double").alias("metric_value"),
        F.lit(None).cast("double").alias("threshold_value"),
        F.to_json(F.struct(F.lit("Database schema created successfully").alias("message"))).alias("details"),
        F.lit(None).cast("string").alias("error_message"))


class QualityLog(RunLog):
    """The stored log of check runs; each run is appended once, and only its own checks are computed."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        kinds = [T.TimestampNTZType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.StringType(), T.StringType()]
        super().__init__(spark, root, T.StructType([T.StructField(c, k) for c, k in zip(LOG_COLUMNS, kinds)]))

    def check(self, run_id: str, landing: DataFrame, at: Column) -> bool:
        return self.append(run_id, lambda: run_checks(landing, at))

    def log(self) -> DataFrame:
        return self.rows().drop("run_id")


def metric_log(spark: SparkSession, root: str, landing: DataFrame, as_of: Column, hours_back: tuple[int, ...] = (48, 24, 0)) -> DataFrame:
    """The log with its initial row and the check runs at ``as_of - h`` for each h."""
    log = QualityLog(spark, root)
    log.append("0-init", lambda: init_row(landing, as_of - F.expr(f"INTERVAL {max(hours_back) + 24} HOURS")))
    for h in hours_back:
        log.check(f"{h:03d}h-before", landing, as_of - F.expr(f"INTERVAL {h} HOURS"))
    return log.log()


def weekly_summary(log: DataFrame, at: Column) -> DataFrame:
    """Per (check, status) over the last 7 days: count, mean metric, last check."""
    return log.where(F.col("check_timestamp") >= at - F.expr("INTERVAL 7 DAYS")).groupBy("check_name", "status").agg(
        F.count(F.lit(1)).alias("check_count"), tx.rnd(F.avg("metric_value"), 6).alias("avg_metric"),
        F.max("check_timestamp").alias("last_check"))


def latest(log: DataFrame) -> DataFrame:
    """The newest row per check."""
    g = log.groupBy("check_name").agg(F.max_by(F.struct(*[c for c in LOG_COLUMNS if c != "check_name"]),
                                               F.col("check_timestamp")).alias("_l"))
    return g.select("check_name", *[F.col(f"_l.{c}").alias(c) for c in LOG_COLUMNS if c != "check_name"])


def distribution(minutes: DataFrame, start: Column, end: Column, community: str | None = None) -> DataFrame:
    """A5/F1: minute buckets labelled ±0.1 (strict), counts and share of total (BETWEEN inclusive)."""
    m = minutes.where(F.col("minute").between(start, end))
    if community is not None:
        m = m.where(F.col("subreddit") == community)
    g = m.groupBy(tx.sentiment_label("avg_sentiment", 0.1, -0.1).alias("sentiment_category")).agg(
        F.count(F.lit(1)).alias("count"))
    return g.withColumn("percentage", tx.rnd(F.col("count") * F.lit(100.0) / F.sum("count").over(Window.partitionBy()), 2))

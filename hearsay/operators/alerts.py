"""Alert ledger: K9 suppression, K10 auto-resolve, K11 resolve-by-id, summaries A10-A13,
feeds V2-V3, links P31-P32 and notification rows P35.

The ledger is append-only rows in ``LEDGER_COLUMNS``. Suppression is a ``row_number`` over the
(bounded) candidate set plus a null-safe left-anti join on (alert_type, subreddit) against open
alerts of the last 24 h; candidates are at most the detectors' limits, so the anti-join builds
on the candidate side and the ledger is streamed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import anomaly as an

LEDGER_COLUMNS = an.ALERT_COLUMNS + ["resolved", "resolved_at"]


def within_batch_first(candidates: DataFrame) -> DataFrame:
    """Earlier inserts are visible to later checks: first per (type, community) in detector order."""
    w = Window.partitionBy("alert_type", "subreddit").orderBy("detector", "rank")
    return candidates.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k")


def suppress(candidates: DataFrame, ledger: DataFrame | None, at: Column, hours: int = 24) -> DataFrame:
    """K9: drop candidates with an open same-key alert newer than ``hours`` (NULL-safe key)."""
    first = within_batch_first(candidates)
    if ledger is None:
        return first
    open_recent = ledger.where(
        (~F.col("resolved")) & (F.col("detected_at") > at - F.expr(f"INTERVAL {hours} HOURS"))
    ).select(F.col("alert_type").alias("_t"), F.col("subreddit").alias("_s"))
    cond = (first["alert_type"] == open_recent["_t"]) & first["subreddit"].eqNullSafe(open_recent["_s"])
    return first.join(open_recent, cond, "left_anti")


def as_ledger_rows(accepted: DataFrame) -> DataFrame:
    return accepted.select(*an.ALERT_COLUMNS, F.lit(False).alias("resolved"),
                           F.lit(None).cast("timestamp_ntz").alias("resolved_at"))


def autoresolve(ledger: DataFrame, at: Column, hours: int = 24) -> DataFrame:
    """Open alerts older than ``hours`` become resolved at ``at``."""
    old = (~F.col("resolved")) & (F.col("detected_at") < at - F.expr(f"INTERVAL {hours} HOURS"))
    return ledger.withColumn("resolved_at", F.when(old, at.cast("timestamp_ntz")).otherwise(F.col("resolved_at"))).withColumn(
        "resolved", F.when(old, F.lit(True)).otherwise(F.col("resolved")))


def resolve_by_id(ledger: DataFrame, alert_id: Column, at: Column) -> DataFrame:
    """Resolve one alert; ``matched`` tells whether the id was found (not-found → 0 rows marked)."""
    hit = (F.col("alert_id") == alert_id) & (~F.col("resolved"))
    return ledger.withColumn("matched", F.coalesce(F.col("alert_id") == alert_id, F.lit(False))).withColumn(
        "resolved_at", F.when(hit, at.cast("timestamp_ntz")).otherwise(F.col("resolved_at"))).withColumn(
        "resolved", F.when(hit, F.lit(True)).otherwise(F.col("resolved")))


def recent(ledger: DataFrame, at: Column, hours: int = 24) -> DataFrame:
    return ledger.where(F.col("detected_at") > at - F.expr(f"INTERVAL {hours} HOURS"))


def by_severity(ledger: DataFrame, at: Column) -> DataFrame:
    """A10: per severity, total and open alerts of the last 24 h, with the grand total."""
    g = recent(ledger, at).groupBy("severity").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(~F.col("resolved")).alias("active"))
    return g.withColumn("severity_rank", tx.severity_rank("severity")).withColumn(
        "grand_total", F.sum("count").over(Window.partitionBy()))


def by_type(ledger: DataFrame, at: Column) -> DataFrame:
    """A11."""
    return recent(ledger, at).groupBy("alert_type").agg(F.count(F.lit(1)).alias("count"))


def critical_gate(ledger: DataFrame, at: Column) -> DataFrame:
    """Open CRITICAL alerts of the last 24 h and the branch it selects."""
    n = recent(ledger, at).agg(F.count_if((F.col("severity") == "CRITICAL") & ~F.col("resolved")).alias("critical_count"))
    return n.withColumn("branch", F.when(F.col("critical_count") > 0, "has_critical_alerts").otherwise("no_critical_alerts"))


def recent_critical(ledger: DataFrame, k: int = 5) -> DataFrame:
    """Newest open CRITICAL/HIGH alerts (message cut to 80 characters)."""
    return (ledger.where(F.col("severity").isin("CRITICAL", "HIGH") & ~F.col("resolved"))
            .orderBy(F.col("detected_at").desc(), "alert_id").limit(k)
            .select("alert_id", "alert_type", "severity", "subreddit", F.substring("message", 1, 80).alias("message"),
                    "detected_at"))


def feed(ledger: DataFrame, severity: str | None = None, resolved: bool = False, limit: int = 50) -> DataFrame:
    """V2 (P33/P36): optional severity filter, resolved flag, newest first."""
    f = ledger.where(F.col("resolved") == F.lit(resolved))
    if severity is not None:
        f = f.where(F.col("severity") == severity)
    return f.orderBy(F.col("detected_at").desc(), "alert_id").limit(limit)


def open_counts(ledger: DataFrame) -> DataFrame:
    """V3: open alerts per severity and their total."""
    g = ledger.where(~F.col("resolved")).groupBy("severity").agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("total", F.sum("count").over(Window.partitionBy()))


def run_summary(candidates: DataFrame) -> DataFrame:
    """Candidate counts by type and by severity (before suppression) and the total."""
    g = candidates.groupBy("alert_type", "severity").agg(F.count(F.lit(1)).alias("n"))
    by_t = g.groupBy(F.lit("type").alias("dimension"), F.col("alert_type").alias("value")).agg(F.sum("n").alias("count"))
    by_s = g.groupBy(F.lit("severity").alias("dimension"), F.col("severity").alias("value")).agg(F.sum("n").alias("count"))
    tot = g.groupBy(F.lit("total").alias("dimension"), F.lit("all").alias("value")).agg(F.sum("n").alias("count"))
    return by_t.unionByName(by_s).unionByName(tot)


# FIXED VALUE: what display links leave out.
HOST_PREFIX = r"^https?://(www\.)?reddit\.com"


def links(ledger: DataFrame) -> DataFrame:
    """Display links with 4-way precedence and the spaced type label."""
    m = F.col("metadata")
    post_links = F.from_json(F.get_json_object(m, "$.post_links"), "array<string>")
    permalinks = F.from_json(F.get_json_object(m, "$.permalinks"), "array<string>")
    post_id = F.get_json_object(m, "$.post_id")
    post_ids = F.from_json(F.get_json_object(m, "$.post_ids"), "array<string>")
    sub = F.coalesce(F.col("subreddit"), F.lit("null"))
    by_id = lambda i: F.concat(F.lit("/r/"), sub, F.lit("/comments/"), i, F.lit("/"))
    out = (F.when(post_links.isNotNull(),
                  F.transform(post_links, lambda l: F.when(l.startswith("http"), F.regexp_replace(l, HOST_PREFIX, "")).otherwise(l)))
           .when(permalinks.isNotNull(), permalinks)
           .when(post_id.isNotNull(), F.array(by_id(post_id)))
           .when(post_ids.isNotNull(), F.transform(post_ids, by_id))
           .otherwise(F.array().cast("array<string>")))
    return ledger.select("alert_id", F.translate("alert_type", "_", " ").alias("type_label"), out.alias("links"))


def notify_candidates(ledger: DataFrame, at: Column) -> DataFrame:
    """Open CRITICAL/HIGH alerts of the last hour, CRITICAL first, newest first; subject line."""
    rows = ledger.where((F.col("detected_at") > at - F.expr("INTERVAL 1 HOURS")) & F.col("severity").isin("CRITICAL", "HIGH")
                        & ~F.col("resolved"))
    w = Window.partitionBy().orderBy(tx.severity_rank("severity"), F.col("detected_at").desc(), "alert_id")
    ranked = rows.withColumn("position", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    first_sev = F.first(F.col("severity")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # FIXED VALUE: the subject line.
    return ranked.withColumn("subject", F.format_string("[%s] Tesla Energy Alert - %d Issue(s) Detected", first_sev, F.col("n"))).select(
        "position", "alert_id", "alert_type", "severity", "subreddit", "message", "detected_at", "subject")

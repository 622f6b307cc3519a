"""DuckDB SQL for topics, clusters, serving, sources, validation and sinks keys."""

from __future__ import annotations

from ..functions import validate as va
from ..sources import fixtures as fx
from .oracle import AS_OF, COMBINED, CTES, PERMALINK, D, cte, in_list, q, register, rnd, sql
from .oracle_more import SEVERITY_SCORE, UNITS6, mins_between

# ---------------------------------------------------------------------------------------------
# Topics and clusters
# ---------------------------------------------------------------------------------------------
register("tfidf_keywords", sql("SELECT * FROM topics_kw", "topics_kw"))
register("keyword_stats", sql("SELECT * FROM topics_tbl", "topics_tbl"))
register("topic_report", sql("""
SELECT subreddit, count(*) AS keyword_count, count(*) OVER () AS communities, (SELECT count(*) FROM clusters) AS clusters
FROM topics_tbl GROUP BY subreddit""", "topics_tbl", "clusters"))
register("topic_counts", sql("SELECT subreddit, count(*) AS keyword_count FROM topics_tbl GROUP BY subreddit", "topics_tbl"))
register("top_keywords", sql("SELECT keyword, subreddit, score FROM topics_tbl ORDER BY score DESC, keyword, subreddit LIMIT 5",
                             "topics_tbl"))
register("topics_feed", sql("SELECT * FROM topics_tbl ORDER BY score DESC, keyword, subreddit LIMIT 20", "topics_tbl"))
register("posts_with_sentiment", sql("SELECT * FROM sentiments", "sentiments"))
register("cluster_summary", sql("SELECT * FROM clusters", "clusters"))
register("cluster_model", sql("SELECT * FROM model", "model"))
register("cluster_totals", sql("""
SELECT count(*) AS clusters, CAST(sum(post_count) AS BIGINT) AS posts_in_clusters, (SELECT count(DISTINCT id) FROM labels) AS assigned_posts,
       (SELECT count(*) FROM posts) AS posts FROM clusters""", "clusters", "labels", "posts"))
register("topics_run", sql("""
SELECT 'topics' AS table_name, count(*) AS row_count FROM topics_tbl UNION ALL SELECT 'cluster_model', count(*) FROM model
UNION ALL SELECT 'cluster_labels', count(*) FROM labels UNION ALL SELECT 'issue_clusters', count(*) FROM clusters""",
                          "topics_tbl", "model", "labels", "clusters"))
register("cluster_severity", sql(
    f"SELECT cluster_id, {rnd(SEVERITY_SCORE.format(a='avg_sentiment', n='post_count'), 9)} AS severity_score, severity FROM clusters",
    "clusters"))
register("cluster_posts_unnest", sql("SELECT cluster_id, id AS post_id FROM labels", "labels"))
register("array_slice", sql("SELECT cluster_id, keywords[1:3] AS top_keywords FROM clusters", "clusters"))
register("clusters_by_severity", sql(f"""
SELECT severity, count(*) AS cluster_count, sum(post_count) / count(*) AS avg_posts, {rnd('avg(avg_sentiment)', 9)} AS avg_sentiment
FROM clusters GROUP BY severity""", "clusters"))
register("clusters_feed", sql("SELECT * FROM clusters", "clusters"))
register("topic_verify", sql("""
SELECT keyword_count, cluster_count, min_posts, max_posts,
       list_filter([CASE WHEN keyword_count = 0 THEN 'No keywords extracted' END,
                    CASE WHEN cluster_count = 0 THEN 'No clusters created' END,
                    CASE WHEN min_posts < 1 THEN printf('Cluster with too few posts: %d', min_posts) END],
                   lambda x: x IS NOT NULL) AS issues, critical_clusters, high_clusters, medium_clusters, low_clusters
FROM (SELECT CAST(count_if(severity = 'CRITICAL') AS BIGINT) AS critical_clusters, CAST(count_if(severity = 'HIGH') AS BIGINT) AS high_clusters,
             CAST(count_if(severity = 'MEDIUM') AS BIGINT) AS medium_clusters, CAST(count_if(severity = 'LOW') AS BIGINT) AS low_clusters, (SELECT count(*) FROM topics_tbl) AS keyword_count, count(*) AS cluster_count, min(post_count) AS min_posts,
             max(post_count) AS max_posts FROM clusters)""", "topics_tbl", "clusters"))
register("existence_gate", sql("""
SELECT p AS posts, m AS minute_rows, p > 0 AS posts_ok, m > 0 AS sentiment_ok
FROM (SELECT (SELECT count(*) FROM posts) AS p, (SELECT count(*) FROM minutes) AS m)""", "posts", "minutes"))

# ---------------------------------------------------------------------------------------------
# Serving
# ---------------------------------------------------------------------------------------------
cte("products", ["scored_c", "sentiments"], f"""
SELECT c.primary_product, count(*) AS post_count,
       CAST(sum(CAST(round(s.sentiment * {D(1e6)}) AS BIGINT)) AS DOUBLE) / {D(1e6)} / count(*) AS avg_sentiment
FROM scored_c c JOIN sentiments s ON c.id = s.id WHERE c.primary_product IS NOT NULL GROUP BY c.primary_product""")
register("stats", sql(f"""
SELECT count(*) AS total_posts,
       CAST(sum(CAST(round(compound * {D(1e4)}) AS BIGINT)) AS DOUBLE) / {D(1e4)} / count(compound) AS avg_sentiment,
       (SELECT count(*) FROM ledger WHERE severity = 'CRITICAL' AND NOT resolved) AS critical_alerts,
       {rnd('count_if(primary_product IS NOT NULL) * ' + D(100.0) + ' / count(*)', 1)} AS extraction_rate
FROM scored_c""", "scored_c", "ledger"))
register("products", sql("SELECT * FROM products", "products"))
register("products_ranked", sql("""
SELECT primary_product, post_count, avg_sentiment,
       row_number() OVER (ORDER BY post_count DESC, primary_product) AS rank_by_posts,
       row_number() OVER (ORDER BY coalesce(avg_sentiment, 0.0) DESC, primary_product) AS rank_by_sentiment,
       row_number() OVER (ORDER BY coalesce(avg_sentiment, 0.0) DESC, primary_product) = 1 AS is_best
FROM products""", "products"))


def _cat(e: str) -> str:
    return (f"CASE WHEN {e} IN {in_list(fx.VEHICLE_DISPLAY)} THEN 'vehicle' WHEN {e} IN {in_list(fx.ENERGY_DISPLAY)} "
            "THEN 'energy' ELSE 'other' END")


_DISP = ("array_to_string(list_transform(string_split(replace(primary_product, '_', ' '), ' '), "
         "lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ')")
register("product_categories", sql(f"""
SELECT primary_product, {_DISP} AS display_name, {_cat('primary_product')} AS category_as_stored, {_cat(_DISP)} AS category
FROM products""", "products"))
register("product_detail", sql("""
SELECT p.primary_product, p.post_count, p.avg_sentiment, coalesce(i.common_issues, []::VARCHAR[]) AS common_issues,
       c.related_subreddits
FROM products p
LEFT JOIN (SELECT primary_product, list(issue ORDER BY r) AS common_issues FROM (
             SELECT primary_product, issue, row_number() OVER (PARTITION BY primary_product ORDER BY n DESC, issue) AS r FROM (
               SELECT primary_product, issue, count(*) AS n FROM (
                 SELECT primary_product, unnest(issues) AS issue FROM scored_c WHERE primary_product IS NOT NULL)
               GROUP BY primary_product, issue))
           GROUP BY primary_product) i ON p.primary_product = i.primary_product
LEFT JOIN (SELECT primary_product, list(DISTINCT subreddit ORDER BY subreddit) AS related_subreddits FROM scored_c
           WHERE primary_product IS NOT NULL GROUP BY primary_product) c ON p.primary_product = c.primary_product""",
                               "products", "scored_c"))
_PCT = "{c} * " + D(100.0) + " / post_count"
register("community_stats", sql(f"""
SELECT subreddit, post_count, CAST(u AS DOUBLE) / {D(1e4)} / post_count AS avg_sentiment,
       {rnd(_PCT.format(c='pp'), 1)} AS positive_percent, {rnd(_PCT.format(c='nn'), 1)} AS negative_percent,
       {rnd(_PCT.format(c='zz'), 1)} AS neutral_percent, sum(post_count) OVER () AS all_posts
FROM (SELECT subreddit, sum(posts_count) AS post_count,
             sum(CAST(round(avg_sentiment * posts_count * {D(1e4)}) AS BIGINT)) AS u,
             sum(positive_count) AS pp, sum(negative_count) AS nn, sum(neutral_count) AS zz FROM minutes GROUP BY subreddit)""",
                                "minutes"))
register("community_entities", sql("""
SELECT subreddit, sum(len(vehicles)) AS vehicles, sum(len(energy_products)) AS energy_products, sum(len(issues)) AS issues
FROM scored_c GROUP BY subreddit""", "scored_c"))
register("distribution", sql("""
SELECT sum(positive_count) AS positive_count, sum(negative_count) AS negative_count, sum(neutral_count) AS neutral_count,
       sum(posts_count) AS total FROM minutes""", "minutes"))
register("posts_by_community", sql(
    "SELECT subreddit, count(*) AS post_count FROM scored_c GROUP BY subreddit ORDER BY post_count DESC, subreddit LIMIT 10",
    "scored_c"))
_HOURLY = (f"CAST(sum(CAST(round(avg_sentiment * posts_count * {D(1e4)}) AS BIGINT)) AS DOUBLE) / {D(1e4)} / sum(posts_count)")
register("timeline_hourly", sql(f"""
SELECT date_trunc('hour', minute) AS time, {_HOURLY} AS sentiment, sum(posts_count) AS posts
FROM minutes WHERE minute >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1""", "minutes", "as_of"))
_MA = (f"CAST(sum(CAST(round(coalesce(sentiment, {D(0.0)}) * {D(1e6)}) AS BIGINT)) OVER w AS DOUBLE) / {D(1e6)} "
       "/ count(*) OVER w")
register("timeline_moving_avg", sql(f"""
SELECT subreddit, time, sentiment, posts, {rnd(_MA, 3)} AS moving_avg
FROM (SELECT subreddit, date_trunc('hour', minute) AS time, {_HOURLY} AS sentiment, sum(posts_count) AS posts
      FROM minutes GROUP BY 1, 2)
WINDOW w AS (PARTITION BY subreddit ORDER BY time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""", "minutes"))
register("volume_timeline", sql(
    "SELECT date_trunc('hour', minute) AS hour, subreddit, sum(posts_count) AS posts FROM minutes GROUP BY 1, 2", "minutes"))
register("realtime_24h", sql(f"""
SELECT minute AS timestamp, subreddit, posts_count, avg_sentiment, positive_count, negative_count, neutral_count,
       false AS anomaly_detected FROM minutes WHERE minute >= {AS_OF} - INTERVAL 24 HOUR""", "minutes", "as_of"))
register("top_posts_weekly", sql(f"""
SELECT id, subreddit, title, author, score, num_comments, created_utc, url FROM scored_c
WHERE created_utc >= {AS_OF} - INTERVAL 7 DAY ORDER BY score DESC, id LIMIT 100""", "scored_c", "as_of"))
register("top_engagement", sql("""
SELECT id, subreddit, title, score, num_comments, score + num_comments AS engagement FROM scored_c
ORDER BY engagement DESC, id LIMIT 10""", "scored_c"))
register("sentiment_labels", sql("""
SELECT minute, subreddit, avg_sentiment,
       CASE WHEN avg_sentiment >= 0.05 THEN 'positive' WHEN avg_sentiment <= -0.05 THEN 'negative' ELSE 'neutral' END AS category,
       CASE WHEN avg_sentiment > 0.1 THEN 'positive' WHEN avg_sentiment < -0.1 THEN 'negative' ELSE 'neutral' END
         AS distribution_bucket,
       CASE WHEN avg_sentiment > 0.2 THEN 'positive' WHEN avg_sentiment < 0.0 THEN 'negative' ELSE 'neutral' END AS badge,
       CASE WHEN avg_sentiment > 0.2 THEN 'Positive' WHEN avg_sentiment < -0.2 THEN 'Negative' ELSE 'Neutral' END AS chart_label
FROM minutes""", "minutes"))

# ---------------------------------------------------------------------------------------------
# Sources, validation, scalar projections
# ---------------------------------------------------------------------------------------------
register("posts_scan", sql("SELECT * EXCLUDE (msg_offset) FROM posts", "posts"))
register("minute_rollup", sql("SELECT * FROM minutes", "minutes"))
register("sentiment_score", sql("SELECT id, subreddit, minute, compound, category FROM scored_c", "scored_c"))
register("entity_tags", sql("SELECT id, vehicles, energy_products, issues, primary_product FROM scored_c", "scored_c"))
register("primary_product", sql("SELECT primary_product, count(*) AS posts FROM scored_c GROUP BY primary_product", "scored_c"))
register("sentiment_category", sql("SELECT category, count(*) AS posts FROM scored_c GROUP BY category", "scored_c"))
register("minute_bucket", sql("SELECT id, created_utc, date_trunc('minute', created_utc) AS minute FROM posts", "posts"))
register("date_parts", sql(f"""
SELECT id, CAST(ingested_at AS DATE) AS ingest_date, hour(created_utc) AS hour,
       {mins_between('ingested_at', 'created_utc')} AS ingest_lag_minutes FROM posts""", "posts"))
register("combine_text", sql(f"""
SELECT id, length({COMBINED}) AS scoring_len, length(t) AS topics_len, sha256({COMBINED}) AS scoring_sha256,
       sha256(t) AS topics_sha256
FROM (SELECT *, CASE WHEN selftext IS NOT NULL AND length(selftext) > 0 THEN concat(title, ' ', selftext) ELSE title END AS t
      FROM posts)""", "posts"))
register("epoch_to_ts", sql("""
SELECT id, CAST(epoch(created_utc) AS BIGINT) AS epoch, make_timestamp(CAST(epoch(created_utc) AS BIGINT) * 1000000) AS from_epoch,
       created_utc AS from_iso FROM posts""", "posts"))
register("permalink_build", sql(f"SELECT msg_offset, permalink AS raw, {PERMALINK.format(p='permalink')} AS permalink FROM landing",
                                "landing"))
_VALID = "id IS NOT NULL AND title IS NOT NULL AND author IS NOT NULL AND created_utc IS NOT NULL AND subreddit IS NOT NULL"
register("required_fields_filter", sql(f"SELECT msg_offset, id, title, author FROM landing WHERE {_VALID}", "landing"))

ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S')"
MSG_FIELDS = [("id", "id"), ("title", "title"), ("selftext", "selftext"), ("author", "author"), ("subreddit", "subreddit"),
              ("created_utc", ISO.format(c="created_utc")), ("score", "score"), ("num_comments", "num_comments"),
              ("url", "url"), ("permalink", "permalink"), ("upvote_ratio", "upvote_ratio"), ("is_self", "is_self"),
              ("link_flair_text", "link_flair_text"), ("ingested_at", ISO.format(c="ingested_at"))]


def msg_json(keep_nulls: bool, overrides: dict | None = None) -> str:
    fields = [(k, (overrides or {}).get(k, v)) for k, v in MSG_FIELDS]
    if keep_nulls:
        return "to_json({" + ", ".join(f"'{k}': {v}" for k, v in fields) + "})"
    members = ", ".join(f"CASE WHEN {v} IS NOT NULL THEN '\"{k}\":' || to_json({v}) END" for k, v in fields)
    return "'{' || array_to_string(list_filter([" + members + "], lambda x: x IS NOT NULL), ',') || '}'"


register("kafka_payload", sql(f"SELECT id AS key, {msg_json(True)} AS value FROM posts", "posts"))
_TEXT_COMMENTS = {"num_comments": "CAST(num_comments AS VARCHAR)"}
cte("payloads", ["landing"], f"""
SELECT id AS key, CASE WHEN CAST(substring(id, 2, 20) AS BIGINT) % 43 = 0 THEN {msg_json(False, _TEXT_COMMENTS)}
                       ELSE {msg_json(False)} END AS value
FROM landing""")


def _kind(path: str) -> str:
    t = f"json_type(value, '{path}')"
    return (f"(CASE {t} WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' "
            f"WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' "
            f"WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'other' END)")


_checks = [f"CASE WHEN json_type(value, '$.{f}') IS NULL THEN {q(repr(f) + ' is a required property')} END"
           for f in va.SCHEMA_REQUIRED]
for _f, _allowed in va.POST_SCHEMA:
    _k = _kind("$." + _f)
    _ok = f"({_k} IN {in_list(_allowed)}" + (f" OR {_k} = 'integer'" if "number" in _allowed else "") + ")"
    _msg = f"{_f} is not of type '{'|'.join(a for a in _allowed if a != 'null')}'"
    _checks.append(f"CASE WHEN json_type(value, '$.{_f}') IS NOT NULL AND NOT {_ok} THEN {q(_msg)} END")
_NOT_OBJECT = q("instance is not of type 'object'")
register("schema_validate", sql(f"""
SELECT key AS id, e IS NULL AS is_valid, CASE WHEN e IS NULL THEN []::VARCHAR[] ELSE [e] END AS errors
FROM (SELECT key, coalesce(CASE WHEN json_type(value) IS DISTINCT FROM 'OBJECT' THEN {_NOT_OBJECT} END,
                           {', '.join(_checks)}) AS e FROM payloads)""", "payloads"))
_miss = ", ".join(
    f"CASE WHEN json_extract_string(value, '$.{f}') IS NULL OR json_extract_string(value, '$.{f}') = '' THEN '{f}' END"
    for f in va.COMPLETENESS_FIELDS)
register("missing_fields", sql(f"""
SELECT key AS id, len(m) = 0 AS is_complete, m AS missing
FROM (SELECT key, list_filter([{_miss}], lambda x: x IS NOT NULL) AS m FROM payloads)""", "payloads"))

register("listing_normalize", sql(f"""
SELECT id, coalesce(title, '') AS title, coalesce(selftext, '') AS selftext, coalesce(author, '[deleted]') AS author, subreddit,
       created_utc, coalesce(score, 0) AS score, coalesce(num_comments, 0) AS num_comments, coalesce(url, '') AS url,
       {PERMALINK.format(p="coalesce(permalink, '')")} AS permalink, coalesce(upvote_ratio, {D(0.0)}) AS upvote_ratio,
       coalesce(is_self, false) AS is_self, link_flair_text, {AS_OF} AS ingested_at
FROM landing""", "landing", "as_of"))

# ---------------------------------------------------------------------------------------------
# K2-K4, J1, K6, K13 (batch 1 = arrived before as_of - 24h)
# ---------------------------------------------------------------------------------------------
cte("b1", ["landing", "as_of"], f"SELECT * FROM landing WHERE ingested_at < {AS_OF} - INTERVAL 24 HOUR")
cte("b2", ["landing", "as_of"], f"SELECT * FROM landing WHERE ingested_at >= {AS_OF} - INTERVAL 24 HOUR")
cte("stored1", ["b1"], f"""
SELECT * FROM b1 WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at, msg_offset) = 1""")
cte("ins2", ["b2", "stored1"], f"""
SELECT * FROM (SELECT * FROM b2 WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at, msg_offset) = 1) n
WHERE NOT EXISTS (SELECT 1 FROM stored1 s WHERE s.id = n.id)""")
register("insert_if_absent", sql("SELECT id, score, num_comments, ingested_at FROM ins2", "ins2"))
register("ingest_counts", sql(f"""
SELECT (SELECT count(*) FROM ins2) AS inserted, count_if({_VALID}) - (SELECT count(*) FROM ins2) AS duplicates,
       count_if(NOT ({_VALID})) AS errors FROM b2""", "ins2", "b2"))
register("rollup_incremental", sql("SELECT * FROM minutes", "minutes"))
register("ingest_batches", sql(f"""
SELECT CAST(b.batch AS INTEGER) AS batch, b.from_offset, b.upto_offset, count(DISTINCT CASE WHEN m.first_batch = b.batch THEN m.id END) AS inserted,
       count_if(m.ok) - count(DISTINCT CASE WHEN m.first_batch = b.batch THEN m.id END) AS duplicates, count_if(NOT m.ok) AS errors
FROM (SELECT k AS batch, CASE WHEN k = 0 THEN -1 ELSE top * k // 4 END AS from_offset, top * (k + 1) // 4 AS upto_offset
      FROM (SELECT max(msg_offset) AS top FROM landing), (SELECT unnest(range(4)) AS k)) b
JOIN (SELECT *, min(CASE WHEN ok THEN least(3, CASE WHEN msg_offset <= top * 1 // 4 THEN 0 WHEN msg_offset <= top * 2 // 4 THEN 1
                    WHEN msg_offset <= top * 3 // 4 THEN 2 ELSE 3 END) END) OVER (PARTITION BY id) AS first_batch
      FROM (SELECT *, ({_VALID}) AS ok, max(msg_offset) OVER () AS top FROM landing)) m
  ON m.msg_offset > b.from_offset AND m.msg_offset <= b.upto_offset
GROUP BY b.batch, b.from_offset, b.upto_offset""", "landing"))
register("rollup_merge", sql("SELECT * FROM minutes", "minutes"))
register("unscored_posts", sql(f"""
SELECT p.id, p.subreddit, p.minute FROM posts p WHERE p.ingested_at >= {AS_OF} - INTERVAL 24 HOUR
AND NOT EXISTS (SELECT 1 FROM scored_c s WHERE s.ingested_at < {AS_OF} - INTERVAL 24 HOUR AND s.subreddit = p.subreddit
                AND s.minute = p.minute)""", "posts", "scored_c", "as_of"))
register("enrich_update", sql("SELECT id, vehicles, energy_products, issues, primary_product FROM scored_c", "scored_c"))
register("lake_partitions", sql("""
SELECT year(created_utc) AS year, month(created_utc) AS month, day(created_utc) AS day, hour(created_utc) AS hour, count(*) AS rows
FROM posts GROUP BY 1, 2, 3, 4""", "posts"))

cte("bursts", ["topics_kw", "tdocs", "posts"], f"""
SELECT subreddit, keyword, day, posts, {rnd('before / ' + D(7.0), 6)} AS baseline, {rnd('posts / (before / ' + D(7.0) + ')', 6)} AS ratio
FROM (SELECT *, CAST(sum(posts) OVER (PARTITION BY subreddit, keyword ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS DOUBLE) AS before
      FROM (SELECT k.subreddit, k.keyword, CAST(p.created_utc AS DATE) AS day, count(*) AS posts
            FROM topics_kw k JOIN tdocs d ON d.subreddit = k.subreddit AND contains(lower(d.text), k.keyword) JOIN posts p ON p.id = d.id
            GROUP BY k.subreddit, k.keyword, CAST(p.created_utc AS DATE)))
WHERE before > 0 AND posts >= 5 AND posts > before / {D(7.0)} * {D(2.0)}""")
_NP = rnd("sum(negative_count) * " + D(100.0) + " / sum(posts_count)", 1)
register("declared_alert_rules", sql(f"""
SELECT 'data_freshness' AS rule, 'high' AS severity, subreddit, {rnd('m', 2)} AS value, {D(10.0)} AS threshold
FROM (SELECT subreddit, {mins_between(AS_OF, 'max(created_utc)')} AS m FROM posts GROUP BY subreddit) WHERE m > 10
UNION ALL
SELECT 'negative_sentiment_spike', 'medium', subreddit, np / 100, {D(0.5)}
FROM (SELECT subreddit, {_NP} AS np FROM minutes GROUP BY subreddit) WHERE np / 100 > 0.5
UNION ALL
SELECT 'processing_error_rate', 'high', CAST(NULL AS VARCHAR), {rnd('rate', 6)}, {D(0.05)}
FROM (SELECT CAST(count_if(NOT ({_VALID})) AS DOUBLE) / count(*) AS rate FROM b2) WHERE rate > 0.05
UNION ALL
SELECT 'volume_spike_3x', 'medium', subreddit, max(ratio), {D(3.0)} FROM (
  SELECT m.subreddit, {rnd('m.posts_count / v.avg_volume', 6)} AS ratio, m.posts_count, v.avg_volume FROM minutes m
  JOIN (SELECT subreddit, sum(posts_count) / count(*) AS avg_volume FROM minutes GROUP BY subreddit) v ON m.subreddit = v.subreddit
  WHERE v.avg_volume > 0 AND (m.posts_count > v.avg_volume * {D(3.0)} OR m.posts_count < v.avg_volume / {D(3.0)}))
WHERE posts_count > avg_volume GROUP BY subreddit
UNION ALL
SELECT 'sentiment_drop', 'medium', subreddit, max({rnd('(prev - s) / prev', 6)}), {D(0.5)} FROM (
  SELECT subreddit, hour, s, lag(s) OVER (PARTITION BY subreddit ORDER BY hour) AS prev FROM (
    SELECT subreddit, date_trunc('hour', minute) AS hour,
           CAST(sum(CAST(round(avg_sentiment * posts_count * {D(1e4)}) AS BIGINT)) AS DOUBLE) / {D(1e4)} / sum(posts_count) AS s
    FROM minutes GROUP BY 1, 2))
WHERE prev > 0 AND s < prev * {D(0.5)} GROUP BY subreddit
UNION ALL
SELECT 'keyword_frequency', 'medium', subreddit, max(ratio), {D(2.0)} FROM bursts GROUP BY subreddit""", "posts", "minutes", "b2", "as_of", "bursts"))

# ---------------------------------------------------------------------------------------------
# Streams: slices of the log by arrival; the watermark of a slice comes from the slices before it
# ---------------------------------------------------------------------------------------------
cte("sliced", ["landing"], f"""
SELECT *, (epoch_us(ingested_at) - lo) // ((hi - lo) // 4 + 1) AS slice
FROM (SELECT *, min(epoch_us(ingested_at)) OVER () AS lo, max(epoch_us(ingested_at)) OVER () AS hi FROM landing)""")
cte("marks", ["sliced"], f"""
SELECT k.slice, (SELECT max(created_utc) FROM sliced s WHERE s.slice < k.slice AND {_VALID}) - INTERVAL 10 MINUTE AS mark
FROM (SELECT unnest(range(4)) AS slice) k""")
cte("streamed", ["sliced", "marks"], f"""
SELECT id, min(slice) AS slice FROM sliced JOIN marks USING (slice) WHERE {_VALID} AND (mark IS NULL OR created_utc > mark) GROUP BY id""")
cte("s_scored", ["streamed", "scored_c"], "SELECT c.*, s.slice FROM scored_c c JOIN streamed s USING (id)")
cte("s_minutes", ["s_scored"], f"""
SELECT minute, subreddit, count(*) AS posts_count,
       CAST(sum(CAST(round(compound * {D(1e4)}) AS BIGINT)) AS DOUBLE) / {D(1e4)} / count(*) AS avg_sentiment,
       CAST(count_if(category = 'positive') AS BIGINT) AS positive_count,
       CAST(count_if(category = 'negative') AS BIGINT) AS negative_count,
       CAST(count_if(category = 'neutral') AS BIGINT) AS neutral_count
FROM s_scored WHERE minute + INTERVAL 1 MINUTE <= (SELECT max(created_utc) FROM s_scored) - INTERVAL 10 MINUTE
GROUP BY minute, subreddit""")


def expanding(src: str) -> str:
    z = rnd("abs(avg_sentiment - prior_mean) / prior_std", 6)
    return f"""
SELECT subreddit, minute, avg_sentiment, prior_n, prior_mean, prior_std, {z} AS z_score,
       CASE WHEN {z} > 3 THEN 'CRITICAL' WHEN {z} > 2.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM (SELECT subreddit, minute, avg_sentiment, prior_n, CAST(a AS DOUBLE) / CAST(prior_n AS DOUBLE) / {D(1e6)} AS prior_mean,
             {rnd('sqrt(CAST(prior_n * b - a * a AS DOUBLE) / (CAST(prior_n AS DOUBLE) * (CAST(prior_n AS DOUBLE) - 1))) / ' + D(1e6), 9)} AS prior_std
      FROM (SELECT subreddit, minute, avg_sentiment, count(*) OVER w AS prior_n, sum(u) OVER w AS a, sum(u * u) OVER w AS b
            FROM (SELECT *, CAST(round(avg_sentiment * {D(1e6)}) AS HUGEINT) AS u FROM {src})
            WINDOW w AS (PARTITION BY subreddit ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      WHERE prior_n >= 2 AND prior_n * b - a * a > 0)
WHERE prior_std > 0 AND {z} > {D(2.0)}"""


register("stream_ingest", sql("SELECT id, subreddit, minute, compound, category, dense_rank() OVER (ORDER BY slice) AS slice FROM s_scored", "s_scored"))
register("stream_dedupe", sql("SELECT id, 1 AS copies FROM s_scored", "s_scored"))
register("stream_quarantine", sql(f"""
SELECT concat('missing: ', concat_ws(', ', CASE WHEN id IS NULL THEN 'id' END, CASE WHEN title IS NULL THEN 'title' END,
  CASE WHEN author IS NULL THEN 'author' END, CASE WHEN created_utc IS NULL THEN 'created_utc' END,
  CASE WHEN subreddit IS NULL THEN 'subreddit' END)) AS reason, count(*) AS messages
FROM landing WHERE NOT ({_VALID}) GROUP BY 1""", "landing"))
register("stream_minute_rollup", sql("SELECT * FROM s_minutes", "s_minutes"))
register("stream_anomaly", sql(expanding("s_minutes"), "s_minutes"))
register("expanding_anomaly", sql(expanding("minutes"), "minutes"))

# ---------------------------------------------------------------------------------------------
# Details, rankings, bursts, another lexicon
# ---------------------------------------------------------------------------------------------
_MEAN6 = f"CAST(sum(CAST(round(sentiment * {D(1e6)}) AS BIGINT)) AS DOUBLE) / {D(1e6)} / count(*)"
register("product_timeline", sql(f"""
SELECT primary_product, date_trunc('hour', minute) AS time, {_MEAN6} AS sentiment, count(*) AS posts
FROM (SELECT c.primary_product, c.minute, s.sentiment FROM scored_c c JOIN sentiments s USING (id)
      WHERE c.primary_product IS NOT NULL AND c.minute >= {AS_OF} - INTERVAL 7 DAY)
GROUP BY 1, 2""", "scored_c", "sentiments", "as_of"))
_POST = "rank, id, title, created_utc, score, num_comments, permalink"
register("product_top_posts", sql(f"""
SELECT primary_product, subreddit, {_POST} FROM (
  SELECT *, row_number() OVER (PARTITION BY primary_product ORDER BY score DESC, id) AS rank FROM scored_c WHERE primary_product IS NOT NULL)
WHERE rank <= 5""", "scored_c"))
register("community_top_posts", sql(f"""
SELECT subreddit, {_POST} FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, id) AS rank FROM scored_c)
WHERE rank <= 5""", "scored_c"))
_WEIGHTED = f"CAST(sum(CAST(round(avg_sentiment * posts_count * {D(1e4)}) AS BIGINT)) AS DOUBLE) / {D(1e4)} / sum(posts_count)"
register("community_timeline", sql(f"""
SELECT subreddit, date_trunc('hour', minute) AS time, {_WEIGHTED} AS sentiment, CAST(sum(posts_count) AS BIGINT) AS posts
FROM minutes WHERE minute >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1, 2""", "minutes", "as_of"))
cte("c_stats", ["minutes"], f"""
SELECT subreddit, CAST(sum(posts_count) AS BIGINT) AS post_count, {_WEIGHTED} AS avg_sentiment,
       {rnd('sum(positive_count) * ' + D(100.0) + ' / sum(posts_count)', 1)} AS positive_percent,
       {rnd('sum(negative_count) * ' + D(100.0) + ' / sum(posts_count)', 1)} AS negative_percent,
       {rnd('sum(neutral_count) * ' + D(100.0) + ' / sum(posts_count)', 1)} AS neutral_percent
FROM minutes GROUP BY subreddit""")
register("communities_ranked", sql("""
SELECT subreddit, post_count, avg_sentiment, rp AS rank_by_posts, rs AS rank_by_sentiment, rp = 1 AS most_posts, rs = 1 AS best_sentiment
FROM (SELECT *, row_number() OVER (ORDER BY post_count DESC, subreddit) AS rp, row_number() OVER (ORDER BY coalesce(avg_sentiment, 0.0) DESC, subreddit) AS rs
      FROM c_stats)""", "c_stats"))
register("community_detail", sql("""
SELECT s.*, e.vehicles, e.energy_products, e.issues, coalesce(a.n, 0) AS active_alerts, coalesce(a.ids, []::VARCHAR[]) AS alert_ids
FROM c_stats s
LEFT JOIN (SELECT subreddit, CAST(sum(len(vehicles)) AS BIGINT) AS vehicles, CAST(sum(len(energy_products)) AS BIGINT) AS energy_products,
                  CAST(sum(len(issues)) AS BIGINT) AS issues FROM scored_c GROUP BY subreddit) e USING (subreddit)
LEFT JOIN (SELECT subreddit, count(*) AS n, list(alert_id ORDER BY detected_at DESC, alert_id DESC)[1:10] AS ids
           FROM ledger WHERE NOT resolved AND subreddit IS NOT NULL GROUP BY subreddit) a USING (subreddit)""", "c_stats", "scored_c", "ledger"))
register("target_communities", sql(f"""
SELECT t.subreddit, CAST(t.ord AS INTEGER) AS ord, coalesce(n, 0) AS posts
FROM (SELECT unnest({[*fx.COMMUNITIES[:2], *(f"c{k}" for k in range(7))]}) AS subreddit, unnest(range(9)) AS ord) t
LEFT JOIN (SELECT subreddit, count(*) AS n FROM posts GROUP BY subreddit) p USING (subreddit)""", "posts"))
register("keyword_frequency_anomaly", sql("SELECT * FROM bursts", "bursts"))
cte("lexicon2", [], "SELECT * FROM (VALUES " + ", ".join(f"({q(t)}, {D(v)})" for t, v in fx.SERVICE_LEXICON) + ") AS l(token, valence)")
for _name in ("_hits", "scored", "scored_c"):
    _deps, _body = CTES[_name]
    for _old in ("lexicon", "_hits", "scored"):
        _deps = [f"{d}2" if d == _old else d for d in _deps]
        _body = _body.replace(f"JOIN {_old} ", f"JOIN {_old}2 ").replace(f"FROM {_old}", f"FROM {_old}2")
    cte(f"{_name}2", _deps, _body)
register("sentiment_lexicon", sql("SELECT id, compound, category FROM scored_c2", "scored_c2"))

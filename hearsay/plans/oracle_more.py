"""DuckDB SQL for the remaining keys (detector runs, alert ledger, quality, daily, topics,
serving, sources and sinks). See ``oracle`` for the conventions."""

from __future__ import annotations

from ..functions import validate as va
from ..sources import fixtures as fx
from ..sources import listing as li
from .oracle import (AS_OF, COMBINED, PERMALINK, TS_TEXT, D, alert_id, cte, in_list, lower, q, register, rnd,
                     sql)


def at_expr(h: int) -> str:
    return f"({AS_OF} - INTERVAL {h} HOUR)" if h else AS_OF


UNITS6 = "CAST(sum(CAST(round({c} * CAST(1000000.0 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / CAST(1000000.0 AS DOUBLE) / count({c})"

# ---------------------------------------------------------------------------------------------
# Post sentiment (A21), topics docs, global and per-community TF-IDF, clusters
# ---------------------------------------------------------------------------------------------
cte("sentiments", ["posts", "minutes"], """
SELECT p.id, p.subreddit, p.minute, coalesce(m.avg_sentiment, CAST(0.0 AS DOUBLE)) AS sentiment
FROM posts p LEFT JOIN minutes m ON p.subreddit = m.subreddit AND p.minute = m.minute""")

STOP = in_list(fx.english_stop_words())
cte("tdocs", ["posts"], """
SELECT id, subreddit,
       CASE WHEN selftext IS NOT NULL AND length(selftext) > 0 THEN concat(title, ' ', selftext) ELSE title END AS text
FROM posts WHERE title IS NOT NULL""")
cte("tterms", ["tdocs"], f"""
SELECT id, subreddit, toks || CASE WHEN len(toks) >= 2 THEN list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])
                              ELSE []::VARCHAR[] END AS terms
FROM (SELECT id, subreddit,
             list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT (t IN {STOP})) AS toks
      FROM tdocs)""")
cte("ttf", ["tterms"], """
SELECT subreddit, id, term, count(*) AS tf FROM (SELECT subreddit, id, unnest(terms) AS term FROM tterms)
GROUP BY subreddit, id, term""")
cte("cvocab", ["ttf", "tdocs"], f"""
SELECT subreddit, term, df, n, ln((CAST(1.0 AS DOUBLE) + n) / (CAST(1.0 AS DOUBLE) + df)) + CAST(1.0 AS DOUBLE) AS idf
FROM (SELECT d.subreddit, d.term, d.df, d.total, c.n,
             row_number() OVER (PARTITION BY d.subreddit ORDER BY d.total DESC, d.term) AS r
      FROM (SELECT subreddit, term, count(*) AS df, sum(tf) AS total FROM ttf GROUP BY subreddit, term) d
      JOIN (SELECT subreddit, count(*) AS n FROM tdocs GROUP BY subreddit) c ON d.subreddit = c.subreddit
      WHERE d.df >= 2 AND d.df <= c.n * {D(0.8)})
WHERE r <= 100""")
cte("cweights", ["ttf", "cvocab"], """
SELECT subreddit, id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w
FROM (SELECT t.subreddit, t.id, t.term, t.tf * v.idf AS raw FROM ttf t JOIN cvocab v ON t.subreddit = v.subreddit AND t.term = v.term)""")
cte("topics_kw", ["cweights", "cvocab"], f"""
SELECT subreddit, keyword, score, rank FROM (
  SELECT subreddit, keyword, score, row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, keyword) AS rank
  FROM (SELECT w.subreddit, w.term AS keyword, {rnd('sum(w.w) / any_value(n.n)', 6)} AS score
        FROM cweights w JOIN (SELECT DISTINCT subreddit, n FROM cvocab) n ON w.subreddit = n.subreddit
        GROUP BY w.subreddit, w.term))
WHERE rank <= 10""")
cte("topics_tbl", ["topics_kw", "tdocs", "sentiments"], f"""
SELECT k.subreddit, k.keyword, k.score, coalesce(h.post_count, 0) AS post_count,
       coalesce(h.u / {D(1e6)} / h.post_count, {D(0.0)}) AS avg_sentiment
FROM topics_kw k LEFT JOIN (
  SELECT k2.subreddit, k2.keyword, count(*) AS post_count,
         CAST(sum(CAST(round(s.sentiment * {D(1e6)}) AS BIGINT)) AS DOUBLE) AS u
  FROM tdocs d JOIN sentiments s ON d.id = s.id
  JOIN topics_kw k2 ON d.subreddit = k2.subreddit AND contains(lower(d.text), k2.keyword)
  GROUP BY k2.subreddit, k2.keyword) h ON k.subreddit = h.subreddit AND k.keyword = h.keyword""")

cte("gtf", ["ttf"], "SELECT id, term, tf FROM ttf")
cte("gvocab", ["gtf", "tdocs"], f"""
SELECT term, df, n, ln((CAST(1.0 AS DOUBLE) + n) / (CAST(1.0 AS DOUBLE) + df)) + CAST(1.0 AS DOUBLE) AS idf
FROM (SELECT term, count(*) AS df, sum(tf) AS total, (SELECT count(*) FROM tdocs) AS n FROM gtf GROUP BY term)
WHERE df >= 2 ORDER BY total DESC, term LIMIT 200""")
cte("gweights", ["gtf", "gvocab"], """
SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w
FROM (SELECT t.id, t.term, t.tf * v.idf AS raw FROM gtf t JOIN gvocab v ON t.term = v.term)""")
# K-Means in whole numbers: first centres far apart, then rounds of assignment and means, a CTE a step.
K, ROUNDS = 7, 6
cte("gindex", ["gvocab"], "SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM gvocab", once=True)
cte("gvec", ["gweights", "gindex", "tdocs"], f"""
SELECT d.id, coalesce(array_to_string(v.i, ','), '') || '|' || coalesce(array_to_string(v.w, ','), '') AS vkey, v.i, v.w
FROM tdocs d LEFT JOIN (
  SELECT id, list(idx ORDER BY idx) AS i, list(CAST(round(w * {D(1e4)}) AS BIGINT) ORDER BY idx) AS w
  FROM gweights JOIN gindex USING (term) GROUP BY id) v ON d.id = v.id""", once=True)
cte("dvec", ["gvec"], """
SELECT vkey, count(*) AS n, any_value(i) AS i, any_value(w) AS w,
       CAST(coalesce(list_sum(list_transform(any_value(w), lambda x: x * x)), 0) AS BIGINT) AS sq
FROM gvec GROUP BY vkey""", once=True)
cte("dent", ["dvec"], "SELECT vkey, n, unnest(i) AS idx, unnest(w) AS w FROM dvec", once=True)
cte("far_0", ["dvec"], "SELECT vkey, n, sq, CAST(NULL AS BIGINT) AS gap FROM dvec", once=True)
cte("seed_0", ["far_0"], "SELECT vkey, sq FROM far_0 ORDER BY n DESC, vkey LIMIT 1", once=True)
for _s in range(1, K):
    cte(f"far_{_s}", [f"far_{_s - 1}", f"seed_{_s - 1}", "dent"], f"""
SELECT f.vkey, f.n, f.sq, least(f.gap, f.sq + c.sq - 2 * coalesce(d.dot, 0)) AS gap
FROM far_{_s - 1} f, seed_{_s - 1} c LEFT JOIN (
  SELECT a.vkey, CAST(sum(a.w * b.w) AS BIGINT) AS dot FROM dent a JOIN dent b ON a.idx = b.idx
  WHERE b.vkey = (SELECT vkey FROM seed_{_s - 1}) GROUP BY a.vkey) d ON d.vkey = f.vkey""", once=True)
    cte(f"seed_{_s}", [f"far_{_s}"], f"SELECT vkey, sq FROM far_{_s} ORDER BY n * gap DESC, vkey LIMIT 1", once=True)
cte("centres_1", ["dent"] + [f"seed_{_s}" for _s in range(K)],
    " UNION ALL ".join(f"SELECT {_s} AS j, e.idx, 100 * e.w AS c FROM dent e JOIN seed_{_s} s ON s.vkey = e.vkey" for _s in range(K)), once=True)
for _r in range(1, ROUNDS + 1):
    cte(f"placed_{_r}", [f"centres_{_r}", "dent", "dvec"], f"""
SELECT v.vkey, v.n, k.j FROM dvec v CROSS JOIN (SELECT CAST(unnest(range({K})) AS INTEGER) AS j) k
LEFT JOIN (SELECT e.vkey, c.j, CAST(sum(e.w * c.c) AS BIGINT) AS dot FROM dent e JOIN centres_{_r} c ON e.idx = c.idx GROUP BY e.vkey, c.j) d
  ON d.vkey = v.vkey AND d.j = k.j
LEFT JOIN (SELECT j, CAST(sum(c * c) AS BIGINT) AS sq FROM centres_{_r} GROUP BY j) q ON q.j = k.j
QUALIFY row_number() OVER (PARTITION BY v.vkey ORDER BY 200 * coalesce(d.dot, 0) - coalesce(q.sq, 0) DESC, k.j) = 1""", once=True)
    if _r < ROUNDS:
        cte(f"centres_{_r + 1}", [f"placed_{_r}", f"centres_{_r}", "dent"], f"""
SELECT * FROM (
  SELECT p.j, e.idx, CAST(100 * CAST(sum(e.n * e.w) AS BIGINT) // any_value(z.n) AS BIGINT) AS c
  FROM placed_{_r} p JOIN dent e USING (vkey) JOIN (SELECT j, CAST(sum(n) AS BIGINT) AS n FROM placed_{_r} GROUP BY j) z ON z.j = p.j
  GROUP BY p.j, e.idx) WHERE c > 0
UNION ALL SELECT * FROM centres_{_r} WHERE j NOT IN (SELECT j FROM placed_{_r})""", once=True)
cte("labels", ["gvec", f"placed_{ROUNDS}"], f"SELECT g.id, p.j AS cluster_id FROM gvec g JOIN placed_{ROUNDS} p USING (vkey)", once=True)
cte("model", [f"centres_{ROUNDS}", "gindex"], f"""
SELECT CAST(k.j AS INTEGER) AS cluster_id, CAST(c.idx AS INTEGER) AS idx, g.term, coalesce(c.c, 0) AS weight
FROM (SELECT unnest(range({K})) AS j) k LEFT JOIN centres_{ROUNDS} c ON c.j = k.j LEFT JOIN gindex g ON g.idx = c.idx""")
cte("cluster_kw", ["model"], """
SELECT cluster_id, list(term ORDER BY r) AS keywords FROM (
  SELECT cluster_id, term, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) AS r FROM model WHERE weight > 0)
WHERE r <= 5 GROUP BY cluster_id""")
SEVERITY_SCORE = (f"(greatest({D(0.0)}, -{{a}}) * {D(0.7)} + least({{n}} / {D(10.0)}, {D(1.0)}) * {D(0.3)})")


def cluster_sev(a: str, n: str) -> str:
    sc = SEVERITY_SCORE.format(a=a, n=n)
    return f"CASE WHEN {sc} > 0.7 THEN 'CRITICAL' WHEN {sc} > 0.5 THEN 'HIGH' WHEN {sc} > 0.3 THEN 'MEDIUM' ELSE 'LOW' END"


cte("clusters", ["labels", "sentiments", "cluster_kw"], f"""
SELECT g.cluster_id, array_to_string(coalesce(k.keywords, []::VARCHAR[])[1:3], ' | ') AS cluster_name,
       f.first_post_ids, coalesce(k.keywords, []::VARCHAR[]) AS keywords, g.avg_sentiment, g.post_count,
       {cluster_sev('g.avg_sentiment', 'g.post_count')} AS severity
FROM (SELECT l.cluster_id, count(*) AS post_count,
             CAST(sum(CAST(round(s.sentiment * {D(1e6)}) AS BIGINT)) AS DOUBLE) / {D(1e6)} / count(*) AS avg_sentiment
      FROM labels l JOIN sentiments s ON l.id = s.id GROUP BY l.cluster_id) g
JOIN (SELECT cluster_id, list(id ORDER BY id) AS first_post_ids
      FROM (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS r FROM labels)
      WHERE r <= 10 GROUP BY cluster_id) f ON g.cluster_id = f.cluster_id
LEFT JOIN cluster_kw k ON g.cluster_id = k.cluster_id""")

# ---------------------------------------------------------------------------------------------
# Detector runs (C1-C4, U1) at as_of - h over the data seen by then
# ---------------------------------------------------------------------------------------------
ALERT_COLS = "alert_id, alert_type, severity, subreddit, message, metric_value, threshold, metadata, detected_at, detector, rank"


def detector_run(tag: str, h: int, with_clusters: bool) -> str:
    at = at_expr(h)
    where_m = f"WHERE minute < {at}" if h else ""
    where_s = f"WHERE created_utc < {at}" if h else ""
    cte(f"m_{tag}", ["minutes", "as_of"], f"SELECT * FROM minutes {where_m}")
    cte(f"s_{tag}", ["scored_c", "as_of"], f"SELECT * FROM scored_c {where_s}")
    cte(f"stats_{tag}", [f"m_{tag}"], f"""
SELECT subreddit, CAST(sum(CAST(round(avg_sentiment * {D(1e6)}) AS BIGINT)) AS DOUBLE) / {D(1e6)} / count(*) AS mean,
       {rnd('stddev_samp(avg_sentiment)', 9)} AS std
FROM m_{tag} GROUP BY subreddit""")
    z = rnd("abs(m.avg_sentiment - s.mean) / s.std", 6)
    cte(f"stop_{tag}", [f"m_{tag}", f"stats_{tag}"], f"""
SELECT *, row_number() OVER (ORDER BY z_score DESC, subreddit, minute) AS rank FROM (
  SELECT m.*, s.mean, s.std, {z} AS z_score FROM m_{tag} m JOIN stats_{tag} s ON m.subreddit = s.subreddit
  WHERE s.std > 0 AND {z} > {D(2.0)})
ORDER BY z_score DESC, subreddit, minute LIMIT 10""")
    cte(f"sposts_{tag}", [f"stop_{tag}", f"s_{tag}"], f"""
SELECT subreddit, minute, list(id ORDER BY rn) AS post_ids, list(substring(title, 1, 100) ORDER BY rn) AS post_titles,
       list(permalink ORDER BY rn) AS post_links
FROM (SELECT p.subreddit, p.minute, p.id, p.title, p.permalink,
             row_number() OVER (PARTITION BY p.subreddit, p.minute ORDER BY p.created_utc DESC, p.id DESC) AS rn
      FROM s_{tag} p JOIN stop_{tag} t ON p.subreddit = t.subreddit AND p.minute = t.minute)
WHERE rn <= 5 GROUP BY subreddit, minute""")
    cte(f"asent_{tag}", [f"stop_{tag}", f"sposts_{tag}", "as_of"], f"""
SELECT {alert_id("'SENTIMENT_ANOMALY'", 't.subreddit', TS_TEXT.format('t.minute'))} AS alert_id,
       'SENTIMENT_ANOMALY' AS alert_type,
       CASE WHEN t.z_score > 3 THEN 'CRITICAL' WHEN t.z_score > 2.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       t.subreddit,
       printf('r/%s sentiment (%.3f) is %.2f std devs from mean (%.3f), trending %s', t.subreddit,
              {rnd('t.avg_sentiment', 3)}, {rnd('t.z_score', 2)}, {rnd('t.mean', 3)},
              CASE WHEN t.avg_sentiment < t.mean THEN 'negative' ELSE 'positive' END) AS message,
       t.avg_sentiment AS metric_value, t.mean AS threshold,
       to_json({{'z_score': t.z_score, 'std_dev': t.std, 'post_count': t.posts_count,
                'timestamp': {TS_TEXT.format('t.minute')},
                'post_ids': coalesce(sp.post_ids, []::VARCHAR[]), 'post_titles': coalesce(sp.post_titles, []::VARCHAR[]),
                'post_links': coalesce(sp.post_links, []::VARCHAR[])}}) AS metadata,
       {at} AS detected_at, 1 AS detector, t.rank
FROM stop_{tag} t LEFT JOIN sposts_{tag} sp ON t.subreddit = sp.subreddit AND t.minute = sp.minute""")
    cte(f"vcand_{tag}", [f"m_{tag}"], f"""
SELECT *, {rnd('posts_count / avg_volume', 6)} AS ratio, {rnd('abs(posts_count - avg_volume)', 6)} AS gap FROM (
  SELECT m.*, v.avg_volume FROM m_{tag} m
  JOIN (SELECT subreddit, sum(posts_count) / count(*) AS avg_volume FROM m_{tag} GROUP BY subreddit) v ON m.subreddit = v.subreddit)
WHERE avg_volume > 0 AND (posts_count > avg_volume * {D(2.0)} OR posts_count < avg_volume / {D(2.0)})""")
    cte(f"avol_{tag}", [f"vcand_{tag}", "as_of"], f"""
SELECT {alert_id("'VOLUME_ANOMALY'", 'subreddit', TS_TEXT.format('minute'))} AS alert_id, 'VOLUME_ANOMALY' AS alert_type,
       CASE WHEN posts_count > avg_volume THEN (CASE WHEN ratio > 3 THEN 'HIGH' ELSE 'MEDIUM' END)
            ELSE (CASE WHEN ratio < 0.5 THEN 'MEDIUM' ELSE 'LOW' END) END AS severity,
       subreddit,
       printf('r/%s volume %s: %d posts vs %.1f average (%.2fx)', subreddit,
              CASE WHEN posts_count > avg_volume THEN 'spike' ELSE 'drop' END, posts_count,
              {rnd('avg_volume', 1)}, {rnd('ratio', 2)}) AS message,
       CAST(posts_count AS DOUBLE) AS metric_value, {rnd('avg_volume', 6)} AS threshold,
       to_json({{'ratio': ratio, 'timestamp': {TS_TEXT.format('minute')}}}) AS metadata,
       {at} AS detected_at, 2 AS detector, row_number() OVER (ORDER BY gap DESC, subreddit, minute) AS rank
FROM vcand_{tag} ORDER BY gap DESC, subreddit, minute LIMIT 5""")
    cte(f"aext_{tag}", [f"s_{tag}", f"m_{tag}", "as_of"], f"""
SELECT {alert_id("'EXTREME_POST'", 'subreddit', 'id')} AS alert_id, 'EXTREME_POST' AS alert_type,
       CASE WHEN num_comments > 50 OR score > 100 THEN 'HIGH' WHEN avg_sentiment < -0.7 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity,
       subreddit,
       printf('r/%s: Very negative post (%.3f) - ''%s...''', subreddit, {rnd('avg_sentiment', 3)}, substring(title, 1, 100)) AS message,
       avg_sentiment AS metric_value, {D(-0.5)} AS threshold,
       to_json({{'post_id': id, 'score': score, 'comments': num_comments, 'title': substring(title, 1, 200),
                'permalink': permalink}}) AS metadata,
       {at} AS detected_at, 4 AS detector, row_number() OVER (ORDER BY avg_sentiment, id) AS rank
FROM (SELECT p.*, m.avg_sentiment FROM s_{tag} p JOIN m_{tag} m ON p.subreddit = m.subreddit AND p.minute = m.minute
      WHERE m.avg_sentiment < {D(-0.5)})
ORDER BY avg_sentiment, id LIMIT 5""")
    parts = [f"SELECT {ALERT_COLS} FROM asent_{tag}", f"SELECT {ALERT_COLS} FROM avol_{tag}"]
    deps = [f"asent_{tag}", f"avol_{tag}", f"aext_{tag}"]
    if with_clusters:
        cte(f"aclu_{tag}", ["clusters", "as_of"], f"""
SELECT {alert_id("'KEYWORD_ANOMALY'", 'CAST(NULL AS VARCHAR)', 'CAST(cluster_id AS VARCHAR)')} AS alert_id,
       'KEYWORD_ANOMALY' AS alert_type,
       CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN severity ELSE 'MEDIUM' END AS severity,
       CAST(NULL AS VARCHAR) AS subreddit,
       printf('Issue cluster ''%s'' has negative sentiment (%.3f) across %d posts', cluster_name,
              {rnd('avg_sentiment', 3)}, post_count) AS message,
       avg_sentiment AS metric_value, {D(0.0)} AS threshold,
       to_json({{'cluster_id': cluster_id, 'keywords': keywords[1:3], 'post_count': post_count,
                'post_ids': first_post_ids[1:10]}}) AS metadata,
       {at} AS detected_at, 3 AS detector, row_number() OVER (ORDER BY avg_sentiment, cluster_id) AS rank
FROM clusters WHERE avg_sentiment < -0.1 OR severity IN ('HIGH', 'CRITICAL')
ORDER BY avg_sentiment, cluster_id LIMIT 5""")
        parts.append(f"SELECT {ALERT_COLS} FROM aclu_{tag}")
        deps.append(f"aclu_{tag}")
    parts.append(f"SELECT {ALERT_COLS} FROM aext_{tag}")
    cte(f"cand_{tag}", deps, "\nUNION ALL\n".join(parts))
    return f"cand_{tag}"


LEDGER_COLS = "alert_id, alert_type, severity, subreddit, message, metric_value, threshold, metadata, detected_at"


def suppress(tag: str, cand: str, ledger: str | None, h: int) -> str:
    at = at_expr(h)
    anti = ""
    deps = [cand]
    if ledger:
        deps.append(ledger)
        anti = f"""AND NOT EXISTS (SELECT 1 FROM {ledger} l WHERE l.alert_type = c.alert_type
                  AND l.subreddit IS NOT DISTINCT FROM c.subreddit AND NOT l.resolved
                  AND l.detected_at > {at} - INTERVAL 24 HOUR)"""
    cte(f"acc_{tag}", deps + ["as_of"], f"""
SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.alert_type, c.subreddit ORDER BY c.detector, c.rank) AS _k
               FROM {cand} c) c
WHERE _k = 1 {anti}""")
    return f"acc_{tag}"


def autoresolve_sql(src: str, h: int) -> str:
    at = at_expr(h)
    old = f"(NOT resolved AND detected_at < {at} - INTERVAL 24 HOUR)"
    return (f"SELECT {LEDGER_COLS}, CASE WHEN {old} THEN true ELSE resolved END AS resolved, "
            f"CASE WHEN {old} THEN {at} ELSE resolved_at END AS resolved_at FROM ({src})")


def ledger_chain() -> None:
    prev = None
    for h in (30, 6):
        tag = f"h{h}"
        cand = detector_run(tag, h, False)
        acc = suppress(tag, cand, prev, h)
        rows = f"SELECT {LEDGER_COLS}, false AS resolved, CAST(NULL AS TIMESTAMP) AS resolved_at FROM {acc}"
        union = rows if prev is None else f"SELECT * FROM {prev} UNION ALL {rows}"
        cte(f"ledger_{tag}", [acc] + ([prev] if prev else []) + ["as_of"], autoresolve_sql(union, h))
        prev = f"ledger_{tag}"
    cand = detector_run("now", 0, True)
    acc = suppress("now", cand, prev, 0)
    rows = f"SELECT {LEDGER_COLS}, false AS resolved, CAST(NULL AS TIMESTAMP) AS resolved_at FROM {acc}"
    cte("ledger", [acc, prev, "as_of"], autoresolve_sql(f"SELECT * FROM {prev} UNION ALL {rows}", 0))


ledger_chain()
register("anomaly_sentiment", sql(f"SELECT {ALERT_COLS} FROM asent_now", "asent_now"))
register("anomaly_volume", sql(f"SELECT {ALERT_COLS} FROM avol_now", "avol_now"))
register("anomaly_clusters", sql(f"SELECT {ALERT_COLS} FROM aclu_now", "aclu_now"))
register("anomaly_extreme_posts", sql(f"SELECT {ALERT_COLS} FROM aext_now", "aext_now"))
register("anomaly_sentiment_posts", sql("SELECT * FROM sposts_now", "sposts_now"))
register("alerts_all", sql(f"SELECT {ALERT_COLS} FROM cand_now", "cand_now"))
register("alerts_dedupe", sql(f"SELECT {ALERT_COLS} FROM acc_now", "acc_now"))
register("alerts_autoresolve", sql("SELECT * FROM ledger", "ledger"))
register("alert_messages", sql("SELECT alert_id, alert_type, message FROM cand_now", "cand_now"))
register("alert_metadata", sql("SELECT alert_id, metadata FROM cand_now", "cand_now"))
register("anomaly_run_summary", sql("""
SELECT 'type' AS dimension, alert_type AS value, count(*) AS count FROM cand_now GROUP BY alert_type
UNION ALL SELECT 'severity', severity, count(*) FROM cand_now GROUP BY severity
UNION ALL SELECT 'total', 'all', count(*) FROM cand_now""", "cand_now"))
SEV_RANK = "CASE {c} WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 END"
RECENT = f"detected_at > {AS_OF} - INTERVAL 24 HOUR"
register("alerts_by_severity", sql(f"""
SELECT severity, count, active, {SEV_RANK.format(c='severity')} AS severity_rank, sum(count) OVER () AS grand_total
FROM (SELECT severity, count(*) AS count, count_if(NOT resolved) AS active FROM ledger WHERE {RECENT} GROUP BY severity)""",
                                     "ledger"))
register("alerts_by_type", sql(f"SELECT alert_type, count(*) AS count FROM ledger WHERE {RECENT} GROUP BY alert_type", "ledger"))
register("critical_alert_gate", sql(f"""
SELECT critical_count, CASE WHEN critical_count > 0 THEN 'has_critical_alerts' ELSE 'no_critical_alerts' END AS branch
FROM (SELECT count_if(severity = 'CRITICAL' AND NOT resolved) AS critical_count FROM ledger WHERE {RECENT})""", "ledger"))
register("recent_critical", sql("""
SELECT alert_id, alert_type, severity, subreddit, substring(message, 1, 80) AS message, detected_at FROM ledger
WHERE severity IN ('CRITICAL', 'HIGH') AND NOT resolved ORDER BY detected_at DESC, alert_id LIMIT 5""", "ledger"))
register("alerts_feed", sql("SELECT * FROM ledger WHERE NOT resolved ORDER BY detected_at DESC, alert_id LIMIT 50", "ledger"))
register("alert_counts", sql("""
SELECT severity, count, sum(count) OVER () AS total FROM (SELECT severity, count(*) AS count FROM ledger WHERE NOT resolved GROUP BY severity)""",
                             "ledger"))
register("alert_resolve", sql(f"""
SELECT alert_id, CASE WHEN hit THEN true ELSE resolved END AS resolved, CASE WHEN hit THEN {AS_OF} ELSE resolved_at END AS resolved_at,
       coalesce(alert_id = t, false) AS matched
FROM (SELECT l.*, t.t, (l.alert_id = t.t AND NOT l.resolved) AS hit FROM ledger l,
      (SELECT min(alert_id) AS t FROM ledger WHERE NOT resolved) t)""", "ledger"))
_HOST = "'^https?://(www\\.)?reddit\\.com'"
_BYID = "concat('/r/', coalesce(subreddit, 'null'), '/comments/', {i}, '/')"
register("alert_links", sql(f"""
SELECT alert_id, replace(alert_type, '_', ' ') AS type_label,
  CASE WHEN json_extract(metadata, '$.post_links') IS NOT NULL AND json_type(metadata, '$.post_links') <> 'NULL'
         THEN list_transform(CAST(json_extract(metadata, '$.post_links') AS VARCHAR[]),
                             lambda l: CASE WHEN starts_with(l, 'http') THEN regexp_replace(l, {_HOST}, '') ELSE l END)
       WHEN json_extract(metadata, '$.permalinks') IS NOT NULL AND json_type(metadata, '$.permalinks') <> 'NULL'
         THEN CAST(json_extract(metadata, '$.permalinks') AS VARCHAR[])
       WHEN json_extract_string(metadata, '$.post_id') IS NOT NULL THEN [{_BYID.format(i="json_extract_string(metadata, '$.post_id')")}]
       WHEN json_extract(metadata, '$.post_ids') IS NOT NULL AND json_type(metadata, '$.post_ids') <> 'NULL'
         THEN list_transform(CAST(json_extract(metadata, '$.post_ids') AS VARCHAR[]), lambda i: {_BYID.format(i='i')})
       ELSE []::VARCHAR[] END AS links
FROM ledger""", "ledger"))
register("notify_candidates", sql(f"""
SELECT row_number() OVER (ORDER BY {SEV_RANK.format(c='severity')}, detected_at DESC, alert_id) AS position,
       alert_id, alert_type, severity, subreddit, message, detected_at,
       printf('[%s] Tesla Energy Alert - %d Issue(s) Detected',
              first_value(severity) OVER (ORDER BY {SEV_RANK.format(c='severity')}, detected_at DESC, alert_id
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), count(*) OVER ()) AS subject
FROM ledger WHERE detected_at > {AS_OF} - INTERVAL 1 HOUR AND severity IN ('CRITICAL', 'HIGH') AND NOT resolved""", "ledger"))

# rolling detector W6
register("rolling_anomaly", sql(f"""
SELECT subreddit, minute, avg_sentiment, prior_n, prior_mean, prior_std, z_score,
       CASE WHEN z_score > 3 THEN 'CRITICAL' WHEN z_score > 2.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM (SELECT *, {rnd('abs(avg_sentiment - prior_mean) / prior_std', 6)} AS z_score FROM (
  SELECT subreddit, minute, avg_sentiment,
         count(*) OVER w AS prior_n,
         CAST(sum(CAST(round(avg_sentiment * {D(1e6)}) AS BIGINT)) OVER w AS DOUBLE) / {D(1e6)} / count(*) OVER w AS prior_mean,
         {rnd('stddev_samp(avg_sentiment) OVER w', 9)} AS prior_std
  FROM minutes
  WINDOW w AS (PARTITION BY subreddit ORDER BY epoch(minute) RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING))
  WHERE prior_std > 0)
WHERE z_score > {D(2.5)}""", "minutes"))

# ---------------------------------------------------------------------------------------------
# Quality checks, metric log, distribution, freshness
# ---------------------------------------------------------------------------------------------


def mins_between(later: str, earlier: str) -> str:
    return f"(CAST(epoch_us({later}) - epoch_us({earlier}) AS DOUBLE) / {D(60000000.0)})"


def checks_run(tag: str, h: int) -> str:
    at = at_expr(h)
    cte(f"rows_{tag}", ["landing", "as_of"], f"SELECT * FROM landing WHERE ingested_at <= {at}")
    m = mins_between(at, "max(created_utc)")
    fresh = f"""
SELECT {at} AS check_timestamp, 'data_freshness' AS check_name, CASE WHEN n_stale = 0 THEN 'PASSED' ELSE 'FAILED' END AS status,
       CAST(n_stale AS DOUBLE) AS metric_value, {D(10.0)} AS threshold_value,
       to_json({{'stale_subreddits': stale, 'threshold_minutes': 10, 'total_subreddits_checked': checked}}) AS details,
       CAST(NULL AS VARCHAR) AS error_message
FROM (SELECT coalesce(list({{'subreddit': subreddit, 'minutes_ago': {rnd('minutes_ago', 2)}}} ORDER BY subreddit, minutes_ago)
                      FILTER (WHERE minutes_ago > 10), []) AS stale,
             count_if(minutes_ago > 10) AS n_stale, count(*) AS checked
      FROM (SELECT subreddit, {m} AS minutes_ago FROM rows_{tag} GROUP BY subreddit))"""
    dups = f"""
SELECT {at}, 'duplicate_detection', CASE WHEN dups = 0 THEN 'PASSED' ELSE 'WARNING' END, CAST(dups AS DOUBLE), {D(0.0)},
       to_json({{'duplicate_count': dups, 'duplicate_ids': ids}}), CAST(NULL AS VARCHAR)
FROM (SELECT count(*) AS dups, coalesce((SELECT list(id ORDER BY id) FROM (SELECT id FROM rows_{tag} GROUP BY id HAVING count(*) > 1
                                        ORDER BY id LIMIT 10)), []::VARCHAR[]) AS ids
      FROM (SELECT id FROM rows_{tag} GROUP BY id HAVING count(*) > 1))"""
    nulls = ", ".join(
        f"count_if({f} IS NULL) AS {f}" if f == "created_utc" else f"count_if({f} IS NULL OR {f} = '') AS {f}"
        for f in ["id", "title", "author", "subreddit", "created_utc"])
    total = "(id + title + author + subreddit + created_utc)"
    schema = f"""
SELECT {at}, 'schema_validation', CASE WHEN {total} = 0 THEN 'PASSED' ELSE 'FAILED' END, CAST({total} AS DOUBLE), {D(0.0)},
       to_json({{'null_counts': {{'id': id, 'title': title, 'author': author, 'subreddit': subreddit, 'created_utc': created_utc}},
                'total_null_violations': {total}}}), CAST(NULL AS VARCHAR)
FROM (SELECT {nulls} FROM rows_{tag})"""
    ratio = f"(unique_subreddits / {D(6.0)})"
    comp = f"""
SELECT {at}, 'completeness', CASE WHEN {ratio} >= 0.8 THEN 'PASSED' ELSE 'WARNING' END, {ratio}, {D(0.8)},
       to_json({{'total_posts': total_posts, 'unique_subreddits': unique_subreddits, 'expected_subreddits': 6,
                'completeness_ratio': {rnd(ratio, 2)}, 'time_window_hours': 24}}), CAST(NULL AS VARCHAR)
FROM (SELECT count(*) AS total_posts, count(DISTINCT subreddit) AS unique_subreddits FROM rows_{tag}
      WHERE created_utc >= {at} - INTERVAL 24 HOUR)"""
    cte(f"checks_{tag}", [f"rows_{tag}", "as_of"], "\nUNION ALL\n".join([fresh, dups, schema, comp]))
    return f"checks_{tag}"


for _h in (48, 24, 0):
    checks_run(f"q{_h}", _h)
cte("dq_log", ["checks_q48", "checks_q24", "checks_q0", "as_of"], f"""
SELECT {at_expr(72)} AS check_timestamp, 'schema_initialization' AS check_name, 'PASSED' AS status,
       CAST(NULL AS DOUBLE) AS metric_value, CAST(NULL AS DOUBLE) AS threshold_value,
       '{{"message":"Database schema created successfully"}}' AS details, CAST(NULL AS VARCHAR) AS error_message
UNION ALL SELECT * FROM checks_q48 UNION ALL SELECT * FROM checks_q24 UNION ALL SELECT * FROM checks_q0""")
for _k, _n in [("dq_freshness", "data_freshness"), ("dq_duplicates", "duplicate_detection"), ("dq_schema", "schema_validation"),
               ("dq_completeness", "completeness")]:
    register(_k, sql(f"SELECT * FROM checks_q0 WHERE check_name = '{_n}'", "checks_q0"))
register("dq_overall", sql("""
SELECT check_timestamp, bool_and(status = 'PASSED') AS overall_passed, count_if(status <> 'PASSED') AS not_passed
FROM checks_q0 GROUP BY check_timestamp""", "checks_q0"))
register("dq_metrics_log", sql("SELECT * FROM dq_log", "dq_log"))
register("dq_weekly_summary", sql(f"""
SELECT check_name, status, count(*) AS check_count, {rnd('avg(metric_value)', 6)} AS avg_metric, max(check_timestamp) AS last_check
FROM dq_log WHERE check_timestamp >= {AS_OF} - INTERVAL 7 DAY GROUP BY check_name, status""", "dq_log"))
register("dq_latest", sql("""
SELECT check_name, arg_max(check_timestamp, check_timestamp) AS check_timestamp, arg_max(status, check_timestamp) AS status,
       arg_max(metric_value, check_timestamp) AS metric_value, arg_max(threshold_value, check_timestamp) AS threshold_value,
       arg_max(details, check_timestamp) AS details, arg_max(error_message, check_timestamp) AS error_message
FROM dq_log GROUP BY check_name""", "dq_log"))
register("data_freshness", sql(f"""
SELECT subreddit, max(created_utc) AS last_post_time, {mins_between(AS_OF, 'max(created_utc)')} AS minutes_ago,
       {mins_between(AS_OF, 'max(created_utc)')} > 10 AS is_stale
FROM posts GROUP BY subreddit""", "posts", "as_of"))
register("sentiment_distribution", sql(f"""
SELECT sentiment_category, count, {rnd('count * ' + D(100.0) + ' / sum(count) OVER ()', 2)} AS percentage
FROM (SELECT CASE WHEN avg_sentiment > 0.1 THEN 'positive' WHEN avg_sentiment < -0.1 THEN 'negative' ELSE 'neutral' END
             AS sentiment_category, count(*) AS count
      FROM minutes WHERE minute BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF} GROUP BY 1)""", "minutes", "as_of"))
register("sentiment_baseline", sql("SELECT subreddit, mean AS mean_sentiment, std AS std_sentiment, sample_size FROM sent_stats",
                                   "sent_stats"))
register("volume_baseline", sql(f"""
SELECT subreddit, sum(posts_count) / count(*) AS avg_volume, {rnd('stddev_samp(posts_count)', 9)} AS std_volume,
       max(posts_count) AS max_volume, min(posts_count) AS min_volume FROM minutes GROUP BY subreddit""", "minutes"))
register("sentiment_run_summary", sql(f"""
SELECT *, {rnd('positive * ' + D(100.0) + ' / greatest(total, 1)', 1)} AS positive_pct,
          {rnd('negative * ' + D(100.0) + ' / greatest(total, 1)', 1)} AS negative_pct,
          {rnd('neutral * ' + D(100.0) + ' / greatest(total, 1)', 1)} AS neutral_pct,
          {rnd('entities_extracted * ' + D(100.0) + ' / greatest(total, 1)', 1)} AS entities_pct
FROM (SELECT count(*) AS total, count_if(category = 'positive') AS positive, count_if(category = 'negative') AS negative,
             count_if(category = 'neutral') AS neutral, count_if(primary_product IS NOT NULL) AS entities_extracted FROM scored_c)""",
                                      "scored_c"))

# ---------------------------------------------------------------------------------------------
# Daily metrics
# ---------------------------------------------------------------------------------------------
cte("dposts", ["scored_c", "minutes"], """
SELECT p.*, m.avg_sentiment AS bucket_sentiment, CAST(p.ingested_at AS DATE) AS date
FROM scored_c p LEFT JOIN minutes m ON p.subreddit = m.subreddit AND p.minute = m.minute""")
cte("peak", ["dposts"], f"""
SELECT date, subreddit, peak_hour, total_posts, avg_sentiment, sentiment_std_dev, avg_comments_per_post, avg_score FROM (
  SELECT date, subreddit, hour(created_utc) AS peak_hour, count(*) AS total_posts,
         {UNITS6.format(c='bucket_sentiment')} AS avg_sentiment,
         {rnd('stddev_samp(bucket_sentiment)', 9)} AS sentiment_std_dev,
         sum(num_comments) / count(num_comments) AS avg_comments_per_post, sum(score) / count(score) AS avg_score,
         row_number() OVER (PARTITION BY date, subreddit ORDER BY count(*) DESC, hour(created_utc)) AS r
  FROM dposts GROUP BY date, subreddit, hour(created_utc))
WHERE r = 1""")
cte("dtop", ["dposts"], """
SELECT date, subreddit, to_json(list({'id': id, 'title': title, 'score': score, 'num_comments': num_comments} ORDER BY r)) AS top_posts
FROM (SELECT *, row_number() OVER (PARTITION BY date, subreddit ORDER BY score DESC, id) AS r FROM dposts) WHERE r <= 5
GROUP BY date, subreddit""")
cte("daily_tbl", ["peak", "dtop"], f"""
SELECT p.date, p.subreddit, p.total_posts, p.avg_sentiment, p.sentiment_std_dev, t.top_posts, p.avg_comments_per_post,
       p.avg_score, p.peak_hour, {D(0.95)} AS quality_score
FROM peak p LEFT JOIN dtop t ON p.date = t.date AND p.subreddit = t.subreddit""")
register("daily_peak_hour", sql("SELECT * FROM peak", "peak"))
register("daily_top_posts", sql("SELECT * FROM dtop", "dtop"))
register("daily_metrics_full", sql("SELECT * FROM daily_tbl", "daily_tbl"))
register("daily_metrics", sql(f"""
SELECT CAST(ingested_at AS DATE) AS date, subreddit, count(*) AS total_posts,
       CAST(sum(CAST(round(compound * {D(1e4)}) AS BIGINT)) AS DOUBLE) / {D(1e4)} / count(*) AS avg_sentiment,
       {rnd('stddev_samp(compound)', 9)} AS sentiment_std_dev,
       sum(num_comments) / count(num_comments) AS avg_comments_per_post, sum(score) / count(score) AS avg_score,
       count_if(category = 'positive') AS positive_count, count_if(category = 'negative') AS negative_count
FROM scored_c GROUP BY 1, 2""", "scored_c"))
register("distinct_communities", sql("SELECT DISTINCT subreddit FROM posts", "posts"))

# K5: old table from batch-1 data, new rows for dates >= the cut date from all data
cte("scored_b1", ["scored_c", "as_of"], f"SELECT * FROM scored_c WHERE ingested_at < {AS_OF} - INTERVAL 24 HOUR")
cte("minutes_b1", ["scored_b1"], f"""
SELECT minute, subreddit, CAST(sum(CAST(round(compound * {D(1e4)}) AS BIGINT)) AS DOUBLE) / {D(1e4)} / count(*) AS avg_sentiment
FROM scored_b1 GROUP BY minute, subreddit""")
cte("dposts_b1", ["scored_b1", "minutes_b1"], """
SELECT p.*, m.avg_sentiment AS bucket_sentiment, CAST(p.ingested_at AS DATE) AS date
FROM scored_b1 p LEFT JOIN minutes_b1 m ON p.subreddit = m.subreddit AND p.minute = m.minute""")
cte("daily_b1", ["dposts_b1"], f"""
SELECT p.date, p.subreddit, p.total_posts, p.avg_sentiment, p.sentiment_std_dev, t.top_posts, p.avg_comments_per_post,
       p.avg_score, p.peak_hour, {D(0.95)} AS quality_score FROM (
  SELECT * FROM (
    SELECT date, subreddit, hour(created_utc) AS peak_hour, count(*) AS total_posts,
           {UNITS6.format(c='bucket_sentiment')} AS avg_sentiment, {rnd('stddev_samp(bucket_sentiment)', 9)} AS sentiment_std_dev,
           sum(num_comments) / count(num_comments) AS avg_comments_per_post, sum(score) / count(score) AS avg_score,
           row_number() OVER (PARTITION BY date, subreddit ORDER BY count(*) DESC, hour(created_utc)) AS r
    FROM dposts_b1 GROUP BY date, subreddit, hour(created_utc)) WHERE r = 1) p
LEFT JOIN (SELECT date, subreddit,
                  to_json(list({{'id': id, 'title': title, 'score': score, 'num_comments': num_comments}} ORDER BY r)) AS top_posts
           FROM (SELECT *, row_number() OVER (PARTITION BY date, subreddit ORDER BY score DESC, id) AS r FROM dposts_b1)
           WHERE r <= 5 GROUP BY date, subreddit) t ON p.date = t.date AND p.subreddit = t.subreddit""")
cte("daily_new", ["daily_tbl", "as_of"], f"SELECT * FROM daily_tbl WHERE date >= CAST({AS_OF} - INTERVAL 24 HOUR AS DATE)")
register("upsert_replace", sql("""
SELECT * FROM daily_new UNION ALL
SELECT o.* FROM daily_b1 o WHERE NOT EXISTS (SELECT 1 FROM daily_new n WHERE n.date = o.date AND n.subreddit = o.subreddit)""",
                               "daily_new", "daily_b1"))

from . import oracle_serving  # noqa: E402,F401

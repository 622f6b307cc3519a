"""DuckDB SQL equal in meaning to each Spark plan, for the oracle check.

Written independently of the Spark code, as named CTE fragments with dependencies; a query
is ``sql(select, *needed_ctes)``. Literals are cast to DOUBLE because DuckDB types ``0.95`` as
DECIMAL, and rounding uses ``round(x * 10^k) / 10^k`` like the engine's ``rnd``.
"""

from __future__ import annotations

from ..functions import text as tx
from ..sources import fixtures as fx


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def D(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def rnd(expr: str, k: int) -> str:
    return f"(round(({expr}) * {D(10.0 ** k)}) / {D(10.0 ** k)} + {D(0.0)})"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def str_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


PHRASES = str_list(fx.PHRASES)
TS_TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"

CTES: dict[str, tuple[list[str], str]] = {}
#: Steps of an iteration: each is computed once, however often the next ones read it.
COMPUTED_ONCE: set[str] = set()


def cte(name: str, deps: list[str], body: str, once: bool = False) -> None:
    CTES[name] = (deps, body)
    if once:
        COMPUTED_ONCE.add(name)


def sql(select: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in COMPUTED_ONCE else ''}(\n{CTES[n][1]}\n)" for n in order) + "\n" + select


# ---------------------------------------------------------------------------------------------
# Adapter: landing log and clean posts (FIXTURES §4)
# ---------------------------------------------------------------------------------------------
cte("_base", [], f"""
SELECT doc_id * 2 AS msg_offset, doc_id, concat('p', doc_id) AS id,
  CASE WHEN doc_id % 41 = 0 THEN '' ELSE {PHRASES}[CAST(CASE WHEN doc_id % 61 < 13 THEN doc_id % 61 ELSE 9 END AS INTEGER) + 1] END AS title,
  text AS selftext,
  CASE WHEN doc_id % 37 = 0 THEN NULL ELSE concat('u', user_id) END AS author,
  concat('c', doc_id % 7) AS subreddit,
  date_trunc('hour', ts) + to_minutes(CAST(CASE WHEN hour(ts) % 8 = 0 THEN 0 ELSE event_id % 10 END AS INTEGER))
    + to_seconds(CAST(event_id % 60 AS INTEGER)) AS created_utc,
  CAST(floor(value) AS INTEGER) AS score,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS num_comments,
  concat('https://example.com/p/', doc_id) AS url,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('https://www.reddit.com/', _path)
       WHEN 3 THEN concat('/', _path) ELSE _path END AS permalink,
  CAST(event_id % 101 AS DOUBLE) / {D(100)} AS upvote_ratio,
  event_id % 2 = 0 AS is_self,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS link_flair_text,
  event_id AS _e
FROM (SELECT e.event_id AS doc_id, d.text, e.event_id, e.ts, e.user_id, e.event_type, e.value, e.props,
             concat('r/c', e.event_id % 7, '/comments/p', e.event_id, '/') AS _path
      FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id)""")

_MSG = "id, title, selftext, author, subreddit, created_utc, score, num_comments, url, permalink, upvote_ratio, is_self, link_flair_text"
cte("landing", ["_base"], f"""
SELECT msg_offset, {_MSG}, created_utc + to_minutes(CAST(_e % 180 AS INTEGER)) AS ingested_at FROM _base
UNION ALL
SELECT msg_offset + 1, id, title, selftext, author, subreddit, created_utc, score + 5, num_comments + 2, url, permalink,
       upvote_ratio, is_self, link_flair_text, created_utc + to_minutes(CAST(_e % 180 AS INTEGER)) + INTERVAL 45 MINUTE
FROM _base WHERE doc_id % 10 = 0""")

PERMALINK = """CASE WHEN {p} IS NULL OR {p} = '' THEN ''
     WHEN starts_with({p}, 'http://') OR starts_with({p}, 'https://') THEN {p}
     WHEN starts_with({p}, '/') THEN concat('https://reddit.com', {p})
     ELSE concat('https://reddit.com/', {p}) END"""

cte("posts", ["landing"], f"""
SELECT msg_offset, id, title, selftext, author, subreddit, created_utc, score, num_comments, url,
       {PERMALINK.format(p='permalink')} AS permalink,
       upvote_ratio, is_self, link_flair_text, ingested_at, date_trunc('minute', created_utc) AS minute
FROM landing
WHERE id IS NOT NULL AND title IS NOT NULL AND author IS NOT NULL AND created_utc IS NOT NULL AND subreddit IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at, msg_offset) = 1""")

cte("as_of", ["posts"], "SELECT date_trunc('hour', max(created_utc)) + INTERVAL 1 HOUR AS as_of FROM posts")
AS_OF = "(SELECT as_of FROM as_of)"

# ---------------------------------------------------------------------------------------------
# Scoring, entities, rollup
# ---------------------------------------------------------------------------------------------
cte("lexicon", [], "SELECT * FROM (VALUES " + ", ".join(f"({q(t)}, {D(v)})" for t, v in fx.LEXICON) + ") AS l(token, valence)")


def _caps(w: str) -> str:
    return f"(c.mixed AND {w} = upper({w}) AND {w} <> lower({w}))"


def _boost(p: str) -> str:
    step = (f"CASE WHEN lower({p}) IN {in_list(fx.BOOSTERS_UP)} THEN {D(fx.BOOSTER_INCR)} "
            f"WHEN lower({p}) IN {in_list(fx.BOOSTERS_DOWN)} THEN {D(-fx.BOOSTER_INCR)} END")
    return f"coalesce({step} + CASE WHEN {_caps(p)} THEN {D(fx.CAPS_INCR)} ELSE {D(0.0)} END, {D(0.0)})"


_NEG = in_list(fx.NEGATORS)
_SIGN = f"(CASE WHEN l.valence < 0 THEN {D(-1)} ELSE {D(1)} END)"
_V1 = f"(l.valence + {_SIGN} * (CASE WHEN {_caps('c.tok')} THEN {D(fx.CAPS_INCR)} ELSE {D(0.0)} END) + {_SIGN} * ({_boost('c.p1')} + {_boost('c.p2')} * {D(0.95)} + {_boost('c.p3')} * {D(0.9)}))"
_V2 = f"(CASE WHEN coalesce(lower(c.p1) IN {_NEG} OR lower(c.p2) IN {_NEG} OR lower(c.p3) IN {_NEG}, false) THEN {_V1} * {D(fx.NEGATION_SCALAR)} ELSE {_V1} END)"
_V3 = (f"(CASE WHEN c.bp > 0 AND c.pos < c.bp THEN {_V2} * {D(fx.CONTRAST_BEFORE)} "
       f"WHEN c.bp > 0 AND c.pos > c.bp THEN {_V2} * {D(fx.CONTRAST_AFTER)} ELSE {_V2} END)")

COMBINED = "concat(title, ' ', coalesce(selftext, ''))"


def lower(e: str) -> str:
    return f"translate({e}, {q(tx.ASCII_UPPER)}, {q(tx.ASCII_LOWER)})"

cte("_words", ["posts"], f"""
SELECT id, length({COMBINED}) - length(replace({COMBINED}, '!', '')) AS bang,
       regexp_extract_all({COMBINED}, '[\\p{{L}}\\p{{N}}_]+(?:''\\p{{L}}+)?') AS words
FROM posts""")
cte("_tok", ["_words"], """
SELECT id, bang, list_filter(words, lambda t: length(t) >= 2) AS toks, n_caps > 0 AND n_caps < len(words) AS mixed
FROM (SELECT *, len(list_filter(words, lambda t: t = upper(t) AND t <> lower(t))) AS n_caps FROM _words)""")
cte("_ctx", ["_tok"], """
SELECT id, mixed, pos, toks[pos] AS tok,
       CASE WHEN pos > 1 THEN toks[pos - 1] END AS p1,
       CASE WHEN pos > 2 THEN toks[pos - 2] END AS p2,
       CASE WHEN pos > 3 THEN toks[pos - 3] END AS p3,
       coalesce(list_position(list_transform(toks, lambda t: lower(t)), 'but'), 0) AS bp
FROM (SELECT id, mixed, toks, unnest(generate_series(1, len(toks))) AS pos FROM _tok)""")
cte("_hits", ["_ctx", "lexicon"], f"""
SELECT c.id, sum(CAST(round({_V3} * {D(1e6)}) AS BIGINT)) AS s
FROM _ctx c JOIN lexicon l ON lower(c.tok) = l.token GROUP BY c.id""")

_S = f"(CAST(coalesce(h.s, 0) AS DOUBLE) / {D(1e6)})"
_EP = f"(least(t.bang, 4) * {D(fx.EXCLAMATION_STEP)})"
_S2 = f"(CASE WHEN {_S} > 0 THEN {_S} + {_EP} WHEN {_S} < 0 THEN {_S} - {_EP} ELSE {_S} END)"
_C = f"({_S2} / sqrt({_S2} * {_S2} + {D(fx.NORMALIZE_ALPHA)}))"
COMPOUND = rnd(f"greatest({D(-1)}, least({D(1)}, {_C}))", 4)


def _family(fam: str) -> str:
    items = [f"CASE WHEN regexp_matches({lower(COMBINED)}, {q(pat)}) THEN {q(label)} END"
             for f, label, _, pat in fx.taxonomy_rows() if f == fam]
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


cte("scored", ["posts", "_tok", "_hits"], f"""
SELECT p.id, p.subreddit, p.created_utc, p.minute, p.title, p.author, p.score, p.num_comments, p.permalink, p.url,
       p.ingested_at, e.vehicles, e.energy_products, e.issues,
       coalesce(e.energy_products[1], e.vehicles[1]) AS primary_product,
       {COMPOUND} AS compound
FROM posts p JOIN _tok t ON p.id = t.id LEFT JOIN _hits h ON p.id = h.id
JOIN (SELECT id, {_family('vehicles')} AS vehicles, {_family('energy_products')} AS energy_products,
             {_family('issues')} AS issues FROM posts) e ON p.id = e.id""")

cte("scored_c", ["scored"], """
SELECT *, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS category
FROM scored""")

cte("minutes", ["scored_c"], f"""
SELECT minute, subreddit, count(*) AS posts_count,
       CAST(sum(CAST(round(compound * {D(1e4)}) AS BIGINT)) AS DOUBLE) / {D(1e4)} / count(*) AS avg_sentiment,
       CAST(count_if(category = 'positive') AS BIGINT) AS positive_count,
       CAST(count_if(category = 'negative') AS BIGINT) AS negative_count,
       CAST(count_if(category = 'neutral') AS BIGINT) AS neutral_count
FROM scored_c GROUP BY minute, subreddit""")

cte("sent_stats", ["minutes"], f"""
SELECT subreddit,
       CAST(sum(CAST(round(avg_sentiment * {D(1e6)}) AS BIGINT)) AS DOUBLE) / {D(1e6)} / count(*) AS mean,
       {rnd('stddev_samp(avg_sentiment)', 9)} AS std,
       count(*) AS sample_size, max(avg_sentiment) AS max_value, min(avg_sentiment) AS min_value
FROM minutes GROUP BY subreddit""")


def alert_id(alert_type: str, community: str, key: str) -> str:
    return f"left(sha256(concat_ws('|', {alert_type}, coalesce({community}, ''), {key})), 16)"


# C1 (current run) ------------------------------------------------------------------------------
cte("sent_cand", ["minutes", "sent_stats"], f"""
SELECT m.*, s.mean, s.std, {rnd('abs(m.avg_sentiment - s.mean) / s.std', 6)} AS z_score
FROM minutes m JOIN sent_stats s ON m.subreddit = s.subreddit
WHERE s.std > 0 AND {rnd('abs(m.avg_sentiment - s.mean) / s.std', 6)} > {D(2.0)}""")
cte("sent_top", ["sent_cand"], """
SELECT *, row_number() OVER (ORDER BY z_score DESC, subreddit, minute) AS rank
FROM sent_cand ORDER BY z_score DESC, subreddit, minute LIMIT 10""")
cte("sent_posts", ["sent_top", "posts"], """
SELECT subreddit, minute,
       list(id ORDER BY rn) AS post_ids, list(substring(title, 1, 100) ORDER BY rn) AS post_titles,
       list(permalink ORDER BY rn) AS post_links
FROM (SELECT p.subreddit, p.minute, p.id, p.title, p.permalink,
             row_number() OVER (PARTITION BY p.subreddit, p.minute ORDER BY p.created_utc DESC, p.id DESC) AS rn
      FROM posts p JOIN sent_top t ON p.subreddit = t.subreddit AND p.minute = t.minute)
WHERE rn <= 5 GROUP BY subreddit, minute""")
cte("alerts_sentiment", ["sent_top", "sent_posts", "as_of"], f"""
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
       {AS_OF} AS detected_at, 1 AS detector, t.rank
FROM sent_top t LEFT JOIN sent_posts sp ON t.subreddit = sp.subreddit AND t.minute = sp.minute""")

ORACLE: dict[str, str] = {}


def register(key: str, text: str) -> None:
    ORACLE[key] = text


from . import oracle_more  # noqa: E402,F401  (registers the remaining CTEs and queries)

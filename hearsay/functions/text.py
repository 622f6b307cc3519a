"""Scalar text and time expressions (P1-P13, P25-P29). All return JVM-side Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens for scoring: runs of letters and digits of any script, an optional apostrophe suffix (isn't, won't). Nothing that
# follows a run can need a part of it, so runs are possessive: no way back is kept for each character.
SCORE_TOKEN_PATTERN = r"[\p{L}\p{N}_]++(?:'\p{L}++)?"
# Tokens for TF-IDF: two or more letters or digits of any script.
TERM_TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}+"

REDDIT_HOST = "https://reddit.com"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: str | Column) -> Column:
    """Case-fold A-Z only. Patterns and token classes are ASCII, so this decides every match
    exactly like a full Unicode ``lower`` (bar letters whose lower case is ASCII, such as the
    Kelvin sign) at a fraction of the cost, and other engines can repeat it exactly."""
    return F.translate(col(c), ASCII_UPPER, ASCII_LOWER)


def rnd(c: str | Column, k: int) -> Column:
    """Round to ``k`` places as round(x * 10^k) / 10^k.

    Spark's ``round(x, k)`` rounds the decimal text of x; other engines scale in binary. The
    integer round of the scaled value agrees everywhere, so published doubles use this form.
    """
    scale = float(10 ** k)
    # "+ 0.0" turns a rounded -0.0 into 0.0 (engines differ on the sign of a zero result)
    return F.round(col(c) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def build_permalink(c: str | Column) -> Column:
    """P1: '' for null/empty, absolute URLs unchanged, '/x' → host + '/x', else host + '/' + x."""
    p = col(c)
    return (
        F.when(p.isNull() | (p == ""), F.lit(""))
        .when(p.startswith("http://") | p.startswith("https://"), p)
        .when(p.startswith("/"), F.concat(F.lit(REDDIT_HOST), p))
        .otherwise(F.concat(F.lit(REDDIT_HOST + "/"), p))
    )


def epoch_to_ts(c: str | Column) -> Column:
    """Epoch seconds → TIMESTAMP_NTZ in UTC (the reference used the host's zone)."""
    return F.timestamp_seconds(col(c)).cast("timestamp_ntz")


def iso_to_ts(c: str | Column) -> Column:
    """ISO-8601 text → TIMESTAMP_NTZ; malformed text gives NULL instead of failing the batch."""
    return F.try_to_timestamp(col(c)).cast("timestamp_ntz")


def combine_for_scoring(title: str | Column = "title", selftext: str | Column = "selftext") -> Column:
    """Title + ' ' + (selftext or '') — keeps the trailing space when selftext is empty."""
    return F.concat(col(title), F.lit(" "), F.coalesce(col(selftext), F.lit("")))


def combine_for_topics(title: str | Column = "title", selftext: str | Column = "selftext") -> Column:
    """Append selftext only when it is non-empty."""
    s = col(selftext)
    return F.when(s.isNotNull() & (F.length(s) > 0), F.concat(col(title), F.lit(" "), s)).otherwise(col(title))


def minute_bucket(c: str | Column) -> Column:
    """P25: truncate to the minute, kept as TIMESTAMP_NTZ."""
    return F.date_trunc("minute", col(c)).cast("timestamp_ntz")


def hour_bucket(c: str | Column) -> Column:
    return F.date_trunc("hour", col(c)).cast("timestamp_ntz")


def minutes_between(later: Column, earlier: Column) -> Column:
    """EXTRACT(EPOCH FROM later - earlier) / 60 as a double."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(60_000_000.0)


def sentiment_category(c: str | Column, pos: float = 0.05, neg: float = -0.05) -> Column:
    """P10: inclusive thresholds; blank text scores 0.0 and lands in neutral."""
    s = col(c)
    return F.when(s >= pos, "positive").when(s <= neg, "negative").otherwise("neutral")


def sentiment_label(c: str | Column, hi: float, lo: float, labels=("positive", "negative", "neutral"),
                    strict: bool = True) -> Column:
    """Parametrised three-way label. ``strict`` uses > / <, else >= / <=."""
    s = col(c)
    up = s > hi if strict else s >= hi
    down = s < lo if strict else s <= lo
    return F.when(up, labels[0]).when(down, labels[1]).otherwise(labels[2])


def severity_rank(c: str | Column) -> Column:
    """CRITICAL 1, HIGH 2, MEDIUM 3, LOW 4."""
    s = col(c)
    return F.when(s == "CRITICAL", 1).when(s == "HIGH", 2).when(s == "MEDIUM", 3).when(s == "LOW", 4)


def score_tokens(text: str | Column) -> Column:
    """The words of a text as they are written."""
    return F.regexp_extract_all(col(text), F.lit(SCORE_TOKEN_PATTERN), 0)


def is_caps(word: Column) -> Column:
    """Written in capitals: it has a letter with case, and none is lower-case."""
    return (word == F.upper(word)) & (word != F.lower(word))


def term_tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TERM_TOKEN_PATTERN), 0)


def count_char(text: str | Column, ch: str) -> Column:
    t = col(text)
    return F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))

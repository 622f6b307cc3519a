"""Exact pruning of bigrams, keyword hits and the burst rule."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hearsay.operators import topics as tp

POST = "id string, subreddit string, title string, selftext string, created_utc timestamp_ntz"


@pytest.fixture(scope="module")
def tokens(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(120)]
    weight = [1 / (k + 1) for k in range(120)]
    rows = []
    for i in range(150):
        own = rng.choices(words, weight, k=rng.randint(0, 40)) + [f"once{i}{j}" for j in range(rng.randint(0, 30))]
        rng.shuffle(own)
        rows.append((f"p{i}", "ab"[i % 2], own))
    return spark.createDataFrame(rows, "id string, subreddit string, toks array<string>").repartition(3)


def brute(tokens, group, k, min_df, max_df):
    docs = [(r.subreddit if group else None, r.toks) for r in tokens.collect()]
    df, total, n = collections.Counter(), collections.Counter(), collections.Counter(g for g, _ in docs)
    for g, t in docs:
        terms = t + [f"{a} {b}" for a, b in zip(t, t[1:])]
        total.update((g, x) for x in terms)
        df.update((g, x) for x in set(terms))
    out = set()
    for g in n:
        keep = [x for (h, x), c in df.items() if h == g and c >= min_df and (max_df is None or c <= n[g] * max_df)]
        out |= {(g, x, df[g, x]) for x in sorted(keep, key=lambda x: (-total[g, x], x))[:k]}
    return out


@pytest.mark.parametrize("group,k,min_df,max_df", [("subreddit", 20, 2, 0.8), ("subreddit", 5, 2, 0.3), (None, 30, 2, None), (None, 100000, 1, None), ("subreddit", 60, 3, 0.8)])
def test_pruned_vocabulary_is_the_whole_one(tokens, group, k, min_df, max_df):
    got = tp.vocabulary(tokens, group, k, min_df, max_df)
    assert {(r[group] if group else None, r.term, r.df) for r in got.collect()} == brute(tokens, group, k, min_df, max_df)


def test_pruning_leaves_few_bigrams(tokens):
    words = tp.term_stats(tokens.select("id", F.col("toks").alias("terms")), None)
    pruned = tp.candidate_bigrams(tokens, words, None, 20, 2, None)
    whole = tp.term_stats(tp.term_arrays(tokens, None), None).where(F.col("term").contains(" "))
    assert 0 < pruned.count() < whole.count() / 2


def test_hits_and_bursts(spark):
    day = lambda d: dt.datetime(2024, 1, d, 9)
    rows = []
    for d in range(1, 15):  # "recall" once a day, six times on the 10th; "steady" three times a day
        for j in range(6 if d == 10 else 1):
            rows.append((f"r{d}{j}", "a", "Recall again", None, day(d)))
        rows += [(f"s{d}{j}", "a", "so STEADY", None, day(d)) for j in range(3)]
    rows += [(f"x{j}", "b", "recall elsewhere", None, day(10)) for j in range(9)]  # no history there
    topics = spark.createDataFrame([("a", "recall", 0.5, 1), ("a", "steady", 0.4, 2), ("a", "absent", 0.1, 3), ("b", "recall", 0.2, 1)], "subreddit string, keyword string, score double, rank int")
    posts = spark.createDataFrame(rows, POST)
    hits = tp.keyword_hits(topics, posts)
    assert hits.where("subreddit = 'a' and keyword = 'recall'").count() == 19
    assert [tuple(r) for r in tp.keyword_bursts(hits).collect()] == [("a", "recall", dt.date(2024, 1, 10), 6, 1.0, 6.0)]
    sentiments = posts.select("id", F.when(F.col("id").startswith("r"), -0.5).otherwise(0.25).alias("sentiment"))
    stats = {(r.subreddit, r.keyword): (r.post_count, r.avg_sentiment) for r in tp.keyword_stats(topics, hits, sentiments).collect()}
    assert stats == {("a", "recall"): (19, -0.5), ("a", "steady"): (42, 0.25), ("a", "absent"): (0, 0.0), ("b", "recall"): (9, 0.25)}

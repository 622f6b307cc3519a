"""Trigger limits with counts per micro-batch, and the streaming detector against one pass over its windows."""

import random

import pytest
from pyspark.sql import functions as F

from hearsay.operators import anomaly as an
from hearsay.operators import store
from hearsay.streaming import ingest as st

from .test_operators import _message

TITLES = ["It is a car"] * 6 + ["Love my Model 3"] + ["Terrible quality, the worst"]


def feed(spark, src, batches):
    """One file a batch, in order."""
    for lines in batches:
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(src)


def at(k, minute, **changed):
    t = f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:10"
    return _message(k, 0, created_utc=t, ingested_at=t, title=TITLES[k % len(TITLES)], subreddit=f"c{k % 2}", **changed)


def test_five_files_and_a_limit_of_one_are_five_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, src, [[at(10 * b + k, b) for k in range(4)] + [at(10 * b, b), at(99, b, author=None), "broken"] for b in range(5)])
    q = st.ingest(st.file_source(spark, src, max_files=1), out, str(tmp_path / "ck"))
    q.awaitTermination()
    counts = st.batch_counts(q)
    assert [c["batch_id"] for c in counts] == list(range(5))
    assert all((c["inserted"], c["duplicates"], c["errors"]) == (4, 1, 2) for c in counts)
    assert spark.read.parquet(out).groupBy("batch_id").count().where("count = 4").count() == 5


@pytest.fixture(scope="module")
def log():
    rng = random.Random(5)
    return [[at(1000 * b + k, 30 * b + rng.randrange(30)) for k in range(rng.randrange(20, 60))] for b in range(5)]


def streamed(spark, root, log, files):
    src, scored = str(root / "in"), str(root / "scored")
    feed(spark, src, log)
    st.ingest(st.file_source(spark, src, max_files=files), scored, str(root / "ck1")).awaitTermination()
    schema = spark.read.parquet(scored).drop("batch_id").schema
    st.detect(spark, scored, schema, str(root / "found"), str(root / "ck2")).awaitTermination()
    return {k: spark.read.parquet(str(root / "found" / k)) for k in ("minutes", "alerts", "moments")}


def plain(df):
    return sorted(tuple(r) for r in df.select("subreddit", "minute", "prior_n", "prior_mean", "prior_std", "z_score", "severity").collect())


def test_alerts_equal_one_pass_however_the_stream_is_cut(spark, tmp_path, log):
    found = [streamed(spark, tmp_path / str(n), log, n) for n in (1, 5)]
    for f in found:
        want = plain(an.expanding_anomalies(f["minutes"].drop("batch_id")))
        assert plain(f["alerts"]) == want and want
    assert plain(found[0]["alerts"]) == plain(found[1]["alerts"])


def test_alerts_appear_while_the_stream_runs(spark, tmp_path, log):
    src, scored, root = (str(tmp_path / x) for x in ("in", "scored", "found"))
    seen = []
    for lines in log:
        feed(spark, src, [lines])
        st.ingest(st.file_source(spark, src, max_files=1), scored, str(tmp_path / "ck1")).awaitTermination()
        schema = spark.read.parquet(scored).drop("batch_id").schema
        st.detect(spark, scored, schema, root, str(tmp_path / "ck2")).awaitTermination()
        seen.append(spark.read.parquet(root + "/minutes").count())
    assert seen == sorted(seen) and seen[0] > 0 and len(set(seen)) == 5
    minutes, alerts = (spark.read.parquet(f"{root}/{k}") for k in ("minutes", "alerts"))
    assert plain(alerts) == plain(an.expanding_anomalies(minutes.drop("batch_id")))
    assert alerts.select("batch_id").distinct().count() > 1
    last = max(int(x.split("=")[1]) for x in store.children(spark, root + "/moments"))
    totals = {r.subreddit: r.n for r in spark.read.parquet(f"{root}/moments/batch_id={last}").collect()}
    assert totals == {r.subreddit: r["count"] for r in minutes.groupBy("subreddit").count().collect()}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rows = [("a", 1, 0.1), ("a", 2, 0.2), ("a", 3, 0.9), ("b", 1, 0.5)]
    windows = spark.createDataFrame(rows, "subreddit string, m int, avg_sentiment double").select(
        "subreddit", F.timestamp_seconds(F.col("m") * 60).cast("timestamp_ntz").alias("minute"), "avg_sentiment")
    fn = st._detect_batch(str(tmp_path / "r"), 2.0)
    fn(windows.where("minute < timestamp'1970-01-01 00:03:00'"), 0)
    for _ in range(2):
        fn(windows.where("minute >= timestamp'1970-01-01 00:03:00'"), 1)
        assert {r.subreddit: r.n for r in spark.read.parquet(str(tmp_path / "r/moments/batch_id=1")).collect()} == {"a": 3, "b": 1}
        assert [r.z_score for r in spark.read.parquet(str(tmp_path / "r/alerts")).collect()] == [round(0.75 / 0.070710678, 6)]


def test_merging_moments_is_order_free(spark):
    rows = [("a", float(k) / 10) for k in range(-9, 10)]
    df = spark.createDataFrame(rows, "subreddit string, avg_sentiment double")
    parts = [st._moments(df.where((F.col("avg_sentiment") * 10).cast("int") % 3 == k)) for k in (0, 1, 2, -1, -2)]
    whole = st._moments(df).first()
    for order in ([0, 1, 2, 3, 4], [4, 2, 0, 3, 1]):
        u = parts[order[0]]
        for k in order[1:]:
            u = u.unionByName(parts[k])
        assert tuple(st.merge_moments(u).first()) == tuple(whole)

"""The incremental rollup: any split of the log equals one pass, late posts, replays, failures, compaction."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hearsay.operators import incremental as inc
from hearsay.operators import rollup as ru
from hearsay.operators import sinks as sk
from hearsay.operators import store
from hearsay.sources import adapter, tables

T0 = dt.datetime(2024, 1, 5, 12, 0)
LOG = ("msg_offset long, id string, title string, selftext string, author string, subreddit string, created_utc timestamp_ntz, score int, "
       "num_comments int, url string, permalink string, upvote_ratio double, is_self boolean, link_flair_text string, ingested_at timestamp_ntz")


def message(offset, post, minute, title="I love it", author="u"):
    t = T0 + dt.timedelta(minutes=minute)
    return (offset, post, title, None, author, "ab"[minute % 2], t, 1, 0, "", "", 0.5, True, None, T0 + dt.timedelta(hours=1, seconds=offset))


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = [message(k, f"p{k if k % 5 else k // 2}", rng.randrange(6), rng.choice(["love it", "terrible", "so so"]), None if k % 11 == 0 else "u") for k in range(60)]
    return spark.createDataFrame(rows, LOG)


@pytest.fixture(scope="module")
def lexicon(spark):
    return tables.lexicon_frame(spark)


def one_pass(log, lexicon):
    clean = adapter.shaped(adapter.first_write_wins(log.where(adapter.required_present(log))))
    return sorted(map(tuple, ru.minute_rollup(ru.enrich(clean, lexicon)).collect()))


def advanced(spark, root, log, lexicon, cuts):
    x = inc.IncrementalRollup(spark, str(root), lexicon)
    for upto in cuts:
        x.advance(log, upto)
    return x


@pytest.mark.parametrize("cuts", [[59], [10, 11, 59], [29, 59]])
def test_any_split_equals_one_pass(spark, tmp_path, log, lexicon, cuts):
    x = advanced(spark, tmp_path / "r", log, lexicon, cuts)
    assert sorted(map(tuple, x.minutes().collect())) == one_pass(log, lexicon)
    assert x.batches().agg(F.sum("inserted"), F.sum(F.col("inserted") + F.col("duplicates") + F.col("errors"))).first()[:] == (x.scored().count(), 60)


def test_replays_failures_and_compaction(spark, tmp_path, log, lexicon):
    root = tmp_path / "r"
    x = advanced(spark, root, log, lexicon, [20, 40])
    assert not x.advance(log, 40) and not x.advance(log, 3)  # nothing new
    store.remove(spark, str(root / "commits" / "batch=000001"))  # the second batch's commit was lost with its driver
    half = inc.IncrementalRollup(spark, str(root), lexicon)
    assert half.position() == (1, 20)
    half.advance(log, 40)
    before = half.partials().count()
    half.compact()
    assert half.partials().count() <= before
    half.advance(log, 59)
    assert sorted(map(tuple, half.minutes().collect())) == one_pass(log, lexicon)
    half.compact(keep=1)
    assert len(half.base.entries()) == 1 and sorted(map(tuple, half.minutes().collect())) == one_pass(log, lexicon)


def test_a_late_post_changes_its_minute_only(spark, tmp_path, lexicon):
    rows = [message(0, "p0", 0), message(1, "p1", 1), message(2, "p2", 3)]
    late = message(3, "p9", 1, "terrible")
    x = advanced(spark, tmp_path / "r", spark.createDataFrame(rows, LOG), lexicon, [2])
    before = {(r.minute, r.subreddit): tuple(r) for r in x.minutes().collect()}
    x.advance(spark.createDataFrame([*rows, late], LOG), 3)
    after = {(r.minute, r.subreddit): tuple(r) for r in x.minutes().collect()}
    changed = {k for k in after if after[k] != before.get(k)}
    assert changed == {(T0 + dt.timedelta(minutes=1), "b")} and after[changed.pop()][2] == 2
    assert spark.read.parquet(str(tmp_path / "r" / "partials" / "batch=1")).count() == 1  # one dirty key written


def test_empty_log(spark, tmp_path, log, lexicon):
    x = advanced(spark, tmp_path / "r", log.limit(0), lexicon, [5])
    assert x.minutes().count() == 0 and x.batches().first().inserted == 0


# ---------------------------------------------------------------------------------------------
def test_overwrite_touches_the_given_days_only(spark, tmp_path):
    root = str(tmp_path / "daily")
    day = lambda d, v: (dt.date(2024, 1, d), "a", v)
    schema = "date date, subreddit string, total_posts int"
    sk.overwrite_days(spark.createDataFrame([day(1, 1), day(2, 2)], schema), root)
    before = {f: (tmp_path / "daily" / "date=2024-01-01" / f).stat().st_mtime_ns for f in store.children(spark, root + "/date=2024-01-01")}
    sk.overwrite_days(spark.createDataFrame([day(2, 20), day(3, 3)], schema), root)
    after = {f: (tmp_path / "daily" / "date=2024-01-01" / f).stat().st_mtime_ns for f in store.children(spark, root + "/date=2024-01-01")}
    assert before == after
    got = sorted((r.date.day, r.total_posts) for r in spark.read.parquet(root).collect())
    assert got == [(1, 1), (2, 20), (3, 3)]

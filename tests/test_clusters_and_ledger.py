"""The cluster chain, the stored ledger and versioned tables on small frames and on the smallest tables."""

import collections
import datetime as dt

import duckdb
from pyspark.sql import functions as F

from hearsay.operators import clusters as cl
from hearsay.operators import ledger as lg
from hearsay.operators import store
from hearsay.operators import topics as tp
from hearsay.plans.context import Run

from .conftest import SMOKE
from .test_operators import CAND_SCHEMA, T0, cand

TITLES = ["battery drains fast", "battery drains again", "screen froze today", "screen froze twice", "paint scratch door", "paint scratch hood"]


def posts(spark, n=60):
    rows = [(f"p{i:03d}", "a" if i % 2 else "b", TITLES[i % len(TITLES)], None) for i in range(n)] + [("p999", "a", "zzz", None)]
    return spark.createDataFrame(rows, "id string, subreddit string, title string, selftext string").repartition(3)


def groups(labels):
    out = collections.defaultdict(set)
    for r in labels.collect():
        out[r.cluster_id].add(r.id)
    return sorted(map(sorted, out.values()))


def test_every_post_is_assigned_and_topics_are_apart(spark):
    p = tp.token_arrays(posts(spark))
    vocab = cl.vocabulary(p)
    vecs = cl.vectors(p, vocab)
    model = cl.fit(vecs, vocab, k=3)
    labels = cl.assign(vecs, model, vocab.count())
    assert labels.count() == labels.select("id").distinct().count() == p.count()
    by_topic = [sorted(f"p{i:03d}" for i in range(60) if TITLES[i % 6].split()[0] == w) for w in ("battery", "screen", "paint")]
    assert groups(labels.where("id < 'p999'")) == sorted(by_topic)  # p999, without a common term, has a cluster too
    words = {r.cluster_id: set(r.keywords) for r in cl.centre_keywords(model).collect()}
    assert all(any(w in ks for ks in words.values()) for w in ("battery", "screen", "paint"))


def test_the_model_is_the_same_for_any_partitioning(spark):
    p = posts(spark)
    models = []
    for n in (1, 7):
        x = tp.token_arrays(p.repartition(n))
        vocab = cl.vocabulary(x)
        models.append(sorted(map(tuple, cl.fit(cl.vectors(x, vocab), vocab).collect()), key=str))
    assert models[0] == models[1]


def test_few_posts_give_few_clusters(spark):
    p = tp.token_arrays(posts(spark).where(F.col("id") < "p004"))
    vocab = cl.vocabulary(p)
    vecs = cl.vectors(p, vocab)
    assert {r.cluster_id for r in cl.fit(vecs, vocab).collect()} == {0, 1}  # max(2, 4 // 10)
    assert cl.fit(vecs.limit(0), vocab).count() == 0
    assert cl.assign(vecs, cl.fit(vecs.limit(0), vocab), 3).count() == 0


def test_ml_model_is_repeatable_and_complete(spark):
    p = tp.token_arrays(posts(spark)).coalesce(1)
    (centres, a), (_, b) = (cl.kmeans_model(p, k=3, seeds=range(42, 44)) for _ in range(2))
    assert groups(a) == groups(b) and a.count() == p.count()
    assert centres.columns == [f.split()[0] for f in cl.CENTRES.split(", ")] and centres.count() > 0


def test_summary_follows_from_the_stored_assignment(spark, tmp_path):
    """The summary against SQL over the stored assignment; sizes add up to the number of posts."""
    r = Run(spark, SMOKE)
    r.labels.coalesce(1).write.parquet(str(tmp_path / "labels"))
    r.sentiments.coalesce(1).write.parquet(str(tmp_path / "sentiments"))
    want = duckdb.connect().execute(f"""
        SELECT cluster_id, count(*), sum(round(sentiment * 1e6)) / 1e6 / count(*), list(id ORDER BY id)[1:10]
        FROM '{tmp_path}/labels/*.parquet' JOIN '{tmp_path}/sentiments/*.parquet' USING (id) GROUP BY cluster_id""").fetchall()
    got = [(c.cluster_id, c.post_count, c.avg_sentiment, c.first_post_ids) for c in r.clusters.collect()]
    key = lambda x: (x[0], x[1], round(x[2], 9), x[3])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert sum(x[1] for x in got) == r.posts.count()


# ---------------------------------------------------------------------------------------------
def at(hours):
    return F.lit((T0 + dt.timedelta(hours=hours)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def candidates(spark, hours, *keys):
    rows = [cand(f"{t}{s}{hours}", t, s, 1, k) for k, (t, s) in enumerate(keys)]
    when = T0 + dt.timedelta(hours=hours)
    return spark.createDataFrame([(*r[:8], when, *r[9:]) for r in rows], CAND_SCHEMA)


def test_ledger_appends_each_run_once(spark, tmp_path):
    ledger = lg.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.state().count() == 0
    first = candidates(spark, 0, ("X", "a"), ("X", "a"), ("Y", None))
    assert ledger.run("r0", lambda: first, at(0))
    assert not ledger.run("r0", lambda: 1 / 0, at(0))  # the detectors don't even run
    assert ledger.events().count() == 2 and ledger.raised("r0").count() == 2
    # six hours on: the open alerts suppress their kind; after 25 hours they are resolved, and new ones raised
    ledger.run("r6", lambda: candidates(spark, 6, ("X", "a"), ("Y", None), ("X", "b")), at(6))
    assert [a.subreddit for a in ledger.raised("r6").collect()] == ["b"]
    ledger.run("r25", lambda: candidates(spark, 25, ("X", "a"), ("X", "b")), at(25))
    state = {(r.alert_id, r.resolved, r.resolved_at) for r in ledger.state().collect()}
    late = T0 + dt.timedelta(hours=25)
    assert state == {("cXa0", True, late), ("cYNone0", True, late), ("cXb6", False, None), ("cXa25", False, None)}


def test_resolving_is_an_event(spark, tmp_path):
    ledger = lg.Ledger(spark, str(tmp_path / "ledger"))
    ledger.run("r0", lambda: candidates(spark, 0, ("X", "a"), ("Y", "b")), at(0))
    copy = ledger.copy(str(tmp_path / "copy"))
    assert copy.resolve("cXa0", at(1), "q1") == 1
    assert copy.resolve("cXa0", at(2), "q1") == 1  # the same request again adds nothing
    assert copy.resolve("nobody", at(1), "q2") == 0
    assert copy.events().count() == ledger.events().count() + 1
    assert {(r.alert_id, r.resolved, r.resolved_at) for r in copy.state().collect()} == {("cXa0", True, T0 + dt.timedelta(hours=1)), ("cYb0", False, None)}
    assert ledger.state().where("resolved").count() == 0


def test_a_run_that_died_is_written_again(spark, tmp_path):
    ledger = lg.Ledger(spark, str(tmp_path / "ledger"))
    ledger.run("r0", lambda: candidates(spark, 0, ("X", "a")), at(0))
    store.remove(spark, str(tmp_path / "ledger" / "run_id=r0" / "_SUCCESS"))  # as if its driver had been lost
    assert ledger.run("r0", lambda: candidates(spark, 0, ("X", "a")), at(0))
    assert ledger.events().count() == 1


# ---------------------------------------------------------------------------------------------
def test_versions(spark, tmp_path):
    table = store.Versions(spark, str(tmp_path / "topics"))
    assert table.current() is None and table.entries() == []
    frame = lambda n: spark.range(n)
    one = table.publish(frame(1), "k1")
    reader = table.read()
    two = table.publish(frame(2), "k2")
    assert reader.count() == 1 and table.read().count() == 2  # a reader opened before the refresh keeps its version
    assert table.current("k1") == one and table.current("k2") == two and table.current("k3") is None
    table.publish(frame(3), "k1")
    assert table.expire(keep=2) == 1 and table.current("k1") != one and table.read(two).count() == 2
    assert not store.exists(spark, one)
    frame(5).write.parquet(str(tmp_path / "topics" / "v=unfinished"))  # written, never published
    assert table.read().count() == 3


def test_stored_builds_once_per_input(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(4)

    spark.range(3).write.parquet(str(tmp_path / "t"))
    key = store.input_version(spark.read.parquet(str(tmp_path / "t")))
    name = f"test-{tmp_path.name}"
    assert store.stored(spark, name, key, build).count() == store.stored(spark, name, key, build).count() == 4 and len(calls) == 1
    spark.range(1).write.mode("append").parquet(str(tmp_path / "t"))
    other = store.input_version(spark.read.parquet(str(tmp_path / "t")))
    assert other != key and store.stored(spark, name, other, build).count() == 4 and len(calls) == 2


def test_severity_uses_the_summary_of_all_posts(spark):
    s = spark.createDataFrame([(0.0, 100), (-1.0, 100), (-0.5, 2), (-0.8, 1)], "a double, n int")
    got = [r[0] for r in s.select(tp.cluster_severity(F.col("a"), F.col("n"))).collect()]
    assert got == ["LOW", "CRITICAL", "MEDIUM", "HIGH"]

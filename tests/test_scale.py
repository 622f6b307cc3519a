"""Plans whose work must grow no faster than their input, and what they return."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearsay.functions import entities as en
from hearsay.functions import scoring as sc
from hearsay.operators import clusters as cl
from hearsay.operators import ledger as lg
from hearsay.operators import topics as tp
from hearsay.plans.context import Run
from hearsay.sources import adapter, tables
from hearsay.sources import fixtures as fx
from hearsay.sources.tables import materialize


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scorer_prepares_a_text_once(spark):
    """Nothing is derived from a text's arrays beside its exploded words, and words aren't moved to the lexicon."""
    rows = [("a", "So very GOOD, love it but bad"), ("b", "not love"), ("c", None), ("d", ""), ("e", "love " + "x1 " * 3000 + "but very bad")]
    df = spark.createDataFrame(rows, "id string, text string")
    out = sc.score(df, tables.lexicon_frame(spark), text=F.col("text"), carry=[])
    plan = _plan(out)
    assert plan.index("array_position") > plan.index("Generate")
    assert plan.count("regexp_extract_all") == 1
    assert "BuildRight" in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["compound"] for r in out.collect()}
    # (3.2 + 0.293 * 1.85) * 0.5 - 2.5 * 1.5; 3.2 * -0.74; 3.2 * 0.5 + (-2.5 - 0.293) * 1.5
    want = {"a": -1.878975, "b": -2.368, "c": 0.0, "d": 0.0, "e": -2.5895}
    assert got == {k: round(s / (s * s + 15) ** 0.5, 4) + 0.0 for k, s in want.items()}


def test_scorer_looks_up_neighbours_of_hits_alone(spark):
    """A word carries a run of bounded size; context reaches over the borders of runs, and contrast over the whole text."""
    fill = lambda n: ["xx"] * n
    rows = [("a", fill(sc.RUN - 1) + ["not", "love"]), ("b", fill(sc.RUN - 1) + ["very", "xx", "xx", "love"]), ("c", ["love", *fill(3 * sc.RUN), "but", "bad"]),
            ("d", fill(sc.RUN) + ["love"]), ("e", fill(sc.RUN - 1) + ["love"]), ("f", fill(sc.RUN - 1) + ["never", "xx", "xx", "xx", "love"]), ("g", ["a", "b"])]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "id string, text string")
    out = sc.score(df, tables.lexicon_frame(spark), text=F.col("text"), carry=[])
    plan = _plan(out)
    assert "arrays_zip" not in plan and plan.count("posexplode") == 1 and "slice(" in plan
    want = {"a": 3.2 * -0.74, "b": 3.2 + 0.293 * 0.9, "c": 3.2 * 0.5 - 2.5 * 1.5, "d": 3.2, "e": 3.2, "f": 3.2, "g": 0.0}
    assert {r["id"]: r["compound"] for r in out.collect()} == {k: round(s / (s * s + 15) ** 0.5, 4) + 0.0 for k, s in want.items()}


def test_tags_are_searched_by_literal(spark):
    """No regex of the tagger begins with a choice, and each label is found where its whole pattern finds it."""
    assert not any(rx.startswith("(") for parts in fx.taxonomy_searches().values() for _, found in parts for rx in found)
    words = ["m3", "my", "mx", "am3", "m3x", "my_", "_my", "model", "3", "model3", "models", "modelsx", "model\ts", "modelx", "modely1", "pw2", "xpw2", "pw3", "solar", "tile", "tiles",
             "roof", "pv", "panel", "apv", "sc", "asc", "v2", "v5", "super", "charger", "recall", "prerecall", "tsb", "tsbs", "fire", "misfire", "burn", "burning", "sunburn",
             "won't", "wont", "charge", "charging", "error", "fsd", "full", "self-driving", "self", "driving", "semi", "semitruck", "service", "center", "bulletin", "range", "loss", "", "é"]
    texts = [(f"{a}{sep}{b}",) for a in words for b in words for sep in (" ", "", "\n", ".")]
    df = spark.createDataFrame(texts, "t string")
    plain = F.array_compact(F.array(*[F.when(F.col("t").rlike(rx), F.lit(label)) for _, label, _, rx in fx.taxonomy_rows()]))
    ent = en.entities(F.col("t"), lowered=True)
    got = df.select("t", plain.alias("want"), F.concat(*[ent[f] for f in fx.FAMILIES]).alias("got"))
    assert got.where(F.col("want") != F.col("got")).collect() == [] and got.where(F.size("want") > 0).count() > 100


def test_bigrams_of_frequent_words_need_no_regrouping(spark):
    """Documents stay where they are: no occurrence is moved, only partial counts are."""
    rows = [(f"p{i}", ["aa", "bb", f"once{i}", "aa", "bb"]) for i in range(20)]
    tokens = spark.createDataFrame(rows, "id string, toks array<string>")
    words = tp.term_stats(tokens.select("id", F.col("toks").alias("terms")), None)
    out = tp.candidate_bigrams(tokens, words, None, 2, 2, None)
    plan = _plan(out)
    assert "collect_list" not in plan and plan.count("Aggregate") == 1
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("aa bb", 20, 40)]


def test_nearest_centres_by_batch(spark):
    """Assignment equals plain distances, with empty vectors and ties, and evaluates no lambda for each entry."""
    vecs = [("a", [0, 2], [9000, 4000]), ("b", [], []), ("c", [1], [10000]), ("d", [0, 1], [5000, 5000]), ("e", [2], [1])]
    centres = [{0: 900000, 2: 100}, {1: 900000, 2: 100}, {2: 5000}]
    df = spark.createDataFrame(vecs, "id string, idx array<int>, w array<bigint>").repartition(2)
    model = spark.createDataFrame([(j, i, f"t{i}", w) for j, c in enumerate(centres) for i, w in c.items()], cl.CENTRES)
    out = cl.assign(df, model, 3)
    assert "lambdafunction" not in _plan(out)

    def far(v, c):
        own = dict(zip(v[1], v[2]))
        return sum((cl.SCALE * own.get(i, 0) - c.get(i, 0)) ** 2 for i in range(3))

    assert {r.id: r.cluster_id for r in out.collect()} == {v[0]: min(range(3), key=lambda j: (far(v, centres[j]), j)) for v in vecs}


def test_ml_model_sees_equal_vectors_once(spark, monkeypatch):
    """K-Means gets one weighted point for each distinct vector; every post is still assigned."""
    rows = [(f"p{i}", ["aa", "bb"] if i % 2 else ["cc", "dd"]) for i in range(40)]
    seen = {}

    def stored(df, name):
        seen[name] = out = materialize(df, name)
        return out

    monkeypatch.setattr(cl, "materialize", stored)
    _, labels = cl.kmeans_model(spark.createDataFrame(rows, "id string, toks array<string>"), k=2, seeds=range(42, 44))
    assert sorted(r.weight for r in seen["distinct-features"].collect()) == [20.0, 20.0]
    assert labels.count() == 40 and labels.groupBy("cluster_id").count().where("count = 20").count() == 2


def test_ml_vectors_need_no_row_of_all_bigrams(spark, monkeypatch):
    """K-Means gets the vectors that ``pyspark.ml`` makes of all words and bigrams, without an array of a text's bigrams."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    rng = random.Random(5)
    words = [w for k in range(30) for w in [f"w{k:02d}"] * (k + 1)]  # some more frequent than others
    tokens = spark.createDataFrame([(f"p{i}", [rng.choice(words) for _ in range(rng.randint(0, 40))]) for i in range(80)], "id string, toks array<string>").coalesce(1)
    terms = tp.term_arrays(tokens, None)
    counter = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=2000, minDF=2.0).fit(terms)
    model = IDF(inputCol="tf", outputCol="idf").fit(counter.transform(terms))
    scaled = ElementwiseProduct(scalingVec=Vectors.dense([x + 1.0 for x in model.idf]), inputCol="tf", outputCol="raw")
    made = Pipeline(stages=[counter, scaled, Normalizer(inputCol="raw", outputCol="features")]).fit(terms).transform(terms)
    names = counter.vocabulary
    want = {r.id: {names[i]: x for i, x in zip(r.features.indices, r.features.values)} for r in made.collect()}
    seen, stored = {}, cl.materialize

    def materialize(df, name, *more):
        seen[name] = stored(df, name, *more)
        return seen[name]

    monkeypatch.setattr(cl, "materialize", materialize)
    monkeypatch.setattr(tp, "term_arrays", lambda *_: pytest.fail("every bigram of every text"))
    centres, labels = cl.kmeans_model(tokens, k=3, seeds=range(42, 44), max_features=2000)
    order = [r.term for r in tp.vocabulary(tokens, None, 2000).collect()]
    assert any(" " in t for t in order) and {r.term for r in centres.collect()} <= set(order)
    for r in seen["features"].collect():
        assert {order[i]: x for i, x in zip(r.features.indices, r.features.values)} == pytest.approx(want[r.id], rel=1e-12)
    assert labels.count() == 80 and labels.select("cluster_id").distinct().count() == 3
    _, alone = cl.kmeans_model(spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", [])], "id string, toks array<string>").coalesce(1), seeds=range(42, 43))
    assert sorted((r.id, r.cluster_id) for r in alone.collect()) == [("a", 0), ("b", 0), ("c", 0)]  # no vocabulary


def test_scorer_is_code_that_java_compiles(spark):
    """Java interprets methods of more than 8000 bytes, and every word would pass through such a one."""
    out = sc.score(spark.createDataFrame([("a", "so very good")], "id string, text string"), tables.lexicon_frame(spark), text=F.col("text"), carry=[])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # only a plan that is fixed has all its code
    try:
        stages = out.select("*")._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) < 8000


def test_first_but_in_any_spelling(spark):
    rows = [("a", "love BUT bad"), ("b", "love bUt bad but love"), ("c", "love butter bad"), ("d", "but")]
    out = sc.score(spark.createDataFrame(rows, "id string, text string"), tables.lexicon_frame(spark), text=F.col("text"), carry=[]).collect()
    want = {"a": 3.2 * 0.5 - 2.5 * 1.5, "b": 3.2 * 0.5 + (3.2 - 2.5) * 1.5, "c": 3.2 - 2.5, "d": 0.0}
    assert {r["id"]: r["compound"] for r in out} == {k: round(s / (s * s + 15) ** 0.5, 4) + 0.0 for k, s in want.items()}


def test_tags_take_one_pass_a_label(spark):
    """Arrow matches all labels of a batch; capitals, accents and null texts give what the patterns give on the folded text."""
    texts = [("My POWERWALL 2 won't charge",), ("modèle Model\u00a03, MODEL\t3",), ("\u212a Éfire FIRE\u017f",), ("",), (None,), ("x" * 5000 + " tsb",)]
    df = spark.createDataFrame(texts, "t string")
    ent = en.entities(F.col("t"))
    out = df.select("t", F.concat(*[ent[f] for f in fx.FAMILIES]).alias("got"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Contains(" not in plan
    low = F.translate(F.coalesce("t", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.array_compact(F.array(*[F.when(low.rlike(rx), F.lit(label)) for _, label, _, rx in fx.taxonomy_rows()]))
    assert out.select("got", plain.alias("want")).where(F.col("got") != F.col("want")).collect() == []
    assert out.where(F.size("got") > 0).count() >= 3
    own = [("issues", "b", 1, "y+"), ("issues", "a", 0, "x|y")]
    assert df.limit(0).union(spark.createDataFrame([("XyY",)], "t string")).select(en.entities(F.col("t"), own)["issues"]).first()[0] == ["a", "b"]


def test_texts_of_posts_move_once(spark, tmp_path):
    """Copies are told apart where the bodies were joined: texts cross one exchange, and posts are the log's first writes."""
    d = str(tmp_path)
    ev = spark.range(1, 60).selectExpr("id AS event_id", "timestamp '2024-01-01 05:00:00' + make_dt_interval(0, 0, id) AS ts", "id % 5 AS user_id", "'view' AS event_type", "id * 1.5D AS value", "concat('{\"k\":', id, '}') AS props")
    ev.union(ev.where("event_id % 20 = 0")).write.parquet(f"{d}/events.parquet")
    spark.range(40).selectExpr("id AS doc_id", "concat('body ', id) AS text").write.parquet(f"{d}/documents.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = adapter.posts(spark, d)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") == 2
    log = adapter.landing(spark, d)
    first = adapter.shaped(adapter.first_write_wins(log.where(adapter.required_present(log))))
    assert out.columns == first.columns
    key = lambda r: r["id"]
    assert sorted(out.collect(), key=key) == sorted(first.collect(), key=key) and out.count() > 40


def test_terms_are_counted_by_batch(spark):
    """A batch's repeated terms leave it as one row, for each group, with nulls left out."""
    rows = [("g", ["a", "b", "a", "b"]), ("h", ["a"]), ("g", ["b", "a"]), ("g", []), (None, ["a", None, "b"]), ("g", None)]
    df = spark.createDataFrame(rows, "g string, terms array<string>").coalesce(1)
    words, pairs = tp._occurrences(df, "g").collect(), tp._occurrences(df, "g", pairs=True).collect()
    assert sorted(map(tuple, words), key=str) == sorted([("g", "a", 3, 2), ("g", "b", 3, 2), ("h", "a", 1, 1), (None, "a", 1, 1), (None, "b", 1, 1)], key=str)
    assert sorted(map(tuple, pairs)) == [("g", "a b", 2, 1), ("g", "b a", 2, 2)]


def test_texts_without_a_label_take_one_pass(monkeypatch):
    """Only the texts that hold some label are searched label by label."""
    seen, search = [], en.pc.match_substring_regex
    monkeypatch.setattr(en.F, "arrow_udf", lambda kind: lambda f: lambda *a: f(*a))
    monkeypatch.setattr(en.pc, "match_substring_regex", lambda texts, p: (seen.append(len(texts)), search(texts, p))[1])
    assert en._matches(pa.array(["xyz"] * 98 + ["a B", "q b"]), ["a", r"(?:^|[^a-z])b", "c"]).to_pylist() == [0] * 98 + [3, 2]
    assert seen == [100, 2, 2, 2]


def test_texts_without_a_lexicon_word_are_not_taken_apart(spark):
    """Words are extracted above a filter that passes every text with a hit, in whatever spelling, and leaves the others out."""
    rows = [("a", "so LOVE\u2014it"), ("b", "gloves"), ("c", "isn't great's"), ("d", "loo\u212a"), ("e", "\u00e9love"), ("f", ""), ("g", None), ("h", "x " * 500), ("i", "LoVe")]
    df = spark.createDataFrame(rows, "id string, text string")
    lexicon = tables.lexicon_frame(spark, [("love", 3.2), ("great's", 1.0), ("look", 1.5), (":)", 2.0)])
    assert {r["id"] for r in df.where(sc.may_hit(F.col("text"), lexicon)).collect()} == {"a", "c", "d", "e", "i"}
    out = sc.score(df, lexicon, text=F.col("text"), carry=[])
    plan = _plan(out)
    assert plan.index("regexp_extract_all") < plan.index("ArrowEvalPython")
    norm = lambda s: round(s / (s * s + 15) ** 0.5, 4) + 0.0
    want = {"a": norm(3.2 + 0.293 + 0.733), "c": norm(-0.74), "d": norm(1.5), "i": norm(3.2)}
    assert {r["id"]: r["compound"] for r in out.collect()} == {k: want.get(k, 0.0) for k, _ in rows}
    # Other letters: no text is left out.
    other = tables.lexicon_frame(spark, [("sch\u00f6n", 2.0)])
    assert sc.may_hit(F.col("text"), other) is None
    found = sc.score(spark.createDataFrame([("a", "SCH\u00d6N"), ("b", "x")], "id string, text string"), other, text=F.col("text"), carry=[])
    assert {r["id"]: r["compound"] for r in found.collect()} == {"a": norm(2.0), "b": 0.0}


def test_other_bigrams_stay_in_their_batch(spark):
    df = spark.createDataFrame([(["a", "b", "c", "a", "b"],), (["b", None, "a", "b"],), (["c"],), (None,)], "terms array<string>").coalesce(1)
    assert sorted(map(tuple, tp._occurrences(df, None, pairs=True, among=["a", "b", "z"]).collect())) == [("a b", 3, 2)]
    assert tp._occurrences(df, None, pairs=True, among=[]).collect() == []


def test_too_many_words_for_the_tasks_are_joined(spark, monkeypatch):
    rows = [(f"p{i}", ["aa", "bb", f"once{i}", "aa", "bb"]) for i in range(20)]
    tokens = spark.createDataFrame(rows, "id string, toks array<string>")
    words = tp.term_stats(tokens.select("id", F.col("toks").alias("terms")), None)
    monkeypatch.setattr(tp, "TOLD", 1)
    assert sorted(map(tuple, tp.candidate_bigrams(tokens, words, None, 2, 2, None).collect())) == [("aa bb", 20, 40)]


def test_vectors_are_counted_where_the_documents_lie(spark):
    """No term is a row and none is moved; weights are those of the joined and grouped terms."""
    rng = random.Random(4)
    rows = [(f"p{i}", rng.choices([f"w{k}" for k in range(12)], k=rng.randint(0, 25))) for i in range(200)] + [("none", ["zz"]), ("null", None), ("gap", ["w1", None, "w2"])]
    tokens = spark.createDataFrame(rows, "id string, toks array<string>").repartition(3)
    vocab = materialize(cl.vocabulary(tokens, max_features=40), "vocab")
    out = cl.vectors(tokens, vocab)
    plan = _plan(out)
    assert "Generate" not in plan and "Join" not in plan and "Aggregate" not in plan
    w = tp.weights(tp.term_arrays(tokens, None), vocab, None).join(vocab.select("term", "idx"), "term")
    want: dict = {r[0]: [] for r in rows}
    for r in w.select("id", "idx", F.round(F.col("w") * F.lit(float(cl.WEIGHT))).cast("bigint").alias("w")).orderBy("id", "idx").collect():
        want[r["id"]].append((r["idx"], r["w"]))
    got = {r["id"]: list(zip(r["idx"], r["w"], strict=True)) for r in out.collect()}
    assert got == want and got["none"] == got["null"] == [] and any(" " in r["term"] for r in vocab.collect())
    assert {(r["id"], len(r["idx"])) for r in cl.vectors(tokens, vocab.limit(0)).collect()} == {(i, 0) for i in want}


def test_small_frames_need_no_workers(spark, tmp_path):
    """A model's centres and an empty ledger are rows of the plan, not made by Python workers."""
    vecs = materialize(spark.createDataFrame([(f"p{i}", [i % 2], [10000]) for i in range(20)], "id string, idx array<int>, w array<bigint>"), "vecs")
    model = cl.fit(vecs, spark.createDataFrame([(0, "a"), (1, "b")], "idx int, term string"), k=2)
    assert "ExistingRDD" not in model._jdf.queryExecution().executedPlan().toString() and model.count() == 2
    assert [f.dataType.simpleString() for f in model.schema] == ["int", "int", "string", "bigint"]
    empty = lg.Ledger(spark, str(tmp_path / "ledger")).events()
    assert "ExistingRDD" not in empty._jdf.queryExecution().executedPlan().toString()
    assert empty.count() == 0 and [(f.name, f.dataType) for f in empty.schema] == [(f.name, f.dataType) for f in lg.EVENT] + [("run_id", empty.schema["run_id"].dataType)]


def test_alerts_read_the_log_once(spark, tmp_path, monkeypatch):
    """What alerts need as of when is told by the stored posts, which they need anyway, and not by another pass over the log."""
    spark.range(1, 60).selectExpr("id AS event_id", "timestamp '2024-01-01 05:00:00' + make_dt_interval(0, 0, id) AS ts", "id % 5 AS user_id", "'view' AS event_type", "id * 1.5D AS value", "concat('{\"k\":', id, '}') AS props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(40).selectExpr("id AS doc_id", "concat('body ', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")

    def again(log):
        raise AssertionError("the log was read for its times")

    monkeypatch.setattr(adapter, "post_times", again)
    assert Run(spark, str(tmp_path)).candidates(0, with_clusters=False).count() >= 0
    assert Run(spark, str(tmp_path)).alert_ledger.runs()

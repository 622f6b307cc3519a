"""Scalar operators on tiny literal frames, with the boundary values of FIXTURES §3."""

import datetime as dt

from pyspark.sql import functions as F

from hearsay.functions import entities as en
from hearsay.functions import scoring as sc
from hearsay.functions import text as tx
from hearsay.functions import validate as va
from hearsay.operators import anomaly as an
from hearsay.operators import topics as tp
from hearsay.sources import fixtures as fx
from hearsay.sources import tables


def one_col(spark, rows, expr, schema="x double"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("y")).collect()]


def test_sentiment_category_boundaries(spark):
    got = one_col(spark, [(0.05,), (-0.05,), (0.0499,), (0.0,)], tx.sentiment_category("x"))
    assert got == ["positive", "negative", "neutral", "neutral"]


def test_z_severity_boundaries(spark):
    got = one_col(spark, [(2.5,), (2.51,), (3.0,), (3.01,)], an.z_severity(F.col("x")))
    assert got == ["MEDIUM", "HIGH", "HIGH", "CRITICAL"]


def test_volume_severity(spark):
    rows = [(6.0, 2.0, 3.0), (7.0, 2.0, 3.5), (1.0, 4.0, 0.25), (1.0, 1.5, 0.66)]
    got = [r[0] for r in spark.createDataFrame(rows, "v double, a double, r double")
           .select(an.volume_severity(F.col("v"), F.col("a"), F.col("r"))).collect()]
    assert got == ["MEDIUM", "HIGH", "MEDIUM", "LOW"]


def test_engagement_severity_tested_first(spark):
    rows = [(51, 0, -0.9), (0, 0, -0.9), (0, 101, -0.6), (0, 0, -0.6)]
    got = [r[0] for r in spark.createDataFrame(rows, "c int, s int, x double")
           .select(an.engagement_severity(F.col("c"), F.col("s"), F.col("x"))).collect()]
    assert got == ["HIGH", "CRITICAL", "HIGH", "MEDIUM"]


def test_cluster_severity(spark):
    rows = [(-1.0, 10), (0.0, 100), (0.5, 1), (-0.5, 5)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, n long")
           .select(tp.cluster_severity(F.col("a"), F.col("n"))).collect()]
    # 1.0 CRITICAL; 0.3 is not > 0.3 → LOW; 0.03 LOW; 0.35 + 0.15 = 0.5 → not > 0.5 → MEDIUM
    assert got == ["CRITICAL", "LOW", "LOW", "MEDIUM"]


def test_permalink(spark):
    rows = [(None,), ("",), ("https://reddit.com/r/x",), ("/r/x",), ("r/x",), ("http://a.b",)]
    got = one_col(spark, rows, tx.build_permalink("x"), "x string")
    assert got == ["", "", "https://reddit.com/r/x", "https://reddit.com/r/x", "https://reddit.com/r/x", "http://a.b"]


def test_combine_text(spark):
    df = spark.createDataFrame([("T", None), ("T", ""), ("T", "body")], "title string, selftext string")
    got = df.select(tx.combine_for_scoring().alias("a"), tx.combine_for_topics().alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("T ", "T"), ("T ", "T"), ("T body", "T body")]


SAMPLES = [
    ("My Model 3 Powerwall isn't charging after recall",
     ["model_3", "model_y"], ["powerwall"], ["recall"], "powerwall"),
    ("Tesla Recalls Powerwall 2 AC Battery Systems Due to Fire and Burn Hazards",
     [], ["powerwall", "powerwall_2"], ["recall", "fire", "safety"], "powerwall"),
    ("solar panel failed NYSERDA inspection - anyone else?",
     [], ["solar_panels"], ["inspection_failure"], "solar_panels"),
    ("FSD almost caused an accident with my Model Y",
     ["model_y"], [], ["accident", "autopilot"], "model_y"),
    ("Supercharger V3 charging issues at Downtown location",
     [], ["supercharger"], ["charging_issue"], "supercharger"),
]


def test_entity_samples(spark):
    df = spark.createDataFrame([(s[0],) for s in SAMPLES], "t string")
    ent = en.entities(F.col("t"))
    got = df.select(ent.alias("e")).select("e.*", en.primary_product(F.col("e")).alias("p")).collect()
    for row, (_, veh, energy, issues, primary) in zip(got, SAMPLES):
        assert row.vehicles == veh and row.energy_products == energy and row.issues == issues and row.p == primary


def test_entities_empty_text(spark):
    df = spark.createDataFrame([("",), (None,)], "t string")
    got = df.select(en.entities(F.col("t")).alias("e")).select("e.*").collect()
    assert all(r.vehicles == [] and r.energy_products == [] and r.issues == [] for r in got)


def test_required_literals_are_substrings_of_matches():
    import re
    for _, label, patterns in fx.TAXONOMY:
        for p in patterns:
            lit = fx.required_literal(p)
            for sample in ["model 3", "m3", "model3", "models", "modelx", "mx", "modely", "my", "cyber truck", "semi truck",
                           "pw2", "pw3", "powerwall 2", "solar panel", "solar array", "pv panel", "solar tiles", "sc v3",
                           "super charger", "tsb", "service bulletin", "burning", "ignition", "collision",
                           "safety concern", "repair shop", "out of warranty", "range loss", "full self-driving",
                           "wont charge", "won't charge", "charging fail", "failed inspection", "nyserda"]:
                if re.search(p, sample):
                    assert lit in sample, (label, p, sample, lit)


def score_texts(spark, texts):
    df = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "id string, t string")
    lex = tables.lexicon_frame(spark)
    out = sc.score(df, lex, text=F.col("t"), carry=[]).orderBy(F.col("id").substr(2, 9).cast("int")).collect()
    return [r.compound for r in out]


def test_scoring_rules(spark):
    base, neg, boosted, bang, blank, contrast = score_texts(spark, [
        "great", "not great", "very great", "great!!", "", "great but bad"])
    s = 3.1
    assert abs(base - round(s / (s * s + 15) ** 0.5, 4)) < 1e-9
    assert neg < 0 < base < boosted
    assert bang > base
    assert blank == 0.0
    exp = 3.1 * 0.5 + (-2.5) * 1.5
    assert abs(contrast - round(exp / (exp * exp + 15) ** 0.5, 4)) < 1e-9


def test_validate_schema_first_error(spark):
    rows = [('{"id":"a","title":"t","author":"u","created_utc":"x","subreddit":"s"}',),
            ('{"id":"a","title":"t","created_utc":"x","subreddit":"s","score":"7"}',),
            ('{"id":"a","title":"t","author":null,"created_utc":"x","subreddit":"s"}',),
            ('{"id":"a","title":"t","author":"u","created_utc":"x","subreddit":"s","score":"7"}',),
            ('not json',)]
    got = spark.createDataFrame(rows, "v string").select(va.validate(F.col("v")).alias("r")).select("r.*").collect()
    assert [r.is_valid for r in got] == [True, False, False, False, False]
    assert got[1].errors == ["'author' is a required property"]
    assert got[2].errors == ["author is not of type 'string'"]
    assert got[3].errors == ["score is not of type 'integer'"]


def test_missing_fields(spark):
    rows = [('{"id":"a","title":"","author":null,"subreddit":"s"}',)]
    got = spark.createDataFrame(rows, "v string").select(va.missing_fields(F.col("v")).alias("m")).first().m
    assert got == ["title", "author", "created_utc"]


def test_minute_bucket_keeps_ntz(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, 5, 59),)], "t timestamp_ntz")
    r = df.select(tx.minute_bucket("t").alias("m"))
    assert r.schema["m"].dataType.typeName() == "timestamp_ntz"
    assert r.first().m == dt.datetime(2024, 1, 1, 10, 5)


def test_capitals_stand_out(spark):
    """Hand-computed: a lexicon word in capitals counts 0.733 more, if some words of the text aren't in capitals."""
    plain, caps, all_caps, negative, booster, shouted, accented = score_texts(spark, [
        "this is great", "this is GREAT", "THIS IS GREAT", "this is BAD", "VERY great indeed", "I love it", "déjà GREAT été"])
    value = lambda s: round(s / (s * s + 15) ** 0.5, 4)
    assert plain == all_caps == value(3.1)
    assert caps == accented == value(3.1 + 0.733)
    assert negative == value(-2.5 - 0.733)
    assert booster == value(3.1 + 0.293 + 0.733)
    assert shouted == value(3.2)  # "I" is in capitals, the lexicon word isn't


def test_a_lexicon_is_an_argument(spark):
    lex = tables.lexicon_frame(spark, [("déjà", 2.0), ("great", -1.0)])
    df = spark.createDataFrame([("a", "Déjà vu"), ("b", "great"), ("c", "bad")], "id string, t string")
    got = {r.id: r.compound for r in sc.score(df, lex, text=F.col("t"), carry=[]).collect()}
    value = lambda s: round(s / (s * s + 15) ** 0.5, 4)
    assert got == {"a": value(2.0), "b": value(-1.0), "c": 0.0}


def test_terms_keep_accented_words_whole(spark):
    from hearsay.functions import text as tx

    df = spark.createDataFrame([("Étion dans çouelle, l'été 2024 x größe",)], "t string")
    assert df.select(tx.term_tokens("t")).first()[0] == ["étion", "dans", "çouelle", "été", "2024", "größe"]

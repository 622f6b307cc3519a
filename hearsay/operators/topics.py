"""Topics: per-community TF-IDF keywords (C6, W5), keyword stats (J8, A19), cluster summaries
and the extraction reports (A14-A17). The clusters themselves are in ``clusters``.

TF-IDF follows the common vectoriser semantics: lower-case tokens of two or more word
characters, stop words removed *before* bigrams, 1-2 grams, document frequency bounds
(min_df as a count, max_df as a share), a vocabulary cap by total term count, smooth idf
``ln((1+n)/(1+df)) + 1``, L2 rows, and the mean weight over all documents of the group.

Plan: texts are tokenised once, into a stored table of token arrays. Words are counted by (group, term) in Arrow batches
whose counts are summed; bigrams are counted only where both words can reach the vocabulary (``candidate_bigrams``, exact).
The vocabulary is written and joined as its size suggests; per-document L2 norms are a window on ``id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import ship
from ..sources import fixtures as fx
from ..sources.tables import materialize


#: As many words go to the tasks at most.
TOLD = 50_000


def stop_words() -> list[str]:
    return list(fx.english_stop_words())


def topic_docs(posts: DataFrame) -> DataFrame:
    """(id, subreddit, text) with the topics text rule (P8) and non-null titles."""
    return posts.where(F.col("title").isNotNull()).select("id", "subreddit", tx.combine_for_topics().alias("text"))


def token_arrays(posts: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """(id, subreddit, toks): each document's tokens without stop words, in order. Written once, read by every branch."""
    stop = stop if stop is not None else stop_words()
    all_of = topic_docs(posts).select("id", "subreddit", tx.term_tokens("text").alias("toks"))
    if not stop:
        return all_of
    # One text instead of a call to the JVM for each word.
    words = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in stop)
    return all_of.select("id", "subreddit", F.expr(f"filter(toks, t -> t NOT IN ({words}))").alias("toks"))


def _bigrams(toks: Column) -> Column:
    n = F.size(toks)
    return F.when(n >= 2, F.zip_with(F.slice(toks, 1, n - 1), F.slice(toks, 2, n - 1),
                                     lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def _with_bigrams(toks: Column) -> Column:
    return F.concat(toks, _bigrams(toks))


def term_arrays(tokens: DataFrame, group: str | None) -> DataFrame:
    """(group, id, terms): each document's unigram + bigram sequence (one row per document)."""
    gk = [group] if group else []
    return tokens.select("id", *gk, _with_bigrams(F.col("toks")).alias("terms"))


def term_stats(arrays: DataFrame, group: str | None) -> DataFrame:
    """(group, term, df, total): document frequency and total count of every term.

    Keyed by (group, term) only — never by (document, term): a batch's documents are counted where they lie,
    and partial counts are summed.
    """
    return _folded(_occurrences(arrays, group), group)


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers numbered from 0, and the number that each stands for."""
    found = pa.array(keys).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_numpy()


def _occurrences(arrays: DataFrame, group: str | None, pairs: bool = False, among: list[str] | None = None) -> DataFrame:
    """(group, term, _o, _d): how often a term (of ``pairs``: two neighbours) occurs in a batch of documents, and in how many of them.

    Words become numbers a batch, so an occurrence costs no row and no string; a batch's distinct terms leave it, of pairs those
    of two words ``among`` the given ones, if any are given.
    """
    gk = [group] if group else []
    wanted = None if among is None else pa.array(among, pa.string())
    ship(arrays.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("terms")
            words, owner = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy()
            code, names = words.indices.fill_null(-1).to_numpy().astype(np.int64), words.dictionary
            if pairs:
                if wanted is not None:
                    told = np.append(pc.is_in(names, value_set=wanted).to_numpy(zero_copy_only=False), False)
                    code = np.where(told[code], code, -1)
                near = (owner[:-1] == owner[1:]) & (code[:-1] >= 0) & (code[1:] >= 0)
                code, owner = (code[:-1] * len(names) + code[1:])[near], owner[:-1][near]
            else:
                owner, code = owner[code >= 0], code[code >= 0]
            term, terms = _dense(code)
            groups = b.column(group).dictionary_encode("encode") if group else None
            own = groups.indices.to_numpy().astype(np.int64)[owner] if group else np.zeros(len(owner), np.int64)
            row, rows = _dense(own * len(terms) + term)  # a row of the result: a term of a group
            _, held = _dense(owner.astype(np.int64) * len(rows) + row)
            n, docs = np.bincount(row, minlength=len(rows)), np.bincount(held % max(1, len(rows)), minlength=len(rows))
            at = terms[rows % max(1, len(terms))]
            if pairs:
                text = pc.binary_join_element_wise(names.take(pa.array(at // max(1, len(names)))), names.take(pa.array(at % max(1, len(names)))), " ")
            else:
                text = names.take(pa.array(at))
            keys = [groups.dictionary.take(pa.array(rows // max(1, len(terms))))] if group else []
            yield pa.RecordBatch.from_arrays([*keys, text, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], [*gk, "term", "_o", "_d"])

    kinds = [T.StructField(g, arrays.schema[g].dataType) for g in gk]
    out = T.StructType([*kinds, T.StructField("term", T.StringType()), T.StructField("_o", T.LongType()), T.StructField("_d", T.LongType())])
    return arrays.select(*gk, "terms").mapInArrow(counted, out)


def _folded(occurrences: DataFrame, group: str | None) -> DataFrame:
    gk = [group] if group else []
    return occurrences.groupBy(*gk, "term").agg(F.sum("_d").alias("df"), F.sum("_o").alias("total"))


def _with_n(stats: DataFrame, tokens: DataFrame, group: str | None) -> DataFrame:
    """``stats`` with the number of documents of its group."""
    if group:
        return stats.join(tokens.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group)
    return stats.withColumn("n", tokens.select(F.count(F.lit(1))).scalar())  # one corpus: a scalar, not a join


def _kept(min_df: int, max_df: float | None) -> Column:
    keep = F.col("df") >= min_df
    return keep if max_df is None else keep & (F.col("df") <= F.col("n") * F.lit(float(max_df)))


def _top(terms: DataFrame, group: str | None, k: int) -> DataFrame:
    order = [F.col("total").desc(), F.col("term")]
    if group:  # row_number <= k per group plans as a partial WindowGroupLimit before the exchange
        return terms.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= k)
    return terms.orderBy(*order).limit(k)  # TakeOrderedAndProject keeps a bounded heap per partition


def candidate_bigrams(tokens: DataFrame, unigrams: DataFrame, group: str | None, max_features: int, min_df: int, max_df: float | None) -> DataFrame:
    """(group, term, df, total) of the bigrams that can be among the ``max_features`` terms of the largest total.

    A bigram occurs at most as often as its rarer word. Once ``max_features`` words are eligible, the smallest total among
    the first of them is a bound that every term of the vocabulary reaches, so bigrams with a rarer word can't belong
    to it; nor can bigrams with a word of too few documents. The words that are left are written, so that their size is known and
    they are broadcast; up to ``TOLD`` of them go with the tasks, so that a batch's other bigrams don't leave it. A document's
    bigrams meet them where it lies, and what is moved is partial counts of bigrams of such words.
    """
    gk = [group] if group else []
    first = _top(_with_n(unigrams, tokens, group).where(_kept(min_df, max_df)), group, max_features)
    bound = first.groupBy(*gk).agg(F.when(F.count(F.lit(1)) >= max_features, F.min("total")).otherwise(F.lit(0)).alias("least"))
    if group:
        frequent = unigrams.join(bound, group, "left").where(F.col("total") >= F.coalesce("least", F.lit(0)))
    else:
        frequent = unigrams.where(F.col("total") >= F.coalesce(bound.select("least").scalar(), F.lit(0)))
    frequent = materialize(frequent.where(F.col("df") >= min_df).select(*gk, F.col("term").alias("_w")), "frequent-words")
    told = [r["_w"] for r in frequent.select("_w").distinct().limit(TOLD + 1).collect()]
    found = _occurrences(tokens.select(*gk, F.col("toks").alias("terms")), group, pairs=True, among=told if len(told) <= TOLD else None)
    for k in (1, -1):  # words hold no space
        found = found.withColumn("_w", F.substring_index("term", " ", k)).join(frequent, [*gk, "_w"]).drop("_w")
    return _folded(found, group)


def vocabulary(tokens: DataFrame, group: str | None, max_features: int, min_df: int = 2, max_df: float | None = None) -> DataFrame:
    """(group, term, df, n, idf) of the kept vocabulary: the ``max_features`` eligible terms of the largest total."""
    gk = [group] if group else []
    words = materialize(term_stats(tokens.select("id", *gk, F.col("toks").alias("terms")), group), "word-stats")
    stats = words.unionByName(candidate_bigrams(tokens, words, group, max_features, min_df, max_df))
    ranked = _top(_with_n(stats, tokens, group).where(_kept(min_df, max_df)), group, max_features)
    idf = F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return ranked.select(*gk, "term", "df", "n", idf.alias("idf"))


def vocab_counts(arrays: DataFrame, vocab: DataFrame, group: str | None) -> DataFrame:
    """(group, id, term, tf, idf) for vocabulary terms only.

    The exploded terms meet the (broadcast, size-checked) vocabulary in the same pipeline, so only
    vocabulary hits reach the per-document count.
    """
    gk = [group] if group else []
    ex = arrays.select("id", *gk, F.explode_outer("terms").alias("term"))
    hits = ex.join(vocab.select(*gk, "term", "idf"), gk + ["term"])
    return hits.groupBy(*gk, "id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"))


def weights(arrays: DataFrame, vocab: DataFrame, group: str | None) -> DataFrame:
    """(group, id, term, w): L2-normalised tf-idf over the kept vocabulary."""
    gk = [group] if group else []
    j = vocab_counts(arrays, vocab, group)
    raw = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy("id")))
    return j.select(*gk, "id", "term", (raw / norm).alias("w"))


def community_keywords(tokens: DataFrame, top_n: int = 10, max_features: int = 100, min_df: int = 2, max_df: float = 0.8) -> DataFrame:
    """(subreddit, keyword, score) — top ``top_n`` mean tf-idf terms per community."""
    vocab = materialize(vocabulary(tokens, "subreddit", max_features, min_df, max_df), "community-vocabulary")
    w = weights(term_arrays(tokens, "subreddit"), vocab, "subreddit")
    n = vocab.select("subreddit", "n").distinct()
    means = w.groupBy("subreddit", "term").agg(F.sum("w").alias("_sw")).join(n, "subreddit")
    scored = means.select("subreddit", F.col("term").alias("keyword"), tx.rnd(F.col("_sw") / F.col("n"), 6).alias("score"))
    r = Window.partitionBy("subreddit").orderBy(F.col("score").desc(), F.col("keyword"))
    return scored.withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= top_n)


def post_sentiment(posts: DataFrame, minutes: DataFrame) -> DataFrame:
    """A post's sentiment = its (community, minute) bucket mean, 0 when it has none."""
    m = minutes.select("subreddit", "minute", "avg_sentiment")
    return posts.join(m, ["subreddit", "minute"], "left").select(
        "id", "subreddit", "minute", F.coalesce(F.col("avg_sentiment"), F.lit(0.0)).alias("sentiment"))


def keyword_hits(topics: DataFrame, posts: DataFrame) -> DataFrame:
    """(subreddit, keyword, id, day): the community's posts whose lower-cased text contains the keyword.

    ``topics`` has at most ``top_n`` rows a community, gathered into one row a community, so posts are matched where
    their texts lie: one equi-join that gives each post its community's keywords, and only ids leave it.
    """
    words = topics.groupBy("subreddit").agg(F.collect_list("keyword").alias("_words"))
    own = posts.where(F.col("title").isNotNull()).select("id", "subreddit", F.to_date("created_utc").alias("day"), F.lower(tx.combine_for_topics()).alias("_text"))
    found = own.join(words, "subreddit").select("subreddit", "id", "day", F.filter("_words", lambda w: F.contains(F.col("_text"), w)).alias("_hits"))
    return found.select("subreddit", F.explode("_hits").alias("keyword"), "id", "day")


def keyword_stats(topics: DataFrame, hits: DataFrame, sentiments: DataFrame) -> DataFrame:
    """Per keyword the posts that contain it and their mean sentiment."""
    sums = hits.join(sentiments.select("id", "sentiment"), "id").groupBy("subreddit", "keyword").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.round(F.col("sentiment") * F.lit(1e6)).cast("bigint")).alias("_u"))
    return topics.join(sums, ["subreddit", "keyword"], "left").select(
        "subreddit", "keyword", "score", F.coalesce(F.col("_n"), F.lit(0)).alias("post_count"),
        F.coalesce(F.col("_u") / F.lit(1e6) / F.col("_n"), F.lit(0.0)).alias("avg_sentiment"))


def keyword_bursts(hits: DataFrame, days: int = 7, ratio: float = 2.0, min_posts: int = 5) -> DataFrame:
    """C11: days on which a keyword is in at least ``min_posts`` posts and in over ``ratio`` times its mean of the ``days`` days before.

    Days without a post count as zero; a keyword without any post in those days has no baseline and raises nothing.
    Windows run over one row a keyword and day.
    """
    daily = hits.groupBy("subreddit", "keyword", "day").agg(F.count(F.lit(1)).alias("posts"))
    before = Window.partitionBy("subreddit", "keyword").orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    x = daily.withColumn("_before", F.sum("posts").over(before)).where(F.col("_before") > 0)
    x = x.withColumn("baseline", F.col("_before") / F.lit(float(days)))
    x = x.where((F.col("posts") >= min_posts) & (F.col("posts") > F.col("baseline") * F.lit(ratio)))
    return x.select("subreddit", "keyword", "day", "posts", tx.rnd("baseline", 6).alias("baseline"), tx.rnd(F.col("posts") / F.col("baseline"), 6).alias("ratio"))


def cluster_severity(avg: Column, n: Column) -> Column:
    """0.7 * max(0, -s) + 0.3 * min(n / 10, 1) → CRITICAL > .7, HIGH > .5, MEDIUM > .3, else LOW."""
    score = F.greatest(F.lit(0.0), -avg) * F.lit(0.7) + F.least(n / F.lit(10.0), F.lit(1.0)) * F.lit(0.3)
    return (F.when(score > 0.7, "CRITICAL").when(score > 0.5, "HIGH").when(score > 0.3, "MEDIUM").otherwise("LOW"))


def cluster_summary(labels: DataFrame, sentiments: DataFrame, keywords: DataFrame, sample: int = 10) -> DataFrame:
    """A20 + P19: count, mean sentiment, name (top 3 keywords), severity per cluster.

    Membership stays a table (``labels``: cluster_id, id — see P24); a cluster may hold a third
    of all posts, so no whole id list is gathered into one row. ``first_post_ids`` carries the
    ``sample`` smallest ids that the cluster alert quotes (row_number <= k per cluster, planned
    as a partial WindowGroupLimit).
    """
    j = labels.join(sentiments.select("id", "sentiment"), "id")
    g = j.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("post_count"),
        (F.sum(F.round(F.col("sentiment") * F.lit(1e6)).cast("bigint")) / F.lit(1e6) / F.count(F.lit(1))).alias("avg_sentiment"))
    r = Window.partitionBy("cluster_id").orderBy("id")
    first = (labels.withColumn("_r", F.row_number().over(r)).where(F.col("_r") <= sample)
             .groupBy("cluster_id").agg(F.sort_array(F.collect_list("id")).alias("first_post_ids")))
    out = g.join(first, "cluster_id").join(keywords, "cluster_id", "left")
    kw = F.coalesce(F.col("keywords"), F.array().cast("array<string>"))
    return out.select(
        "cluster_id", F.concat_ws(" | ", F.slice(kw, 1, 3)).alias("cluster_name"), "first_post_ids", kw.alias("keywords"),
        "avg_sentiment", "post_count", cluster_severity(F.col("avg_sentiment"), F.col("post_count")).alias("severity"))

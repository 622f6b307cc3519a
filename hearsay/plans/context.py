"""Per-run context: the shared frames every query plan starts from.

Frames are built lazily and only once per context, so one query that touches the rollup from
several branches reuses the same logical subtree (Spark then reuses the exchange).
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators import clusters as cl
from ..operators import rollup as ru
from ..operators import store
from ..operators.ledger import Ledger
from ..session import is_local
from ..sources import adapter, tables


class Ctx:
    """Shared frames. What is derived from an input is stored once for that version of it and read by every later query."""

    #: Stored tables that depend on the scores.
    BY_SCORE = {"scored", "minutes", "topic-stats", "issue-clusters", "candidates"}

    def __init__(self, spark: SparkSession, sf_dir: str, lexicon: list[tuple[str, float]] | None = None):
        """``lexicon``: (token, valence) rows for the scorer instead of its own; tables that depend on it are stored apart."""
        self.spark = spark
        self.sf_dir = sf_dir
        self.lexicon_rows = lexicon

    def table(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.sf_dir, name)

    @cached_property
    def version(self) -> str:
        """The version of the input: a key of the files of the tables that posts come from."""
        return store.input_version(self.table("events"), self.table("documents"))

    @cached_property
    def scored_version(self) -> str:
        """The version of what depends on scores: the input's, and the lexicon's where it isn't the usual one."""
        own = "" if self.lexicon_rows is None else f"-{hashlib.sha256(repr(sorted(self.lexicon_rows)).encode()).hexdigest()[:16]}"
        return self.version + own

    def stored(self, name: str, build: Callable[[], DataFrame], row_group_bytes: int | None = None) -> DataFrame:
        version = self.scored_version if name in self.BY_SCORE else self.version
        return store.stored(self.spark, name, version, build, row_group_bytes)

    @cached_property
    def landing(self) -> DataFrame:
        return adapter.landing(self.spark, self.sf_dir)

    @cached_property
    def posts(self) -> DataFrame:
        """The clean posts table (the K2 sink's output).

        Every branch (scoring, TF-IDF, keyword matching, labels, checks) then scans Parquet with
        column pruning instead of re-running the landing join and the dedupe exchange.
        """
        # On one machine small row groups let one file be read by every core; a cluster has files enough.
        rg = 4 << 20 if is_local(self.spark) else None
        return self.stored("posts", lambda: adapter.posts(self.spark, self.sf_dir), rg)

    @cached_property
    def lexicon(self) -> DataFrame:
        return tables.lexicon_frame(self.spark, self.lexicon_rows)

    @cached_property
    def scored(self) -> DataFrame:
        """Enriched posts: entities, primary_product, compound, category (no text).

        Every later branch (rollups, detectors, serving) reads this narrow table instead of
        re-scoring the texts, and a lost executor does not send the lineage back to the text scan.
        """
        return self.stored("scored", lambda: ru.enrich(self.posts, self.lexicon))

    @cached_property
    def minutes(self) -> DataFrame:
        return self.stored("minutes", lambda: ru.minute_rollup(self.scored))

    @cached_property
    def as_of(self) -> Column:
        """The hour after the newest clean post; without stored posts, from four narrow columns of the log."""
        path = store.stored_path(self.spark, "posts", self.version)
        return adapter.as_of(self.spark.read.parquet(path) if path else adapter.post_times(self.landing))


class Run(Ctx):
    """Context with the derived tables of a full pipeline run (topics, clusters, alert ledger)."""

    # detector runs before the current one, in hours before ``as_of`` (the ledger's history)
    HISTORY_HOURS = (30, 6)

    def at(self, hours_before: int) -> Column:
        from pyspark.sql import functions as F
        return self.as_of - F.expr(f"INTERVAL {hours_before} HOURS") if hours_before else self.as_of

    @cached_property
    def sentiments(self) -> DataFrame:
        from ..operators import topics as tp
        return tp.post_sentiment(self.posts, self.minutes)

    @cached_property
    def topics(self) -> DataFrame:
        """K7: the keywords of each community, a stored version."""
        from ..operators import topics as tp
        return self.stored("topics", lambda: tp.community_keywords(self.tokens))

    @cached_property
    def tokens(self) -> DataFrame:
        from ..operators import topics as tp
        return self.stored("topic-tokens", lambda: tp.token_arrays(self.posts))

    @cached_property
    def keyword_hits(self) -> DataFrame:
        from ..operators import topics as tp
        return self.stored("keyword-hits", lambda: tp.keyword_hits(self.topics, self.posts))

    @cached_property
    def topic_stats(self) -> DataFrame:
        from ..operators import topics as tp
        return self.stored("topic-stats", lambda: tp.keyword_stats(self.topics, self.keyword_hits, self.sentiments))

    @cached_property
    def _vectors(self) -> tuple[DataFrame, DataFrame]:
        vocab = self.stored("vocabulary", lambda: cl.vocabulary(self.tokens))
        return vocab, self.stored("post-vectors", lambda: cl.vectors(self.tokens, vocab))

    @cached_property
    def model(self) -> DataFrame:
        """The stored centres."""
        vocab, vecs = self._vectors
        return self.stored("cluster-model", lambda: cl.fit(vecs, vocab))

    @cached_property
    def labels(self) -> DataFrame:
        """Every post with its cluster, by the stored model."""
        vocab, vecs = self._vectors
        return self.stored("cluster-labels", lambda: cl.assign(vecs, self.model, vocab.count()))

    @cached_property
    def clusters(self) -> DataFrame:
        """The summaries of the model's clusters, a stored version."""
        from ..operators import topics as tp
        return self.stored("issue-clusters", lambda: tp.cluster_summary(self.labels, self.sentiments, cl.centre_keywords(self.model)))

    def candidates(self, hours_before: int = 0, with_clusters: bool = True) -> DataFrame:
        """Detector candidates of a run at ``as_of - hours_before`` over the data seen by then."""
        from pyspark.sql import functions as F

        from ..operators import anomaly as an
        self.minutes  # posts are stored now, and their newest hour needs no pass over the log
        at = self.at(hours_before)
        m = self.minutes.where(F.col("minute") < at) if hours_before else self.minutes
        s = self.scored.where(F.col("created_utc") < at) if hours_before else self.scored
        parts = [an.sentiment_anomalies(m, s, at), an.volume_anomalies(m, at)]
        if with_clusters:
            parts.append(an.cluster_anomalies(self.clusters, at))
        parts.append(an.extreme_posts(s, m, at))
        return an.all_alerts(parts)

    @cached_property
    def current_candidates(self) -> DataFrame:
        return self.stored("candidates", lambda: self.candidates(0))

    @cached_property
    def alert_ledger(self) -> Ledger:
        """The stored ledger of this input: the history's runs and the current one, each appended once."""
        ledger = Ledger(self.spark, os.path.join(store.table_root(self.spark, "ledger"), self.scored_version))
        self.minutes  # as in candidates
        for h in self.HISTORY_HOURS:
            ledger.run(self.run_id(h), lambda h=h: self.candidates(h, with_clusters=False), self.at(h))
        ledger.run(self.run_id(0), lambda: self.current_candidates, self.as_of)
        return ledger

    @cached_property
    def quality_log(self) -> DataFrame:
        """The stored check log of this input."""
        from ..operators import quality as qu
        return qu.metric_log(self.spark, os.path.join(store.table_root(self.spark, "quality-log"), self.version), self.landing, self.as_of)

    @staticmethod
    def run_id(hours_before: int) -> str:
        return f"{hours_before:03d}h-before"

    @property
    def ledger(self) -> DataFrame:
        return self.alert_ledger.state().drop("raised_in")

    def scratch(self, name: str) -> str:
        return os.path.join(store.table_root(self.spark, name), uuid.uuid4().hex)

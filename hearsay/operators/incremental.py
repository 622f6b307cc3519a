"""The minute rollup kept up to date batch by batch (K2-K4, J1): work follows the batch, not the history.

A batch is the part of the message log between two offsets. Of it, the posts that aren't stored yet are scored
(their texts alone are read), and their integer partials per (minute, community) are appended: only the keys a
batch touches are written, a late post adds to its minute, and partials of a key are summed when they are read.
``compact`` folds them into a new base version.

Every batch has one folder under ``scored`` and ``partials`` and a commit row with its offsets and counts, written
last. What isn't committed isn't read, and a batch that is processed again after a failure rewrites its folders,
so nothing counts twice. The processed offset is the last commit's.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapter
from . import rollup as ru
from . import sinks as sk
from .store import Versions, children, exists

COMMIT = "batch int, from_offset long, upto_offset long, inserted long, duplicates long, errors long"
PARTIAL = "minute timestamp_ntz, subreddit string, posts_count long, score_units long, positive_count long, negative_count long, neutral_count long"


class IncrementalRollup:
    """Scored posts and rollup partials below ``root``, advanced along a message log."""

    def __init__(self, spark: SparkSession, root: str, lexicon: DataFrame) -> None:
        self.spark, self.root, self.lexicon = spark, root, lexicon
        self.base = Versions(spark, os.path.join(root, "base"))

    def _path(self, kind: str, batch: int) -> str:
        return os.path.join(self.root, kind, f"batch={batch}")

    def batches(self) -> DataFrame:
        """The committed batches: offsets, and inserted / duplicate / error counts (K3)."""
        done = [os.path.join(self.root, "commits", c) for c in children(self.spark, os.path.join(self.root, "commits"))]
        done = [c for c in done if exists(self.spark, os.path.join(c, "_SUCCESS"))]
        return self.spark.read.schema(COMMIT).parquet(*done) if done else self.spark.createDataFrame([], COMMIT)

    def position(self) -> tuple[int, int]:
        """The next batch's number and the last processed offset."""
        last, mark = self.batches().agg(F.max("batch"), F.max("upto_offset")).first()
        return (0, -1) if last is None else (last + 1, mark)

    def _read(self, kind: str, after: int = -1) -> DataFrame | None:
        n, _ = self.position()
        folders = [self._path(kind, b) for b in range(after + 1, n)]
        return self.spark.read.option("basePath", os.path.join(self.root, kind)).parquet(*folders) if folders else None

    def scored(self) -> DataFrame | None:
        """The stored posts of all committed batches."""
        return self._read("scored")

    def advance(self, landing: DataFrame, upto: int) -> bool:
        """Process the messages up to an offset; whether there was anything beyond the processed one."""
        batch, mark = self.position()
        if upto <= mark:
            return False
        messages = landing.where((F.col("msg_offset") > mark) & (F.col("msg_offset") <= upto))
        stored = self.scored()
        ids = stored.select("id") if stored is not None else messages.select("id").limit(0)
        fresh = adapter.shaped(sk.insert_if_absent(messages, ids))
        ru.enrich(fresh, self.lexicon).write.mode("overwrite").parquet(self._path("scored", batch))
        scored = self.spark.read.parquet(self._path("scored", batch))
        ru.minute_partials(scored).write.mode("overwrite").parquet(self._path("partials", batch))
        counts = sk.ingest_counts(messages, scored)
        row = counts.select(F.lit(batch).alias("batch"), F.lit(mark).cast("long").alias("from_offset"), F.lit(upto).cast("long").alias("upto_offset"), "inserted", "duplicates", "errors")
        row.coalesce(1).write.mode("overwrite").parquet(os.path.join(self.root, "commits", f"batch={batch:06d}"))
        return True

    def partials(self) -> DataFrame:
        """The partials of the base and of the batches after it; several rows a key."""
        base = self.base.entries()
        after = int(base[-1][2]) if base else -1
        later = self._read("partials", after)
        parts = [x.select([f.split()[0] for f in PARTIAL.split(", ")]) for x in (self.base.read() if base else None, later) if x is not None]
        out = parts[0] if parts else self.spark.createDataFrame([], PARTIAL)
        return out.unionByName(parts[1]) if len(parts) > 1 else out

    def minutes(self) -> DataFrame:
        """The rollup of everything processed so far."""
        return ru.finish(ru.merge_partials(self.partials()))

    def compact(self, keep: int = 2) -> None:
        """Fold the partials into one row a key, as a new base; older bases go, readers of the last ``keep`` stay."""
        n, _ = self.position()
        if n:
            self.base.publish(ru.merge_partials(self.partials()), str(n - 1))
            self.base.expire(keep)

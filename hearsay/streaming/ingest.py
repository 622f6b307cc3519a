"""Structured Streaming: X1-X9.

Pipeline (two queries, a Parquet table between them):

1. ``ingest``: message source (Kafka topic, or a JSON file directory in tests) → ``from_json``
   → ISO text to timestamps (P3) → valid/quarantine split (P4) → event-time watermark →
   ``dropDuplicatesWithinWatermark(id)`` (X4) → ``foreachBatch``: batch enrichment (X5, the
   same relational scoring/tagging as the batch path, lexicon broadcast) of the batch's posts,
   written to ``scored_posts/batch_id=N``, into ``scored/batch_id=N`` with dynamic partition overwrite, so a replayed micro-batch rewrites
   its own partition (X7/X9: at-least-once delivery + idempotent sink). The checkpoint
   replaces the consumer's offset commit. Messages that can't be decoded or lack a required
   field go to ``quarantine/batch_id=N`` with their text and the reason, by a query of its own.
2. ``minute_rollup_stream``: reads the scored table as a stream, watermark 10 minutes, one row
   per id (a rewritten partition is new files to a file stream; its ids are known and count once),
   1-minute tumbling windows per community (X2/X3); append mode emits a window once the
   watermark passes it; later rows for a closed window are dropped (X8). ``detect`` runs the
   detector in the batch that closes the windows (X6), with mergeable moments as its state.

Streams carry ``TIMESTAMP`` (session UTC) because watermarks reject ``TIMESTAMP_NTZ``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import anomaly as an
from ..operators import rollup as ru
from ..operators.store import children
from ..sources import adapter, tables

MESSAGE_SCHEMA = (
    "id string, title string, selftext string, author string, subreddit string, created_utc string, score int, "
    "num_comments int, url string, permalink string, upvote_ratio double, is_self boolean, link_flair_text string, "
    "ingested_at string"
)
WATERMARK = "10 minutes"


def kafka_source(spark: SparkSession, servers: str, topic: str, max_offsets: int = 1000) -> DataFrame:
    """The keyed topic, from the earliest offset, at most ``max_offsets`` per trigger."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
            .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_offsets).load()
            .select(F.col("value").cast("string").alias("value")))


def file_source(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """X1 for tests: newline-delimited message JSON files, ``max_files`` per trigger."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def parse(raw: DataFrame, keep_value: bool = False) -> DataFrame:
    """Decode the message JSON; ISO strings become timestamps (NULL when malformed)."""
    m = F.from_json(F.col("value"), MESSAGE_SCHEMA)
    p = raw.select("value", m.alias("m")).select(*(["value"] if keep_value else []), "m.*")
    return (p.withColumn("created_utc", F.try_to_timestamp("created_utc"))
            .withColumn("ingested_at", F.try_to_timestamp("ingested_at")))


def valid(parsed: DataFrame) -> Column:
    return adapter.required_present(parsed)


def rejected(raw: DataFrame) -> DataFrame:
    """Messages that ``valid`` turns down: (value, reason), the reason naming the missing fields."""
    p = parse(raw, keep_value=True)
    missing = F.concat_ws(", ", *[F.when(F.col(f).isNull(), F.lit(f)) for f in adapter.REQUIRED_FIELDS])
    undecoded = F.coalesce(F.expr("try_parse_json(value)").isNull(), F.lit(True))
    reason = F.when(undecoded, F.lit("not JSON")).otherwise(F.concat(F.lit("missing: "), missing))
    return p.where(~valid(p)).select("value", reason.alias("reason"))


def deduped(parsed: DataFrame) -> DataFrame:
    """Valid rows, event-time watermark, first arrival per id kept within the watermark."""
    return parsed.where(valid(parsed)).withWatermark("created_utc", WATERMARK).dropDuplicatesWithinWatermark(["id"])


def _enrich_batch(out_dir: str, lexicon_rows):
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        lex = tables.lexicon_frame(spark, lexicon_rows)
        posts = (batch.withColumn("created_utc", F.col("created_utc").cast("timestamp_ntz"))
                 .withColumn("ingested_at", F.col("ingested_at").cast("timestamp_ntz"))
                 .withColumn("permalink", tx.build_permalink("permalink"))
                 .withColumn("minute", tx.minute_bucket("created_utc")))
        # The batch's posts are written once and read back: the stateful dedupe runs once a batch, and is counted once.
        stored = os.path.join(f"{out_dir}_posts", f"batch_id={batch_id}")
        posts.write.mode("overwrite").parquet(stored)
        scored = ru.enrich(spark.read.parquet(stored), lex).withColumn("batch_id", F.lit(batch_id))
        (scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_dir))
    return fn


def ingest(raw: DataFrame, out_dir: str, checkpoint: str, lexicon_rows=None, available_now: bool = True,
           interval: str = "5 seconds"):
    """Start the ingest query; returns the StreamingQuery. Its progress carries the counts of ``batch_counts``."""
    parsed = parse(raw)
    ok = valid(parsed)
    seen = parsed.observe("messages", F.count(F.lit(1)).alias("received"), F.count_if(~ok).alias("errors"))
    kept = deduped(seen).observe("kept", F.count(F.lit(1)).alias("inserted"))
    w = kept.writeStream.foreachBatch(_enrich_batch(out_dir, lexicon_rows)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def batch_counts(query) -> list[dict]:
    """K3 of a running or ended ingest query: per micro-batch inserted, duplicate (or late) and error counts."""
    out = []
    for p in query.recentProgress:
        m = p.observedMetrics
        if "messages" in m and "kept" in m and m["messages"]["received"]:
            received, errors, inserted = m["messages"]["received"], m["messages"]["errors"], m["kept"]["inserted"]
            out.append({"batch_id": p.batchId, "inserted": inserted, "duplicates": received - errors - inserted, "errors": errors})
    return out


def quarantine(raw: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True, interval: str = "5 seconds"):
    """Start the query that keeps rejected messages, a partition per batch; returns the StreamingQuery."""

    def fn(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_dir))

    w = rejected(raw).writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def error_counts(quarantined: DataFrame) -> DataFrame:
    """Rejected messages by batch and reason."""
    return quarantined.groupBy("batch_id", "reason").agg(F.count(F.lit(1)).alias("messages"))


def minute_rollup_stream(spark: SparkSession, scored_dir: str, schema) -> DataFrame:
    """1-minute tumbling windows per community over the scored table, as a stream."""
    # A replay deletes the files of its batch and writes the same rows anew: a missing file isn't a loss.
    s = (spark.readStream.schema(schema).option("ignoreMissingFiles", True).parquet(scored_dir)
         .withColumn("event_time", F.col("created_utc").cast("timestamp")))
    once = s.withWatermark("event_time", WATERMARK).dropDuplicatesWithinWatermark(["id"])
    g = once.groupBy(F.window("event_time", "1 minute"), "subreddit").agg(
        F.count(F.lit(1)).alias("posts_count"),
        F.sum(ru.units("compound")).alias("score_units"),
        F.count_if(F.col("category") == "positive").alias("positive_count"),
        F.count_if(F.col("category") == "negative").alias("negative_count"),
        F.count_if(F.col("category") == "neutral").alias("neutral_count"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("minute"), "subreddit", "posts_count",
                    ru.mean_from_units(F.col("score_units"), F.col("posts_count")).alias("avg_sentiment"),
                    "positive_count", "negative_count", "neutral_count")


def _moments(windows: DataFrame) -> DataFrame:
    """(subreddit, n, s1, s2): count, sum and sum of squares of the windows' sentiment in exact whole units; merge = sum."""
    u = an.micro("avg_sentiment")
    return windows.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n"), F.sum(u).alias("s1"), F.sum((u * u).cast("decimal(38,0)")).cast("decimal(38,0)").alias("s2"))


def merge_moments(parts: DataFrame) -> DataFrame:
    return parts.groupBy("subreddit").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").cast("decimal(38,0)").alias("s2"))


def _detect_batch(root: str, threshold: float):
    """A micro-batch of settled windows against the moments of all earlier ones.

    Windows settle in the order of time, so those of a batch come after all that the state has seen: each is judged
    by the state and the batch's own earlier windows, and the alerts don't depend on how the stream was cut. The
    state, a row a community, is written per batch; a batch that runs again starts from its predecessor's.
    """

    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = lambda kind, k: os.path.join(root, kind, f"batch_id={k}")
        batch.write.mode("overwrite").parquet(part("minutes", batch_id))
        windows = spark.read.parquet(part("minutes", batch_id))
        seen = [k for k in (int(c.split("=")[1]) for c in children(spark, os.path.join(root, "moments")) if c.startswith("batch_id=")) if k < batch_id]
        state = spark.read.parquet(part("moments", max(seen))) if seen else _moments(windows.limit(0))
        an.expanding_anomalies(windows, threshold, state).write.mode("overwrite").parquet(part("alerts", batch_id))
        merge_moments(state.unionByName(_moments(windows))).coalesce(1).write.mode("overwrite").parquet(part("moments", batch_id))

    return fn


def detect(spark: SparkSession, scored_dir: str, schema, root: str, checkpoint: str, threshold: float = 2.0, available_now: bool = True, interval: str = "5 seconds"):
    """Start the query that settles minute windows and raises alerts in the batch that closes them; returns the StreamingQuery."""
    w = minute_rollup_stream(spark, scored_dir, schema).writeStream.outputMode("append").foreachBatch(_detect_batch(root, threshold)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def run_pipeline(spark: SparkSession, landing: DataFrame, root: str, slices: int = 4, max_files: int = 1000) -> dict[str, str]:
    """Drive all queries over a message log in ``slices`` arrival-time slices.

    Each slice is appended to the source directory and the *same* queries are restarted from their checkpoints
    (availableNow): ingest takes the slice's new files, the detector what ingest has written, so alerts appear
    slice by slice and every restart exercises X7/X9. A slice has fewer files than a trigger may take, so that
    a slice is one micro-batch and the watermark moves slice by slice.
    """
    from ..sources import listing

    src = os.path.join(root, "in")
    scored_dir = os.path.join(root, "scored")
    t = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    lo, hi = landing.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    step = (hi - lo) // slices + 1
    msgs = landing.select(t.alias("_t"), listing.message_value(False).alias("value"))
    for i in range(slices):
        part = msgs.where((F.col("_t") >= lo + i * step) & (F.col("_t") < lo + (i + 1) * step)).select("value")
        part.coalesce(max_files // 2).write.mode("append").text(src)
        ingest(file_source(spark, src, max_files), scored_dir, os.path.join(root, "ckpt_ingest")).awaitTermination()
        schema = spark.read.parquet(scored_dir).drop("batch_id").schema
        detect(spark, scored_dir, schema, os.path.join(root, "detected"), os.path.join(root, "ckpt_detect")).awaitTermination()
    bad_dir = os.path.join(root, "quarantine")
    quarantine(file_source(spark, src, max_files), bad_dir, os.path.join(root, "ckpt_quarantine")).awaitTermination()
    found = os.path.join(root, "detected")
    return {"in": src, "scored": scored_dir, "quarantine": bad_dir, "minutes": os.path.join(found, "minutes"), "alerts": os.path.join(found, "alerts"), "moments": os.path.join(found, "moments")}

"""Sinks and table maintenance: K2 insert-if-absent, K3 ingest counts, K4 rollup merge,
K5 day overwrite, K6 enrichment update, K13 lake layout. Versioned refreshes (K7, K8) are in ``store``.

Tables are plain Parquet (no MERGE without a table format), so updates are expressed as
relational rewrites: anti-join + append, partial sums, dynamic partition overwrite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapter


def insert_if_absent(batch: DataFrame, existing_ids: DataFrame) -> DataFrame:
    """K2: valid batch rows, first arrival per id, whose id is not stored yet (first write wins)."""
    valid = batch.where(adapter.required_present(batch))
    first = adapter.first_write_wins(valid)
    return first.join(existing_ids.select("id"), "id", "left_anti")


def ingest_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """K3: inserted / duplicate / error counts of one batch (one pass each side)."""
    b = batch.agg(F.count_if(adapter.required_present(batch)).alias("_valid"),
                  F.count_if(~adapter.required_present(batch)).alias("errors"))
    n = inserted.select(F.count(F.lit(1))).scalar()
    return b.select(n.alias("inserted"), (F.col("_valid") - n).alias("duplicates"), "errors")


def enrich_update(posts: DataFrame, enrichment: DataFrame) -> DataFrame:
    """K6: set entities / primary_product by id, keeping old values where none is computed."""
    e = enrichment.select("id", F.col("entities").alias("_ne"), F.col("primary_product").alias("_np"))
    base = posts if "entities" in posts.columns else posts.withColumn(
        "entities", F.lit(None).cast("struct<vehicles:array<string>,energy_products:array<string>,issues:array<string>>")
    ).withColumn("primary_product", F.lit(None).cast("string"))
    j = base.join(e, "id", "left")
    return j.withColumn("entities", F.coalesce("_ne", "entities")).withColumn(
        "primary_product", F.when(F.col("_ne").isNotNull(), F.col("_np")).otherwise(F.col("primary_product"))
    ).drop("_ne", "_np")


def lake_write(posts: DataFrame, root: str) -> str:
    """Parquet lake, year=/month=/day=/hour= of created_utc (dynamic partition overwrite)."""
    t = F.col("created_utc")
    out = posts.withColumn("year", F.year(t)).withColumn("month", F.month(t)).withColumn(
        "day", F.dayofmonth(t)).withColumn("hour", F.hour(t))
    # cluster by the partition keys so each task writes few files per partition directory
    (out.repartition("year", "month", "day", "hour").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "day", "hour").parquet(root))
    return root


def overwrite_days(rows: DataFrame, root: str, column: str = "date") -> str:
    """K5: replace the days that ``rows`` holds; the files of every other day stay as they are."""
    rows.repartition(column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(root)
    return root


def lake_counts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).groupBy("year", "month", "day", "hour").agg(F.count(F.lit(1)).alias("rows"))


def batch_split(landing: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Two arrival batches of the log: before ``cutoff`` and from it on (by ingested_at)."""
    return landing.where(F.col("ingested_at") < cutoff), landing.where(F.col("ingested_at") >= cutoff)

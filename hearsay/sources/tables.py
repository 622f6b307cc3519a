"""Scans of the driver's Parquet tables and the bounded parameter frames.

Every scan goes through ``spark.read.parquet`` so Catalyst prunes columns and pushes filters
into the reader; nothing is cached implicitly.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import fixtures as fx

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def lexicon_frame(spark: SparkSession, rows: list[tuple[str, float]] | None = None) -> DataFrame:
    """(token, valence), which the scorer broadcasts. Given as an Arrow table: rows made in Python would start workers for it."""
    rows = list(rows if rows is not None else fx.LEXICON)
    schema = T.StructType([T.StructField("token", T.StringType(), False), T.StructField("valence", T.DoubleType(), False)])
    return spark.createDataFrame(pa.table({"token": pa.array([t for t, _ in rows], pa.string()), "valence": pa.array([v for _, v in rows], pa.float64())}), schema)


def communities_frame(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(subreddit, ord) of a target list."""
    names = list(names if names is not None else fx.COMMUNITIES)
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "subreddit string, ord int")


def materialize(df: DataFrame, name: str = "t", row_group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    This is the lineage cut used between pipeline stages: a lost executor re-reads the written
    table instead of recomputing upstream stages, and unlike an RDD checkpoint the plan runs
    once (no second pass to save) and downstream scans keep column pruning and pushdown.
    """
    import uuid

    from ..session import checkpoint_dir

    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    w = df.write.mode("errorifexists")
    if row_group_bytes:
        # bounded row groups let readers split big files into balanced tasks (CPU-bound text stages)
        w = w.option("parquet.block.size", str(row_group_bytes))
    w.parquet(path)
    return spark.read.parquet(path)

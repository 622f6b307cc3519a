"""Connected components of an edge table by alternating large and small stars, one written table a step.

Each step relinks every node to the smallest one it knows of; the edges become stars around the smallest
node of each component in a few steps. Minima are pre-aggregated before they are shuffled, and written, so
that AQE can split the join at a node with very many links. Nothing but two sums comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    if large:
        pairs = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    else:
        pairs = edges.select(high.alias("u"), low.alias("v"))
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "star-minima")
    if large:
        linked = pairs.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = pairs.join(least, "u").select(F.explode(F.array("v", "u")).alias("a"), F.col("m").alias("b"))
    return linked.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component's name is its smallest node."""
    e = materialize(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    state = None
    for _ in range(max_steps):
        e = materialize(_star(_star(e, True), False), "stars")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

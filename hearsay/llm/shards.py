"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed by id into a fixed number of virtual slots; bytes and rows are summed per slot; a
stored table maps slots to shards, one version after another. Version 1 deals slots round robin.
Rebalancing writes a further version: it edits the last one, largest slots first, moving a slot only
when that brings its shard and the lightest one closer together. Adding a shard edits likewise, with
the new shard as the only receiver. The law that holds is ``bytes``: shard sizes are near equal, to
within the largest slot.

Defined cases: a null text has no bytes (size 1) and crc32 0; a null id hashes like any value (one
slot); rows that share an id share a slot; an empty table has an even map and no rows; positions in
a shard are gapless from 0, by virtual slot, then id, then size and crc32.

At scale: only sums per slot reach the driver (``n_slots`` rows, whatever the input) and the map that
goes out is as small. Positions come from a prefix sum over slots and a row number within a slot, so no
task holds more than a slot of narrow rows; texts never move.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

N_SLOTS = 4096
#: A slot moves only while its shard is above the mean by more than this share.
TOLERANCE = 0.0005


def slot_of(id_col: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(n_slots)).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """The narrow rows that sharding works on: id, size, text_crc32, virtual_slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(F.col(id_col), n_slots).alias("virtual_slot"),
    )


def rebalance(shards: list[int], weights: list[int], n_shards: int, only_into: int | None = None) -> list[int]:
    """An edited copy of a slot-to-shard list: slots move from shards above the mean to lighter ones.

    With ``only_into``, that shard is the only receiver. Slots are taken largest first, so that the
    small ones even out what the large ones leave.
    """
    out = list(shards)
    load = [0] * n_shards
    for s, w in zip(out, weights):
        load[s] += w
    mean = sum(load) / n_shards
    by_shard: list[list[int]] = [[] for _ in range(n_shards)]
    for slot in sorted(range(len(out)), key=lambda k: (weights[k], k)):
        by_shard[out[slot]].append(slot)
    givers = [(-w, s) for s, w in enumerate(load) if w > mean]
    heapq.heapify(givers)
    takers = [(w, s) for s, w in enumerate(load) if w < mean and only_into in (None, s)]
    heapq.heapify(takers)
    while givers and takers:
        most, giver = heapq.heappop(givers)
        least, taker = heapq.heappop(takers)
        give, room = -most - mean, mean - least
        moved = 0
        for slot in reversed(by_shard[giver]):
            if 0 < weights[slot] <= min(give, room) - moved:
                out[slot] = taker
                moved += weights[slot]
        by_shard[giver] = [x for x in by_shard[giver] if out[x] == giver]
        if -most - moved > mean * (1 + TOLERANCE) and moved:
            heapq.heappush(givers, (most + moved, giver))
        if not moved:  # nothing of the giver fits this taker: the taker is as full as it gets, or the giver has no small slot
            (heapq.heappush(givers, (most, giver)) if room < give else heapq.heappush(takers, (least, taker)))
        elif least + moved < mean * (1 - TOLERANCE):
            heapq.heappush(takers, (least + moved, taker))
    return out


def _map_rows(spark: SparkSession, version: int, shards: list[int], weights: list[int]) -> DataFrame:
    """One version of the map as rows; the lists are ``n_slots`` long."""
    at = F.col("id").cast("int")
    pick = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",")[at].cast("long")
    return spark.range(0, len(shards), 1, 1).select(
        F.lit(version).alias("version"), at.alias("virtual_slot"), pick(shards).cast("int").alias("shard"), pick(weights).alias("slot_bytes")
    )


def slot_map(narrow: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """The stored map: (version, virtual_slot, shard, slot_bytes). 1: even, 2: rebalanced by bytes, 3: one more shard."""
    spark = narrow.sparkSession
    sums = {r[0]: r[1] for r in narrow.groupBy("virtual_slot").agg(F.sum("size")).collect()}  # n_slots rows at most
    weights = [sums.get(k, 0) for k in range(n_slots)]
    v1 = [k % n_shards for k in range(n_slots)]
    v2 = rebalance(v1, weights, n_shards)
    v3 = rebalance(v2, weights, n_shards + 1, only_into=n_shards)
    versions = [_map_rows(spark, k + 1, v, weights) for k, v in enumerate((v1, v2, v3))]
    return materialize(versions[0].unionByName(versions[1]).unionByName(versions[2]), f"slot-map-{uuid.uuid4().hex[:8]}")


def assign(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) of every row of ``docs``."""
    narrow = sized(docs, id_col, text_col, n_slots)
    stored = slot_map(narrow, n_shards, n_slots)
    per_slot = narrow.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("rows"))
    current = stored.filter(F.col("version") == 2).select("virtual_slot", "shard")
    starts = current.join(per_slot, "virtual_slot").withColumn(  # n_slots rows
        "start", F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("rows")
    ).select("virtual_slot", "shard", "start")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col(id_col), "size", "text_crc32"))
    return (
        narrow.withColumn("__place", place - 1)
        .join(F.broadcast(starts), "virtual_slot")  # bounded by n_slots
        .select(
            F.col(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("__place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(2).alias("map_version"),
        )
    )


def report(docs: DataFrame) -> DataFrame:
    return assign(docs, 8)

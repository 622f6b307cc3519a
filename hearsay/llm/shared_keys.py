"""Which hashes do several rows hold? Blocks of rows ask once a hash; buckets of hashes answer with one bit each.

A block sends, for each bucket, its distinct hashes (32 bits and the bucket) and whether two of its rows hold
them. A bucket compares what its blocks sent. 32 bits and a bucket may let two hashes coincide: the answer is
a superset, for operators that verify what it lets through. No hash is hot: it comes once a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema

#: Text bytes for which there is one bucket.
BUCKET_BYTES = 16 << 20
LOW = np.uint64(0xFFFFFFFF)


def bucket_bits(total_bytes: int) -> int:
    return max(0, min(20, (-(-total_bytes // BUCKET_BYTES) - 1).bit_length()))


def bucket_keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and 32 bits of 64-bit hashes, as one number: bucket highest."""
    return ((hashes & np.uint64((1 << bits) - 1)) << np.uint64(32)) | ((hashes >> np.uint64(20)) & LOW)


def runs_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return first, np.append(first[1:], len(sorted_values))


def answers(x: DataFrame, keys_of: Callable[[pa.Table], list[np.ndarray]]) -> DataFrame:
    """(block, bucket, shared): for the sorted distinct keys of a block and bucket, a bit each, set where another row has the key.

    ``x`` has a block column; ``keys_of`` gives the distinct keys of each row of a block.
    """
    ask_schema = T.StructType.fromDDL("bucket int, block int, keys binary, twice binary")
    ask_out = arrow_schema(ask_schema)

    def ask(table: pa.Table) -> pa.Table:
        keys, n = np.unique(np.concatenate(keys_of(table)), return_counts=True)
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        low, own = (keys & LOW).astype("<u4"), table.column("block")[0].as_py()
        rows = [(int(bucket[a]), own, low[a:b].tobytes(), np.packbits(n[a:b] > 1).tobytes()) for a, b in zip(*runs_of(bucket))]
        return pa.Table.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(ask_out)], schema=ask_out)

    reply_schema = T.StructType.fromDDL("block int, bucket int, shared binary")
    reply_out = arrow_schema(reply_schema)

    def compare(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(v, "<u4") for v in table.column("keys").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(v, np.uint8))[: len(p)].astype(np.int64) for v, p in zip(table.column("twice").to_pylist(), parts)]
        all_keys = np.concatenate(parts)
        order = np.argsort(all_keys, kind="stable")
        first, ends = runs_of(all_keys[order])
        n = np.add.reduceat(1 + np.concatenate(twice)[order], first)
        shared = np.empty(len(all_keys), bool)
        shared[order] = np.repeat(n > 1, ends - first)
        at = np.cumsum([0, *map(len, parts)])
        bits = [np.packbits(shared[a:b]).tobytes() for a, b in zip(at, at[1:])]
        return pa.Table.from_arrays([table.column("block").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(bits, pa.binary())], schema=reply_out)

    return x.groupBy("block").applyInArrow(ask, ask_schema).groupBy("bucket").applyInArrow(compare, reply_schema)


def known(own: list[np.ndarray], buckets: list[int], shared: list[bytes]) -> np.ndarray:
    """The keys of a block that other rows have too, sorted, from its keys and the answers to them."""
    keys = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
    marks = dict(zip(buckets, shared))
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    bits = [np.unpackbits(np.frombuffer(marks[int(bucket[a])], np.uint8))[: b - a] for a, b in zip(*runs_of(bucket))]
    return keys[np.concatenate(bits).astype(bool)] if bits else keys[:0]


def holds(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are among ``sorted_keys``."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys

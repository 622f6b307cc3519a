"""Helpers shared by the corpus operators: Arrow row mapping, byte tokens, hashing, stored tables.

Conventions of every operator here: a null text is an empty text; a column that an operator adds
replaces a column of the same name; rows are never dropped unless the operator's task is to drop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship  # noqa: F401  (re-used by the operators)
from ..sources.tables import materialize, read  # noqa: F401  (re-used by the operators)

#: The white space that splits words and that line keys are stripped of.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Rows that a task turns into one output batch; texts are long, so batches are kept small.
OUT_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def struct(fields: str) -> T.StructType:
    """A schema from "name kind, ..." without asking a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(","))])


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType, rows: int = OUT_ROWS) -> DataFrame:
    """``mapInArrow`` of a batch function, over batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, rows):
            yield fn(b)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def added(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    """``schema`` with columns put at its end; a column of the same name gives way."""
    return T.StructType([f for f in schema.fields if f.name not in kinds] + [T.StructField(k, v) for k, v in kinds.items()])


def with_columns(batch: pa.RecordBatch, schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    """The batch under ``schema``: the given columns, and its own for the rest."""
    out = []
    for f in schema:
        x = columns[f.name] if f.name in columns else batch.column(f.name)
        if not isinstance(x, pa.Array):
            x = pa.array(x, type=f.type)
        out.append(x if x.type == f.type else x.cast(f.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


# ---------------------------------------------------------------------------------------------
# 64-bit hashes of words and word windows, a whole batch of texts at a time.
# ---------------------------------------------------------------------------------------------
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LANES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                x = np.full(m, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))
        return self.up[:n], self.down[:n]


_POWERS = Powers()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the length of each word of ``text`` (runs of bytes that aren't white space), in order."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gap = _IS_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _POWERS.of(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), end - start


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word windows; of the whole sequence if it is shorter; none if it is empty."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    x = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        x += mix64(words[j : n - k + 1 + j] ^ _LANES[j]) * _LANES[j + 32]
    return mix64(x + np.uint64(k))


def blocked(x: DataFrame, id_name: str, size: Column, block_bytes: int) -> DataFrame:
    """``x`` with ``block``: rows dealt by a hash of their id into blocks of about ``block_bytes`` of ``size``."""
    total = x.agg(F.sum(size)).first()[0] or 0
    return x.withColumn("block", F.pmod(F.xxhash64(id_name), F.lit(max(1, -(-total // block_bytes)))).cast("int"))


def packed(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(id, text, block) with each text compressed, for the move to its block; and the bytes of all texts."""
    import zstandard

    x = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = x.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    x = x.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    schema = T.StructType([x.schema["id"], T.StructField("text", T.BinaryType()), T.StructField("block", T.IntegerType())])
    out = arrow_schema(schema)

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3).compress
        return with_columns(b, out, text=[press(t) for t in byte_texts(b.column("text"))])

    return map_arrow(x, pack, schema), total


def unpacked(table: pa.Table) -> list[bytes]:
    """The texts of a block's rows, from ``packed``."""
    import zstandard

    press = zstandard.ZstdDecompressor().decompress
    return [press(t) for t in table.column("text").to_pylist()]

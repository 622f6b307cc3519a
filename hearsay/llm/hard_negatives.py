"""Hard negatives by segment summary filtering.

Every vector of whole numbers is cut into segments, and each segment's mean and deviation (of length L: the norm
of its rest, sqrt(L) x standard deviation) are stored with it. Two segments' inner product is L times the product
of the means, plus or minus at most the product of the deviations, so the sums over segments bound the score.
Pairs that a bound over wide segments can't decide are bounded again over narrow ones, and only what is left gets
its exact score. Summaries of wide segments follow from those of the narrow ones.

An anchor's positives are its best rows of the same label. Its hard negatives for a positive are the best rows of
other labels whose score lies within a given share of the positive's. Anchors meet all rows, in blocks: rows are
dealt into blocks of bounded bytes, anchors into chunks, and each (block, chunk) is one group that returns a few
rows an anchor; the best of these follow from a window that is cut before its exchange.

Defined cases: rows with a null label, id or vector, or with a null or non-finite component take no part, nor do
those with a component of 2**20 and more in size (their scores needn't fit a long); of rows that share an id the
smallest (label, vector) counts; shorter vectors are filled up with zeros; ties go to the smaller id; a table
without anchors, positives or negatives gives no rows; further columns aren't read.

At scale: work is anchors x rows, as asked; each row moves once per chunk of anchors, each anchor once per block.
No label, key or cluster is gathered: blocks hold rows by a hash of their id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, map_arrow, materialize, ship, struct
from .vectors import firsts, matrix, numbers, one_each

WIDE, NARROW = 16, 4  # components of a segment, first and refined
BLOCK_BYTES = 8 << 20
BATCH = 1024  # rows bounded and scored at a time
LARGEST = 2.0**20

_LIST = T.ArrayType(T.LongType())
_REAL = T.ArrayType(T.DoubleType())
SUMMARY = T.StructType([*struct("id long, label long").fields, T.StructField("v", _LIST), T.StructField("mean", _REAL), T.StructField("dev", _REAL)])


def padded(width: int) -> int:
    return max(WIDE, -(-width // WIDE) * WIDE)


def summarise(v: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the rows' segments."""
    x = v.reshape(len(v), v.shape[1] // segment, segment)
    mean = x.mean(2)
    return mean, np.sqrt(((x - mean[:, :, None]) ** 2).sum(2))


def widened(mean: np.ndarray, dev: np.ndarray, times: int, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of segments ``times`` as long, from those of ``segment`` components."""
    m = mean.reshape(len(mean), mean.shape[1] // times, times)
    whole = m.mean(2)
    between = segment * ((m - whole[:, :, None]) ** 2).sum(2)
    return whole, np.sqrt((dev.reshape(m.shape) ** 2).sum(2) + between)


class Summaries:
    """A set of vectors with the summaries of both widths."""

    def __init__(self, table: pa.Table, width: int, order: bool = False) -> None:
        pick = np.argsort(numbers(table, "id")) if order else slice(None)
        self.id, self.label = numbers(table, "id")[pick], numbers(table, "label")[pick]
        self.v = matrix(table.column("v"), width)[pick]
        mean, dev = matrix(table.column("mean"), width // NARROW)[pick], matrix(table.column("dev"), width // NARROW)[pick]
        self.levels = [(WIDE, *widened(mean, dev, WIDE // NARROW, NARROW)), (NARROW, mean, dev)]

    def part(self, rows: np.ndarray | slice) -> Summaries:
        out = object.__new__(Summaries)
        out.id, out.label, out.v = self.id[rows], self.label[rows], self.v[rows]
        out.levels = [(n, m[rows], d[rows]) for n, m, d in self.levels]
        return out


def bounded_pairs(a: Summaries, b: Summaries, alive: np.ndarray, least: np.ndarray, most: np.ndarray | None) -> np.ndarray:
    """Of the pairs ``alive``, those whose score can be from ``least`` to ``most`` of their row, by ever narrower segments."""
    for (n, am, ad), (_, bm, bd) in zip(a.levels, b.levels):
        middle, spread = n * (am @ bm.T), ad @ bd.T
        spread += 1e-9 * (np.abs(middle) + spread) + 1e-6
        alive = alive & (middle + spread >= least[:, None])
        if most is not None:
            alive &= middle - spread <= most[:, None]
        if not alive.any():
            break
    return alive


def exact(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Whole inner products of the given pairs; in floating point where that is exact."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        if len(rows) * 4 > len(a) * len(b):
            return (a @ b.T)[rows, cols].astype(np.int64)
        return np.einsum("ij,ij->i", a[rows], b[cols]).astype(np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    return (a[rows] * b[cols]).sum(1)


def best_same(rows: Summaries, anchors: Summaries, k: int) -> tuple[np.ndarray, ...]:
    """(anchor's place, row's place, score) of the best ``k`` other rows of each anchor's label."""
    n = len(anchors.id)
    least = np.full(n, -np.inf)
    who, which, score = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(rows.id), BATCH):
        b = rows.part(slice(at, at + BATCH))
        alive = (anchors.label[:, None] == b.label) & (anchors.id[:, None] != b.id)
        i, j = np.nonzero(bounded_pairs(anchors, b, alive, least, None))
        who, which, score = np.concatenate([who, i]), np.concatenate([which, j + at]), np.concatenate([score, exact(anchors.v, b.v, i, j)])
        order = np.lexsort((which, -score, who))
        order = order[firsts(who[order], k)]
        who, which, score = who[order], which[order], score[order]
        full = np.bincount(who, minlength=n) >= k
        lowest = np.full(n, np.inf)
        np.minimum.at(lowest, who, score)
        least = np.where(full, lowest, -np.inf)
    return who, which, score


def best_within(rows: Summaries, anchors: Summaries, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(range's place, row's place, score): the best ``k`` rows of another label in each range low..high of its anchor's scores."""
    n, m = len(anchors.id), len(owner)
    cut = low.astype(np.float64)
    most = np.full(n, -np.inf)
    np.maximum.at(most, owner, high)
    slot = np.zeros(m, np.int64)
    order = np.argsort(owner, kind="stable")
    slot[order] = np.arange(m) - np.searchsorted(owner[order], owner[order])
    depth = int(slot.max(initial=-1)) + 1
    table = np.full((n, depth), -1)
    table[owner, slot] = np.arange(m)
    who, which, score = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(rows.id), BATCH):
        b = rows.part(slice(at, at + BATCH))
        least = np.full(n, np.inf)
        np.minimum.at(least, owner, cut)
        i, j = np.nonzero(bounded_pairs(anchors, b, anchors.label[:, None] != b.label, least, most))
        s = exact(anchors.v, b.v, i, j)
        found = [(who, which, score)]
        for d in range(depth):
            r = table[i, d]
            ok = (r >= 0) & (s >= cut[r]) & (s <= high[r])
            found.append((r[ok], j[ok] + at, s[ok]))
        who, which, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((which, -score, who))
        order = order[firsts(who[order], k)]
        who, which, score = who[order], which[order], score[order]
        full = np.bincount(who, minlength=m) >= k
        lowest = np.full(m, np.inf)
        np.minimum.at(lowest, who, score)
        cut = np.where(full, lowest, cut)
    return who, which, score


def summaries(table: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> tuple[DataFrame, int, int]:
    """The stored vectors with their segments' summaries, their padded width, and their number."""
    x = one_each(table.filter(F.col(label_col).isNotNull()).withColumn("label", F.col(label_col).cast("long")), id_col, vector_col, "label")
    x = x.filter(F.forall("v", lambda c: F.abs(c) < LARGEST))
    width, count = x.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    width = padded(width or 0)
    out = arrow_schema(SUMMARY)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        v = np.floor(scale * matrix(b.column("v"), width))
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
        mean, dev = summarise(v, NARROW)
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), lists(v.astype(np.int64)), lists(mean), lists(dev)], schema=out)

    return materialize(map_arrow(x, one, SUMMARY), "segment-summaries"), width, count


def meet(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int, fn, schema: T.StructType) -> DataFrame:
    """Every block of rows against every chunk of anchors, each pair a group of its own."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.withColumn("block", deal(blocks)).withColumn("chunk", every(chunks))
    right = anchors.withColumn("chunk", deal(chunks)).withColumn("block", every(blocks))
    ship(rows.sparkSession)
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(fn, schema)


def mine(
    table: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3,
    low_percent: int = 50, high_percent: int = 95, scale: int = 256, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor, positive and hard negative.

    ``is_anchor`` is a condition on the column ``id``; a negative's score lies from ``low_percent`` to ``high_percent`` of the positive's.
    """
    rows, width, count = summaries(table, id_col, vector_col, label_col, scale)
    spark = table.sparkSession
    anchors = rows.filter(is_anchor)
    size = width * 8 * 2
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-count * size // block_bytes))
    chunks = max(1, -(-anchors.count() * size // block_bytes))
    pair = struct("anchor_id long, positive_id long, positive_score long")
    pair_out = arrow_schema(pair)

    def same(left: pa.Table, right: pa.Table) -> pa.Table:
        r, a = Summaries(left, width, order=True), Summaries(right, width)
        who, which, score = best_same(r, a, positives)
        return pa.Table.from_arrays([pa.array(a.id[who]), pa.array(r.id[which]), pa.array(score)], schema=pair_out)

    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = meet(rows, anchors, blocks, chunks, same, pair).withColumn("p", F.row_number().over(order)).filter(F.col("p") <= positives)
    best = materialize(best.drop("p"), "positives")
    ranges = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = materialize(anchors.join(ranges, "id"), "anchors")
    found = struct("anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    found_out = arrow_schema(found)

    def other(left: pa.Table, right: pa.Table) -> pa.Table:
        r, a = Summaries(left, width, order=True), Summaries(right, width)
        lists = right.column("positives").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        positive, score = (lists.flatten().field(k).to_numpy() for k in range(2))
        low, high = -(-low_percent * score // 100), high_percent * score // 100
        who, which, s = best_within(r, a, owner, low, high, negatives)
        return pa.Table.from_arrays([pa.array(a.id[owner[who]]), pa.array(positive[who]), pa.array(score[who]), pa.array(r.id[which]), pa.array(s)], schema=found_out)

    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = meet(rows, asked, blocks, chunks, other, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def report(embeddings: DataFrame) -> DataFrame:
    """The query's rows; labels of every seventh id are moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", "embedding", moved.alias("label")), F.col("id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 3
"""

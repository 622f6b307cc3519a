"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised separately, each by its own small k-means; a row's cell is the pair of its
halves' centroids. A search pops centroid pairs from a heap in the order of their summed squared distances to the
query's halves (both lists sorted, a pair opens its two successors), reranks the entries of each popped cell by
their exact distances, and stops at the summed distance that no row nearer than the k-th found is expected to reach:
a row at distance t in direction u has a centroid pair c with |q-c|^2 <= r^2 + 2t <u, c-c0>, c0 being the query's nearest
pair, at distance r; in D components u leans towards c-c0 by ``margin`` / sqrt(D) at most, unless it is an outlier, and so
|q-c| <= r + 2t margin / sqrt(D). At a margin of sqrt(D) this is the triangle inequality, and the search exact; the
default's recall against brute force is in the README and tested. No number of cells or candidates is fixed.

In Spark the cells, in the order of their first centroid, are cut into blocks of rows of bounded size, a cell with
more rows over several. A query first searches the block of its nearest cell, which gives a k-th distance, and then
visits every block that holds a cell this distance doesn't rule out; the best of all blocks are its answer.

Defined cases: rows whose vector or id is null, whose vector is zero or holds a null or non-finite component take no part,
neither as queries nor as candidates; of rows that share an id the smallest vector counts; shorter vectors are
filled up with zeros; equal distances go to the smaller id; with fewer than k other rows all are returned; an empty
table has no rows; further columns aren't read.

At scale: the quantisers are fitted on a bounded sample of ``SAMPLE`` rows or ``SAMPLE_BYTES`` (documented parameters,
taken by a hash of the id); every row is indexed. Centroids, and the counts of at most ``MOST_CENTROIDS`` ** 2 cells, are
all that the driver holds. Rows move once to their block, queries to the blocks they can gain from.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, map_arrow, materialize, ship, struct
from .vectors import matrix, numbers, one_each

SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
CELL_ROWS = 64  # rows a cell holds on average, as long as there are few enough centroids
MOST_CENTROIDS = 256
BLOCK_BYTES = 4 << 20
MARGIN = 0.75
ROUNDS = 12

ROW = T.StructType([*struct("id long, cell int, block int").fields, T.StructField("v", T.ArrayType(T.DoubleType()))])


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T), 0)


def centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means from distinct random rows; a centroid without rows stays."""
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        near = squares(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Index:
    """The quantisers of both halves, and the layout of cells over blocks."""

    def __init__(self, sample: np.ndarray, k: int, margin: float, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.width, self.margin = sample.shape[1], margin
        self.half = (self.width + 1) // 2
        self.books = [centroids(sample[:, : self.half], k, rng), centroids(sample[:, self.half :], k, rng)]
        self.shape = tuple(len(b) for b in self.books)
        self.first = self.splits = np.zeros(0, np.int64)
        self.blocks = 1

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squares(x[:, : self.half], self.books[0]), squares(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.shape[1] + b.argmin(1)

    def lay_out(self, counts: np.ndarray, block_rows: int) -> None:
        """Cells in order, cut into blocks of ``block_rows``; a cell of more rows takes several blocks of its own."""
        self.counts = counts
        self.splits = np.maximum(1, -(-counts // block_rows))
        self.first = np.zeros(len(counts), np.int64)
        block, rows = 0, 0
        for c, (n, parts) in enumerate(zip(counts.tolist(), self.splits.tolist())):
            if rows and (parts > 1 or rows + n > block_rows):
                block, rows = block + 1, 0
            self.first[c] = block
            if parts > 1:
                block, rows = block + parts, 0
            else:
                rows += n
        self.blocks = block + 1

    def limit(self, nearest: float, furthest: float) -> float:
        """The summed distance of cells up to which rows within ``furthest`` (squared) are expected; ``nearest`` is the least there is."""
        return (nearest**0.5 + 2 * self.margin * (furthest / self.width) ** 0.5) ** 2 if np.isfinite(furthest) else np.inf

    def visits(self, q: np.ndarray, furthest: np.ndarray) -> list[np.ndarray]:
        """The blocks that each query can gain from."""
        a, b = self.distances(q)
        full = self.counts > 0
        ahead = np.concatenate([np.arange(f, f + s) for f, s in zip(self.first, self.splits)])
        owner = np.repeat(np.arange(len(self.first)), self.splits)
        out = []
        for x, y, far in zip(a, b, furthest):
            s = (x[:, None] + y).ravel()
            ok = full & (s <= self.limit(s.min(), far))
            out.append(np.unique(ahead[ok[owner]]))
        return out


def search(index: Index, ids: np.ndarray, v: np.ndarray, cells: np.ndarray, q_ids: np.ndarray, q: np.ndarray, furthest: np.ndarray, k: int):
    """(query's place, row's id, squared distance): the best ``k`` of a block's rows for each query, popping cells by summed distance."""
    order = np.lexsort((ids, cells))
    ids, v, cells = ids[order], v[order], cells[order]
    present, start = np.unique(cells, return_index=True)
    end = np.append(start[1:], len(cells))
    span = dict(zip(present.tolist(), zip(start.tolist(), end.tolist())))
    firsts, seconds = np.unique(present // index.shape[1]), np.unique(present % index.shape[1])
    da, db = index.distances(q)
    out = []
    for n in range(len(q)):
        xs, ys = da[n, firsts], db[n, seconds]
        oa, ob = xs.argsort(), ys.argsort()
        xs, ys = xs[oa].tolist(), ys[ob].tolist()
        rows_of, cols_of = (firsts[oa] * index.shape[1]).tolist(), seconds[ob].tolist()
        heap, opened = [(xs[0] + ys[0], 0, 0)], {(0, 0)}
        far = float(furthest[n])
        nearest = float(da[n].min() + db[n].min())
        stop = index.limit(nearest, far)
        best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
        taken: list[np.ndarray] = []
        waiting = 0
        while heap or taken:
            s, i, j = heapq.heappop(heap) if heap else (np.inf, -1, -1)
            if taken and (s > stop or i < 0 or waiting >= 256):  # rerank what the popped cells hold
                rows = np.concatenate(taken)
                taken, waiting = [], 0
                rows = rows[ids[rows] != q_ids[n]]
                gap = v[rows] - q[n]
                best_d, best_i = np.append(best_d, (gap * gap).sum(1)), np.append(best_i, ids[rows])
                pick = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[pick], best_i[pick]
                if len(best_d) == k and best_d[-1] < far:
                    far = float(best_d[-1])
                    stop = index.limit(nearest, far)
            if s > stop or i < 0:
                break
            got = span.get(rows_of[i] + cols_of[j])
            if got:
                taken.append(np.arange(*got))
                waiting += got[1] - got[0]
            for nxt in ((i + 1, j), (i, j + 1)):
                if nxt[0] < len(xs) and nxt[1] < len(ys) and nxt not in opened:
                    opened.add(nxt)
                    heapq.heappush(heap, (xs[nxt[0]] + ys[nxt[1]], *nxt))
        out.append((np.full(len(best_i), n), best_i, best_d))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def build(table: DataFrame, id_col: str, vector_col: str, margin: float, block_bytes: int) -> tuple[DataFrame, Index | None]:
    """The written index, (id, cell, block, v) of every usable row, and its quantisers."""
    x = materialize(one_each(table, id_col, vector_col).filter(F.exists("v", lambda c: c != 0)), "vectors")
    width, count = x.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    if not count:
        return x, None
    rows = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    sample = x.orderBy(F.xxhash64("id"), "id").limit(rows).select("v").toArrow().column("v")
    k = int(max(1, min(MOST_CENTROIDS, round((count / CELL_ROWS) ** 0.5))))
    index = Index(matrix(sample, width), k, margin)
    schema = T.StructType([f for f in ROW if f.name != "block"])
    out, laid = arrow_schema(schema), arrow_schema(ROW)

    def assign(b: pa.RecordBatch) -> pa.RecordBatch:
        m = matrix(b.column("v"), width)
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array(index.cells(m), pa.int32()), b.column("v")], schema=out)

    assigned = materialize(map_arrow(x, assign, schema), "vector-cells")
    counts = np.zeros(index.shape[0] * index.shape[1], np.int64)
    for r in assigned.groupBy("cell").count().toLocalIterator():
        counts[r["cell"]] = r["count"]
    spread = 2 * table.sparkSession.sparkContext.defaultParallelism
    index.lay_out(counts, max(1, min(block_bytes // (8 * width), -(-count // spread))))

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        cell, key = b.column("cell").to_numpy(), b.column("key").to_numpy()
        block = index.first[cell] + key % index.splits[cell]
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("cell"), pa.array(block, pa.int32()), b.column("v")], schema=laid)

    keyed = assigned.withColumn("key", F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1)))
    return map_arrow(keyed, place, ROW), index


def neighbours(
    table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", margin: float = MARGIN, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the ``k`` nearest found of each row with ``is_query`` (a condition on ``id``)."""
    spark = table.sparkSession
    result = struct("query_id long, vec_id long, score double")
    rows, index = build(table, id_col, vector_col, margin, block_bytes)
    if index is None:
        return spark.createDataFrame([], struct("query_id long, rank int, vec_id long, score double"))
    rows = materialize(rows, "multi-index")
    width, out = index.width, arrow_schema(result)
    visit = T.StructType([*struct("id long, far double, block int").fields, ROW["v"]])
    visit_out = arrow_schema(visit)

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids = numbers(right, "id")
        who, which, d = search(
            index, numbers(left, "id"), matrix(left.column("v"), width), numbers(left, "cell"), q_ids, matrix(right.column("v"), width), numbers(right, "far"), k
        ) if left.num_rows and right.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.Table.from_arrays([pa.array(q_ids[who]), pa.array(which), pa.array(np.sqrt(d))], schema=out)

    def route(b: pa.RecordBatch) -> pa.RecordBatch:
        far = b.column("far").to_numpy()
        blocks = index.visits(matrix(b.column("v"), width), far * far)
        at = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in blocks]))
        place = pa.array(np.concatenate([*blocks, np.zeros(0, np.int64)]), pa.int32())
        return pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array(far * far).take(at), place, b.column("v").take(at)], schema=visit_out)

    ship(spark)
    queries = rows.filter(is_query).withColumn("far", F.lit(float("inf")))
    home = rows.groupBy("block").cogroup(queries.groupBy("block")).applyInArrow(look, result)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    reach = materialize(home.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("far")), "reach")
    known = queries.drop("far").join(reach, "id", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
    visits = map_arrow(known.select("id", "far", "v"), route, visit, rows=256)
    found = rows.groupBy("block").cogroup(visits.groupBy("block")).applyInArrow(look, result)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    """The query's rows: the ten nearest rows found of every hundredth id."""
    return neighbours(embeddings, F.col("id") % 100 == 0)

"""Issue clusters from the posts themselves (C7-C9): tf-idf vectors, a stored model, every post assigned.

``fit`` is K-Means in whole numbers: vectors are tf-idf weights in units of 1/10000, centres are means in a
hundredth of that unit, so sums are exact in any order and the same input gives the same model on any number of
machines (and in SQL). Equal vectors are one row with a count, so that a title posted a million times costs one
distance. The first centre is the most frequent vector, each further one the vector that is furthest from the
chosen ones, weighted by its count; rounds of assignment and means follow until nothing moves, ``ROUNDS`` at most.

A model is a table of centres (cluster_id, idx, term, weight), k x vocabulary rows at most, which is all that
ever reaches the driver. Tasks take vectors in Arrow batches, whose flat arrays numpy multiplies with the centres in
64-bit whole numbers; a round is one pass that returns a batch's sums. Assignment is such a pass too: no shuffle.
``kmeans_model`` fits the same kind of model with ``pyspark.ml`` on sparse vectors, the best of several seeds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from ..sources.tables import materialize
from . import topics as tp

WEIGHT = 10_000
SCALE = 100
ROUNDS = 6
CENTRES = "cluster_id int, idx int, term string, weight long"


def vocabulary(tokens: DataFrame, max_features: int = 200, min_df: int = 2) -> DataFrame:
    """(term, df, n, idf, idx) of the corpus's vocabulary; idx is the term's place in alphabetical order."""
    vocab = tp.vocabulary(tokens, None, max_features, min_df, None)
    return vocab.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def vectors(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, idx, w) of every post (a row each); a post without a term of the vocabulary has an empty vector.

    The vocabulary goes with the tasks, which count its terms in Arrow batches where the documents lie: no term is a row.
    """
    ship(tokens.sparkSession)
    weigh = _weigher([(r["term"], r["idf"]) for r in vocab.select("idx", "term", "idf").orderBy("idx").collect()])  # as many as the vocabulary may have

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, idx, raw, norm = weigh(b)
            w = raw / norm[own] * WEIGHT
            whole = np.floor(w)
            whole += w - whole >= 0.5
            yield pa.RecordBatch.from_arrays([b.column("id"), _lists(own, idx, pa.list_(pa.int32()), b.num_rows), _lists(own, whole, pa.list_(pa.int64()), b.num_rows)], ["id", "idx", "w"])

    return tokens.select("id", "toks").mapInArrow(counted, "id string, idx array<int>, w array<bigint>")


def _lists(own: np.ndarray, values: np.ndarray, kind: pa.ListType, n: int) -> pa.ListArray:
    """The values of each of ``n`` vectors, which lie together, as a list."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(kind.value_type.to_pandas_dtype()), kind.value_type), type=kind)


def _weigher(terms: list[tuple[str, float]]) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A function of a batch's token arrays: of each (post, term) the post's row, the term's place and tf x idf; and each post's norm."""
    idf, size = np.array([f for _, f in terms], float), max(1, len(terms))
    words = pa.array([t for t, _ in terms], pa.string())
    pairs = [(t.split(" ", 1), i) for i, (t, _) in enumerate(terms) if " " in t]  # words hold no space
    parts = sorted({w for p, _ in pairs for w in p})
    place = {w: i for i, w in enumerate(parts)}
    known = sorted((place[a] * len(parts) + place[b], i) for (a, b), i in pairs)
    keys, key_idx = (np.array([k[j] for k in known], np.int64) for j in (0, 1))
    parts = pa.array(parts, pa.string())

    def places(names: pa.Array, values: pa.Array) -> np.ndarray:
        """The place of each name among the values, else -1; one more for no name."""
        return np.append(pc.index_in(names, value_set=values).fill_null(-1).to_numpy(zero_copy_only=False), -1).astype(np.int64)

    def weigh(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lists = b.column("toks")
        toks, owner = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy()
        code, names = toks.indices.fill_null(-1).to_numpy(zero_copy_only=False), toks.dictionary
        word, part = places(names, words)[code], places(names, parts)[code]
        near = np.flatnonzero((owner[:-1] == owner[1:]) & (part[:-1] >= 0) & (part[1:] >= 0))
        key = part[near] * len(parts) + part[near + 1]
        at = np.searchsorted(keys, key)
        told = at < len(keys)
        told[told] = keys[at[told]] == key[told]
        found = np.concatenate([owner[word >= 0] * size + word[word >= 0], owner[near[told]] * size + key_idx[at[told]]])
        entry, tf = np.unique(found, return_counts=True)
        own, idx = entry // size, entry % size
        raw = tf * idf[idx]
        return own, idx, raw, np.sqrt(np.bincount(own, raw * raw, b.num_rows))

    return weigh


def vector_key() -> Column:
    return F.concat(F.array_join("idx", ","), F.lit("|"), F.array_join("w", ","))


def _matrix(centres: list[dict[int, int]], size: int) -> np.ndarray:
    out = np.zeros((len(centres), size), np.int64)
    for j, c in enumerate(centres):
        for i, w in c.items():
            out[j, i] = w
    return out


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's vectors end to end: the vector of each entry, its place and its weight."""
    idx, w = batch.column("idx"), batch.column("w")
    owner = np.repeat(np.arange(batch.num_rows), np.diff(idx.offsets.to_numpy()))
    return owner, idx.flatten().to_numpy().astype(np.int64), w.flatten().to_numpy().astype(np.int64)


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of each vector's values, which lie together."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return np.diff(upto[np.searchsorted(owner, np.arange(n + 1))])


def _nearest(batch: pa.RecordBatch, matrix: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each vector; of equally near ones the first."""
    owner, idx, w = _flat(batch)
    scores = [2 * SCALE * _sums(owner, w * c[idx], batch.num_rows) - (c * c).sum() for c in matrix]
    return np.argmax(np.stack(scores), axis=0)


def _furthest(rows: DataFrame, chosen: list[dict[int, int]], size: int) -> dict[int, int]:
    """The vector of the largest count x squared distance to the nearest chosen one; each batch names its own."""
    matrix = _matrix(chosen, size)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            owner, idx, w = _flat(b)
            own = _sums(owner, w * w, b.num_rows)
            gap = np.min(np.stack([own + (c * c).sum() - 2 * _sums(owner, w * c[idx], b.num_rows) for c in matrix]), axis=0)
            far = gap * b.column("n").to_numpy()
            first = min(np.flatnonzero(far == far.max()).tolist(), key=lambda i: b.column("key")[i].as_py())
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, 1) for c in ("idx", "w", "key")), pa.array([int(far[first])], pa.int64())], ["idx", "w", "key", "far"])

    found = rows.select("idx", "w", "n", "key").mapInArrow(best, "idx array<int>, w array<bigint>, key string, far long")
    top = found.orderBy(F.desc("far"), "key").first()
    return dict(zip(top["idx"], top["w"]))


def _first_centres(rows: DataFrame, k: int, size: int) -> list[dict[int, int]]:
    """k vectors far from one another: the most frequent one, then ever the one of the largest count x squared distance."""
    first = rows.orderBy(F.desc("n"), "key").first()
    chosen = [dict(zip(first["idx"], first["w"]))]
    while len(chosen) < k:
        chosen.append(_furthest(rows, chosen, size))
    return [{i: SCALE * w for i, w in c.items()} for c in chosen]


def _totals(rows: DataFrame, centres: list[dict[int, int]], size: int) -> list:
    """(cluster, idx, s) rows: each cluster's sum of counted weights by place, its number of vectors under idx null."""
    matrix = _matrix(centres, size)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(matrix), np.zeros(len(matrix), np.int64)
        for b in (b for b in batches if b.num_rows):
            own, n = _nearest(b, matrix), b.column("n").to_numpy()
            owner, idx, w = _flat(b)
            np.add.at(sums, (own[owner], idx), n[owner] * w)
            np.add.at(counts, own, n)
        at, (j, i) = np.flatnonzero(counts), np.nonzero(sums)
        place = pa.array([None] * len(at) + i.tolist(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, j]), pa.int32()), place, pa.array(np.concatenate([counts[at], sums[j, i]]), pa.int64())], ["cluster", "idx", "s"])

    found = rows.select("idx", "w", "n").mapInArrow(part, "cluster int, idx int, s long")
    return found.groupBy("cluster", "idx").agg(F.sum("s").alias("s")).collect()


def fit(vecs: DataFrame, vocab: DataFrame, k: int = 7, rounds: int = ROUNDS) -> DataFrame:
    """The model's centres. Fewer posts than ``k``: max(2, posts // 10) clusters."""
    spark = vecs.sparkSession
    ship(spark)
    terms = {r["idx"]: r["term"] for r in vocab.select("idx", "term").collect()}  # as many as the vocabulary may have
    size = max(1, len(terms))
    rows = materialize(vecs.groupBy("idx", "w").agg(F.count(F.lit(1)).alias("n")).withColumn("key", vector_key()), "distinct-vectors")
    n = rows.agg(F.sum("n")).first()[0] or 0
    if not n:
        return spark.createDataFrame([], CENTRES)
    centres = _first_centres(rows, k if n >= k else max(2, n // 10), size)
    for _ in range(rounds - 1):
        totals = _totals(rows, centres, size)
        counts = {r["cluster"]: r["s"] for r in totals if r["idx"] is None}
        moved: list[dict[int, int]] = [{} if j in counts else c for j, c in enumerate(centres)]
        for r in totals:
            if r["idx"] is not None:
                moved[r["cluster"]][r["idx"]] = SCALE * r["s"] // counts[r["cluster"]]
        moved = [{i: w for i, w in c.items() if w} for c in moved]
        if moved == centres:
            break
        centres = moved
    data = [(j, i, terms[i], w) for j, c in enumerate(centres) for i, w in c.items()] + [(j, None, None, 0) for j, c in enumerate(centres) if not c]
    # As an Arrow table: rows made in Python would start workers for it.
    columns = [pa.array([r[i] for r in data], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64()))]
    return spark.createDataFrame(pa.table(columns, [f.split()[0] for f in CENTRES.split(", ")]))


def load(model: DataFrame) -> list[dict[int, int]]:
    """The centres of a stored model, in the order of their numbers."""
    rows = model.collect()
    out: list[dict[int, int]] = [{} for _ in range(max((r["cluster_id"] for r in rows), default=-1) + 1)]
    for r in rows:
        if r["idx"] is not None:
            out[r["cluster_id"]][r["idx"]] = r["weight"]
    return out


def assign(vecs: DataFrame, model: DataFrame, size: int) -> DataFrame:
    """(id, cluster_id) of every vector by the stored centres."""
    centres = load(model)
    if not centres:
        return vecs.select("id", F.lit(0).alias("cluster_id")).limit(0)
    ship(vecs.sparkSession)
    matrix = _matrix(centres, max(1, size))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_nearest(b, matrix), pa.int32())], ["id", "cluster_id"])

    return vecs.select("id", "idx", "w").mapInArrow(placed, "id string, cluster_id int")


def centre_keywords(model: DataFrame, k: int = 5) -> DataFrame:
    """The heaviest ``k`` terms of each centre (cluster_id, keywords)."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("weight"), "term")
    top = model.filter(F.col("weight") > 0).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    return top.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("r", "term"))).alias("t")).select(
        "cluster_id", F.transform("t", lambda s: s["term"]).alias("keywords"))


def features(tokens: DataFrame, terms: list[tuple[str, float]]) -> DataFrame:
    """(id, features) of every post: a ``pyspark.ml`` sparse vector of its tf-idf weights, counted as in ``vectors``."""
    from pyspark.ml.linalg import VectorUDT

    ship(tokens.sparkSession)
    weigh, size = _weigher(terms), max(1, len(terms))
    fields = to_arrow_schema(VectorUDT.sqlType())
    kinds = fields.field("indices").type, fields.field("values").type

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, idx, raw, norm = weigh(b)
            same = lambda v, kind: pa.array(np.full(b.num_rows, v), kind)
            columns = [same(0, pa.int8()), same(size, pa.int32()), _lists(own, idx, kinds[0], b.num_rows), _lists(own, raw / norm[own], kinds[1], b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.StructArray.from_arrays(columns, fields=list(fields))], ["id", "features"])

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("features", VectorUDT())])
    return tokens.select("id", "toks").mapInArrow(counted, schema)


def kmeans_model(tokens: DataFrame, k: int = 7, seeds: range = range(42, 52), max_features: int = 200) -> tuple[DataFrame, DataFrame]:
    """C7 with ``pyspark.ml``: sparse tf-idf, K-Means, the least cost of ``seeds``; (centres, assignment of every post)."""
    from pyspark.ml.clustering import KMeans

    spark: SparkSession = tokens.sparkSession
    n = tokens.count()
    if n < 2:
        return spark.createDataFrame([], CENTRES), tokens.select("id", F.lit(0).alias("cluster_id"))
    # The vocabulary that a pass over all bigrams would find, without counting those that can't reach it.
    terms = [(r["term"], r["idf"]) for r in tp.vocabulary(tokens, None, max_features).collect()]
    data = materialize(features(tokens, terms), "features")
    # Equal vectors are one weighted point: most posts share one of a few texts, and every round of every seed visits each point.
    points = materialize(data.groupBy("features").agg(F.count(F.lit(1)).cast("double").alias("weight")), "distinct-features")
    best = None
    for seed in seeds:
        model = KMeans(k=k if n >= k else max(2, n // 10), seed=seed, maxIter=300, weightCol="weight").fit(points)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    rows = [(j, i, terms[i][0], round(float(w) * WEIGHT * SCALE)) for j, c in enumerate(best.clusterCenters()) for i, w in enumerate(c) if w]
    return spark.createDataFrame(rows, CENTRES), best.transform(data).select("id", F.col("prediction").alias("cluster_id"))

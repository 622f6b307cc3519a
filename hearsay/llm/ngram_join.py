"""N-gram Jaccard join: documents are linked where their sets of word shingles are similar enough.

Sets are rows of a sparse document by n-gram matrix. Shingles have one order for all documents (longest
first, then by hash: long shingles are rare), and a set's first columns are its prefix. Two sets that
are linked have many common columns among their prefixes, how many follows from their sizes. So:

1. Blocks of documents send the hashes of their prefixes (n - ceil(t n) + ceil(n / 4) columns) once a
   block; columns that only one document has are marked, and a document whose prefix has fewer shared
   columns than any linked set leaves it (``common_in_prefixes``) goes: it can't reach the bound with any other.
2. Equal sets become one row, named by their smallest id.
3. Rows are gathered by connected components over keys: the runs of ``RUN`` columns that follow each other, in
   the order with columns found frequent last. Linked sets differ in few columns, so a run of common ones
   stands early in both (``gathering_keys``); sets that only share a passage have such a run by chance alone.
4. In each, the matrix product of the rows' whole sets is accumulated block by block: columns of few rows by
   their pairs, columns of many rows as dense products. Pairs whose overlap is below the bound derived
   from their sizes go; the links that remain are reduced to a forest before they leave the task.
5. Components of these links, named by the smallest id, are the result.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing;
fewer words than a shingle: the whole sequence is one shingle; rows that share an id are one node of the
links, each row with its own set size; a null id has no component of its own: such a row gets the smallest
id linked to it by an equal set, or null; ties don't matter, for links are symmetric.

At scale: texts move once, to their block (an exchange that is re-used); a hash moves once a block. No
task gets a group by key: groups of more than ``ROWS`` rows are cut into blocks and each pair of
blocks is a task's work. That work is quadratic in a group of near copies that aren't equal, as any
exact join's is; its output and memory aren't.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, map_arrow, materialize, packed, shingle_hashes, ship, unpacked, word_hashes
from .components import components
from .shared_keys import answers, bucket_bits, bucket_keys, holds, known

BLOCK_BYTES = 8 << 20
#: Columns in a run, for similarities of RUN_PERCENT and more (below it, runs needn't exist: single columns).
RUN, RUN_PERCENT = 3, 75
#: Rows of a group that are multiplied at a time; columns of a dense product; rows from which a column is dense.
ROWS, COLUMNS, DENSE = 1024, 4096, 48
#: Columns held to be frequent: rows that have one in batches of so many rows, and how many columns at most (1.6 MB).
FREQUENT, FREQUENT_BATCH, FREQUENT_COLUMNS = 4, 2000, 200_000


def shingles(text: bytes, k: int) -> np.ndarray:
    """The set of ``k``-word shingles as sorted numbers: 8 bits of length, longest first, then 56 bits of hash."""
    h, n = word_hashes(text.lower())
    if not len(h):
        return h
    s = shingle_hashes(h, k)
    total = np.concatenate([[0], np.cumsum(n)])
    k = min(k, len(n))
    size = np.minimum(total[k:] - total[:-k], 255).astype(np.uint64)
    return np.unique(((np.uint64(255) - size) << np.uint64(56)) | (s >> np.uint64(8)))


def needed(n: int, percent: int) -> int:
    """The least overlap that a set of n columns has with any set it is linked to."""
    return -(-n * percent // 100)


def quarter(n: int) -> int:
    return -(-n // 4)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - needed(n, percent) + quarter(n))


@lru_cache(1 << 16)
def guaranteed(n: int, percent: int) -> int:
    """Of the columns that a set of n has in common with any set it is linked to, the first so many are in the other's prefix.

    With m columns in the other set and i common ones at least, m - i columns of the other's prefix at most are its own.
    So a column common to both that is among a set's first ``guaranteed(n)`` ones is in the other's prefix too.
    """
    m = np.arange(needed(n, percent), n * 100 // percent + 1)
    common = -(-percent * (n + m) // (100 + percent))
    prefix = np.minimum(m, m + (-m * percent // 100) - (-m // 4))
    return int((prefix - m + common).min())


def common_in_prefixes(n: int, percent: int) -> int:
    """The least number of a set's prefix columns that are in the prefix of any set it is linked to, small ones included: of
    the common columns, its own prefix has the first quarter(n) at least."""
    return min(quarter(n), guaranteed(n, percent))


def may_be_shared(marks: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Which of a set's n columns a linked set may have. A mark tells whether a column is in another row's prefix, not
    whether it is in its set: without a mark, only the first ``guaranteed`` columns are known to be in no linked set."""
    out = np.ones(n, bool)
    first = guaranteed(n, percent)
    out[:first] = marks[:first]
    return out


def gathering_keys(columns: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set in its order, of which linked sets have one in common; ``shared``: columns that another set may have.

    Let i columns be common to two linked sets and d be in one of them only: d <= i (1 - t) / t. Each run of fewer
    than r common columns ends at one of the d, so a run of r is complete after (r - 1) d + r common columns, if there
    are as many. In a set of n that is within r (1 - t) n + r columns. Sets so small that i may be less send single
    columns of their short prefix too.
    """
    n, r = len(columns), RUN if percent >= RUN_PERCENT else 1
    enough = -(-r * percent // (percent - (r - 1) * (100 - percent)))
    out = []
    if r > 1 and n >= r:
        end = min(n, r * (100 - percent) * n // 100 + r)
        common = np.lib.stride_tricks.sliding_window_view(shared[:end], r).all(axis=1)
        out.append(shingle_hashes(columns[:end], r)[common])
    if r == 1 or n * percent < 100 * enough:
        short = n - needed(n, percent) + 1
        out.append(columns[:short][shared[:short]])
    return np.concatenate(out) if out else columns[:0]


def block_sets(table: pa.Table, k: int, percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each text's set and long prefix."""
    sets = [shingles(t, k) for t in unpacked(table)]
    return sets, [s[: prefix_length(len(s), percent)] for s in sets]


def surviving_sets(x: DataFrame, bits: int, k: int, percent: int) -> DataFrame:
    """(id, n, d1, d2, columns, marks): size and digest of the set; its columns, and which of its long prefix other
    rows have too (a bit each), where it may be linked to another one."""
    def keys_of(table: pa.Table) -> list[np.ndarray]:
        return [bucket_keys(p, bits) for p in block_sets(table, k, percent)[1]]

    set_schema = T.StructType([x.schema["id"], *T.StructType.fromDDL("n long, d1 long, d2 long, columns binary, marks binary").fields])
    set_out = arrow_schema(set_schema)

    def answer(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return set_out.empty_table()
        sets, prefixes = block_sets(table, k, percent)
        own = [bucket_keys(p, bits) for p in prefixes]
        shared = known(own, reply.column("bucket").to_pylist(), reply.column("shared").to_pylist())
        n, d, cols, marks = [], [], [], []
        for s, p in zip(sets, own):
            mark = holds(shared, p)
            stays = len(s) and int(mark.sum()) >= common_in_prefixes(len(s), percent)
            raw = s.astype("<u8").tobytes()
            n.append(len(s))
            d.append(xxhash.xxh3_128_digest(raw))
            cols.append(raw if stays else None)
            marks.append(np.packbits(mark).tobytes() if stays else None)
        d = np.frombuffer(b"".join(d), "<i8").reshape(-1, 2)
        return pa.Table.from_arrays([table.column("id").combine_chunks().cast(set_out.field(0).type), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(cols, pa.binary()), pa.array(marks, pa.binary())], schema=set_out)

    replies = answers(x, keys_of)
    return x.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(answer, set_schema)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the number of the first one that it is connected to by links, by blocked matrix products."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(m), n)
    order = np.argsort(np.concatenate(sets), kind="stable")
    col, row = np.concatenate(sets)[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
    df = np.diff(np.append(first, len(col)))
    overlap = np.zeros((m, m), np.float32)  # whole numbers below 2**24 are exact
    for k in np.unique(df[(df > 1) & (df < DENSE)]):
        starts = first[df == k]
        for j in range(0, len(starts), 1 << 15):
            rows = row[starts[j : j + (1 << 15), None] + np.arange(k)]
            for a in range(k):
                for b in range(a + 1, k):  # rows ascend within a column
                    np.add.at(overlap, (rows[:, a], rows[:, b]), 1) if len(rows) < 64 else _count(overlap, rows[:, a], rows[:, b])
    heavy = np.flatnonzero(df >= DENSE)
    for j in range(0, len(heavy), COLUMNS):
        part = heavy[j : j + COLUMNS]
        dense = np.zeros((m, len(part)), np.float32)
        for c, h in enumerate(part):
            dense[row[first[h] : first[h] + df[h]], c] = 1
        overlap += np.triu(dense @ dense.T, 1)
    least = percent * (n[:, None] + n[None, :])
    link = np.triu(overlap.astype(np.int64) * (100 + percent) >= least, 1)
    link |= link.T
    root = np.full(m, -1, np.int64)
    for k in range(m):
        if root[k] < 0:
            root[k] = k
            edge = np.array([k])
            while len(edge):
                edge = np.flatnonzero(link[edge].any(axis=0) & (root < 0))
                root[edge] = k
    return root


def _count(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    m = len(overlap)
    key, n = np.unique(a * m + b, return_counts=True)
    overlap.reshape(-1)[key] += n.astype(np.float32)


def frequent_columns(sets: DataFrame) -> np.ndarray:
    """Columns that many of the sets have, sorted: two of a batch's rows or more, and ``FREQUENT`` such rows in all.

    They come last in the order of columns. Any list gives the same links; with this one, a passage in many
    documents doesn't gather them. So its length may be bounded: FREQUENT_COLUMNS, the most frequent.
    """
    schema = T.StructType.fromDDL("column long, n long")
    out = arrow_schema(schema)

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = b"".join({*b.column(0).to_pylist()})  # equal sets count once
        keys, n = np.unique(np.frombuffer(raw, "<u8"), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view("<i8")), pa.array(n[n > 1].astype(np.int64))], schema=out)

    seen = map_arrow(sets.select("columns"), count, schema, rows=FREQUENT_BATCH).groupBy("column").agg(F.sum("n").alias("n"))
    most = seen.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "column").limit(FREQUENT_COLUMNS).collect()
    return np.sort(np.array([r[0] for r in most], np.int64).view(np.uint64))


def links(sets: DataFrame, same: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect what is linked among the sets (id, d1, d2, columns, marks); of equal ones the named one is compared."""
    frequent = frequent_columns(sets)
    prefix_schema = T.StructType([T.StructField("column", T.LongType()), sets.schema["id"]])
    prefix_out = arrow_schema(prefix_schema)

    def keys(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = []
        for raw, marks in zip(b.column("columns").to_pylist(), b.column("marks").to_pylist()):
            c = np.frombuffer(raw, "<u8")
            shared = may_be_shared(np.unpackbits(np.frombuffer(marks, np.uint8)), len(c), percent)
            order = np.argsort(holds(frequent, c), kind="stable")
            cols.append(gathering_keys(c[order], shared[order], percent))
        at = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
        flat = np.concatenate([c.view("<i8") for c in cols]) if cols else np.zeros(0, "<i8")
        return pa.RecordBatch.from_arrays([pa.array(flat), b.column("id").take(pa.array(at, pa.int64()))], schema=prefix_out)

    columns = map_arrow(sets, keys, prefix_schema)
    least = columns.groupBy("column").agg(F.min("id").alias("b"), F.max("id").alias("most")).filter(F.col("b") < F.col("most"))
    least = materialize(least.select("column", "b"), "column-minima")
    near = columns.join(least, "column").select(F.col("id").alias("a"), "b").filter(F.col("a") != F.col("b")).distinct()
    groups = components(near)
    # Whole sets move once to meet their group: a narrow table says which rows, and where they go.
    names = sets.select("id", "d1", "d2").join(same, ["d1", "d2"]).filter(F.col("id") == F.col("rep")).select("id").distinct()
    plan = materialize(names.join(groups, names["id"] == groups["node"]).select("id", "component"), "groups")
    size = plan.groupBy("component").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    plan = plan.join(size, "component")
    cuts = F.ceil(F.col("rows") / ROWS).cast("int")
    dealt = (
        sets.select("id", "columns").join(plan, "id")
        .withColumn("cuts", cuts).withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
        # a block meets every block of its group: pair (i, j), i <= j; a group of one block is pair (0, 0)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .filter((F.col("cuts") == 1) | (F.col("own") != F.col("other")))
        .select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "columns")
    )
    edge_schema = T.StructType([T.StructField("a", sets.schema["id"].dataType), T.StructField("b", sets.schema["id"].dataType)])
    edge_out = arrow_schema(edge_schema)

    def multiply(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        root = linked([np.frombuffer(c, "<u8") for c in table.column("columns").to_pylist()], percent)
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.Table.from_arrays([ids.take(pa.array(at)), ids.take(pa.array(root[at]))], schema=edge_out)

    ship(sets.sparkSession)
    return dealt.groupBy("component", "i", "j").applyInArrow(multiply, edge_schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``."""
    ship(docs.sparkSession)
    x, total = packed(docs, id_col, text_col, BLOCK_BYTES)
    sets = materialize(surviving_sets(x, bucket_bits(total), words, percent), "shingle-sets")
    real = sets.filter(F.col("n") > 0)
    same = materialize(real.groupBy("d1", "d2").agg(F.min("id").alias("rep")), "equal-sets")
    candidates = sets.filter(F.col("columns").isNotNull() & F.col("id").isNotNull())
    found = components(links(candidates, same, percent).unionByName(_shared_ids(real, same)))
    members = sets.select("id", "n", "d1", "d2").join(same, ["d1", "d2"], "left")
    members = members.withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")))
    named = members.join(found, F.col("rep") == F.col("node"), "left")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _shared_ids(real: DataFrame, same: DataFrame) -> DataFrame:
    """Edges between the sets of rows that share an id."""
    several = real.groupBy("id").agg(F.count_distinct("d1", "d2").alias("sets")).filter((F.col("sets") > 1) & F.col("id").isNotNull())
    return real.join(several, "id").join(same, ["d1", "d2"]).select(F.col("rep").alias("a"), F.col("id").alias("b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group."""
    found = near_duplicates(docs, id_col, text_col, words, percent)
    gone = materialize(found.filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("__id")).distinct(), "near-copies")
    return docs.join(gone, docs[id_col] == gone["__id"], "left_anti")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, words=4, percent=85)

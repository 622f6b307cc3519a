"""The prefix trie of conversations by truncation peeling: nodes are found from the deepest turn upwards.

A node is a distinct sequence of the first d turns (role, text). Conversations that are equal as a whole are
merged first; then, from the greatest depth down, the conversations that end at this depth are merged with the
nodes that survived from below, each group is a node and gets its totals, loses its last turn and is grouped
again with its siblings. Nodes are found and summed in that one descent.

In Spark the merged conversations are sorted by their turns and dealt into ranges, and every task peels its own
range (``peel``). Only nodes on the path of a range's first or last conversation can have members in another
range: these *open* nodes, at most two a level and range, leave their partial totals, which are added up and
peeled once more (``close``). So a first turn that a third of all conversations share is cut over as many
tasks as its conversations need, and no group is gathered whole.

Defined cases: null role or text is empty; turns are ordered by ``turn``, null first, ties by role and then by
the turn's hash, so repeated rows are repeated turns; rows without a conversation id belong to none; a
conversation without turns is a member of the root alone; an empty table has no nodes, not even a root; further
columns aren't read, whatever their names. Ids are whole numbers.

At scale: texts stay where they are read, turns move as two 64-bit hashes and a length (24 bytes). A
conversation is one record, as a document is: its hashed turns must fit into a task. Ids of equal conversations
are packed into sorted runs and streamed through the digest, so that any number of copies takes the memory of
one batch. Rounds don't depend on the depth. Counts, open nodes and ends are all that meets again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, mix64, ship, struct

#: Hashed turns of a range, in bytes; ids in a packed run.
RANGE_BYTES = 8 << 20
RUN_IDS = 4096

_KEY = "k1 long, k2 long, p1 long, p2 long"
NODE = struct(
    f"depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, chars long, open boolean, {_KEY}"
)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def hashed(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs (a, b: hashes of role and text, n: code points)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    one = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("r"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(7), role, text).alias("b"), F.length(text).alias("n"),
    )
    rows = F.sort_array(F.collect_list(F.struct("turn", "r", "a", "b", "n")))
    return one.groupBy("conv_id").agg(rows.alias("turns")).withColumn("turns", F.transform("turns", lambda t: F.struct(t["a"], t["b"], t["n"])))


def with_shared_heads(paths: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Conversation c with the first h turns of conversation c-c%group before its own turns from the h-th on; h = crc32(c) % (most+1)."""
    heads = paths.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    none = F.array().cast(paths.schema["turns"].dataType)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    x = paths.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left")
    return x.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), own).alias("turns"))


def end_digests(rows: DataFrame, parts: int) -> DataFrame:
    """(e1, e2, ends_sha256): the digest of the ascending ids of each key, streamed from packed runs."""
    run_schema = struct("e1 long, e2 long, first long, ids string")
    sha_schema = struct("e1 long, e2 long, ends_sha256 string")
    run_out, sha_out = arrow_schema(run_schema), arrow_schema(sha_schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e1, e2, ids = (b.column(k).to_numpy() for k in range(3))
            if not len(ids):
                continue
            cut = np.flatnonzero((e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])) + 1
            edges = np.concatenate([[0], cut, [len(ids)]])
            at = [k for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()) for k in range(s, e, RUN_IDS)] + [len(ids)]
            text = [",".join(map(str, ids[s:e].tolist())) for s, e in zip(at, at[1:])]
            first = np.array(at[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(e1[first]), pa.array(e2[first]), pa.array(ids[first]), pa.array(text)], schema=run_out)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            done = []
            for e1, e2, _, ids in zip(*(c.to_pylist() for c in b.columns)):
                if (e1, e2) == key:
                    sha.update(b",")
                else:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (e1, e2), hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(sha_out)], schema=sha_out)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, sha.hexdigest()), sha_out)], schema=sha_out)

    runs = rows.select("e1", "e2", "conv_id").repartitionByRange(parts, "e1", "e2", "conv_id").sortWithinPartitions("e1", "e2", "conv_id").mapInArrow(pack, run_schema)
    return runs.repartition(parts, "e1", "e2").sortWithinPartitions("e1", "e2", "first").mapInArrow(digest, sha_schema)


# ---------------------------------------------------------------------------------------------
# Peeling one range
# ---------------------------------------------------------------------------------------------
def prefix_keys(turns: np.ndarray, lanes: tuple[np.ndarray, np.ndarray], starts: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit keys of every prefix: sums of the turns' hashes, each mixed with its place; empty prefixes have key 0."""
    out = []
    for k, x in enumerate(lanes):
        place = mix64(turns.astype(np.uint64) + np.uint64(0x51ED27 + k))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(x.view(np.uint64) ^ place), dtype=np.uint64)])
        out.append((total[1:] - np.repeat(total[starts], lens)).view(np.int64))
    return out


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def peel(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The nodes of a sorted range of distinct conversations (turns, conv_id, n_ended, ends_sha256); open ones carry partial totals."""
    schema = arrow_schema(NODE)
    lists = table.column("turns").combine_chunks()
    lens = np.diff(lists.offsets.to_numpy())
    starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    flat = lists.flatten()
    depth_of = np.arange(len(flat)) - np.repeat(starts, lens) + 1
    lanes = tuple(np.ascontiguousarray(flat.field(k).to_numpy(zero_copy_only=False)) for k in range(2))
    keys = prefix_keys(depth_of, lanes, starts, lens)
    chars = flat.field(2).to_numpy(zero_copy_only=False).astype(np.int64)
    ids, ended = _column(table, "conv_id"), _column(table, "n_ended")
    shas = table.column("ends_sha256").combine_chunks()
    by_len = np.argsort(lens, kind="stable")
    bound = np.searchsorted(lens[by_len], np.arange(lens.max() + 2))

    def key_at(rows: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        if not d:
            return (np.zeros(len(rows), np.int64),) * 2
        at = starts[rows] + d - 1
        return keys[0][at], keys[1][at]

    ends = np.array([0, len(lens) - 1])
    below = None  # the level below, waiting for the ids of its parents
    for d in range(int(lens.max()), -1, -1):
        new = by_len[bound[d] : bound[d + 1]]
        zero, own = np.zeros(len(new), np.int64), np.arange(len(new))
        state = {"rep": new, "n": ended[new], "conv": ids[new], "children": zero, "leaves": zero, "saved": zero, "end": new}
        if below is not None:
            lifted = {
                "rep": below["rep"], "n": below["n"], "conv": below["conv"], "end": np.full(len(below["rep"]), -1),
                "children": np.where(below["open"], 0, 1), "leaves": np.where(below["open"], 0, below["leaves"]), "saved": np.where(below["open"], 0, below["saved"]),
            }
            state = {k: np.concatenate([v, lifted[k]]) for k, v in state.items()}
            own = np.arange(len(new), len(state["rep"]))
        if not len(state["rep"]):
            continue
        k1, k2 = key_at(state["rep"], d)
        order = np.lexsort((k2, k1))
        s1, s2 = k1[order], k2[order]
        head = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
        at = np.flatnonzero(head)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(head) - 1
        node = {k: np.add.reduceat(state[k][order], at) for k in ("n", "children", "leaves", "saved")}
        node |= {"rep": state["rep"][order][at], "conv": np.minimum.reduceat(state["conv"][order], at), "end": np.maximum.reduceat(state["end"][order], at), "k1": s1[at], "k2": s2[at]}
        is_open = np.zeros(len(at), bool)
        for r in ends[lens[ends] >= d]:
            e1, e2 = key_at(np.array([r]), d)
            is_open |= (node["k1"] == e1[0]) & (node["k2"] == e2[0])
        node["open"] = is_open
        node["chars"] = chars[starts[node["rep"]] + d - 1] if d else np.zeros(len(at), np.int64)
        node["leaves"] = np.where(~is_open & (node["children"] == 0), 1, node["leaves"])
        node["saved"] = node["saved"] + np.where(is_open, 0, (node["n"] - 1) * node["chars"])
        node["p1"], node["p2"] = key_at(node["rep"], max(d - 1, 0))
        if below is not None:
            yield _rows(below, d + 1, node["conv"][group[own]], node["open"][group[own]], shas, schema)
        below = node
    yield _rows(below, 0, None, None, shas, schema)


def _rows(node: dict, depth: int, parents: np.ndarray | None, unknown: np.ndarray | None, shas: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    """A level's rows; a parent that is open has no id yet."""
    n = len(node["rep"])
    end = pa.array(node["end"], mask=node["end"] < 0)
    columns = {
        "depth": np.full(n, depth), "conv_id": node["conv"], "parent_conv_id": pa.nulls(n, pa.int64()) if parents is None else pa.array(parents, mask=unknown | node["open"]),
        "n_convs": node["n"], "n_children": node["children"], "n_leaves": node["leaves"], "saved_tokens": node["saved"],
        "ends_sha256": shas.take(end), "chars": node["chars"], "open": node["open"], **{k: node[k] for k in ("k1", "k2", "p1", "p2")},
    }
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def close(table: pa.Table) -> pa.Table:
    """The open nodes with their whole totals, peeled again from the deepest: partial totals and open children added."""
    rows = sorted(table.to_pylist(), key=lambda r: -r["depth"])
    key = {(r["depth"], r["k1"], r["k2"]): r for r in rows}
    for r in rows:
        r["n_leaves"] += r["n_children"] == 0
        r["saved_tokens"] += (r["n_convs"] - 1) * r["chars"]
        if r["depth"]:
            parent = key[r["depth"] - 1, r["p1"], r["p2"]]
            parent["n_children"] += 1
            parent["n_leaves"] += r["n_leaves"]
            parent["saved_tokens"] += r["saved_tokens"]
            r["parent_conv_id"] = parent["conv_id"]
    return pa.Table.from_pylist(rows, schema=arrow_schema(NODE))


def trie(paths: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The nodes of conversations (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = paths.sparkSession
    ship(spark)
    rows = materialize(paths.withColumns({"e1": F.xxhash64("turns"), "e2": F.xxhash64(F.lit(7), "turns")}), "conversation-paths")
    total = rows.agg(F.sum(F.size("turns") * 24 + 32)).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // range_bytes))
    merged = rows.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n_ended"), F.min("conv_id").alias("conv_id"))
    merged = merged.join(end_digests(rows, parts), ["e1", "e2"]).drop("e1", "e2")
    distinct = materialize(merged.join(rows.select("conv_id", "turns"), "conv_id"), "distinct-conversations")

    def one_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield from peel(pa.Table.from_batches(got))

    nodes = materialize(distinct.repartitionByRange(parts, "turns").sortWithinPartitions("turns").mapInArrow(one_range, NODE), "trie-nodes")
    partial = nodes.filter("open").groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        *(F.max(c).alias(c) for c in ("ends_sha256", "chars", "p1", "p2")),
    ).withColumns({"parent_conv_id": F.lit(None).cast("long"), "open": F.lit(True)})
    opened = materialize(partial.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(close, NODE), "open-nodes")
    closed = nodes.filter(~F.col("open"))
    above = opened.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    orphans = closed.filter(F.col("parent_conv_id").isNull()).join(above, ["depth", "p1", "p2"]).withColumn("parent_conv_id", F.col("above"))
    out = closed.filter(F.col("parent_conv_id").isNotNull()).select(RESULT).unionByName(orphans.select(RESULT)).unionByName(opened.select(RESULT))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def report(conversations: DataFrame) -> DataFrame:
    """The query's rows: the trie of the rebuilt conversations."""
    return trie(with_shared_heads(hashed(conversations)))


ORACLE_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list_reduce(list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ord(CAST(conv_id AS VARCHAR)[i]) AS BIGINT)),
    lambda crc, byte: list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), xor(crc, byte)), 4294967295::BIGINT) AS inv
  FROM (SELECT DISTINCT conv_id FROM own)
), placed AS (
  SELECT conv_id, xor(inv, 4294967295::BIGINT) % 6 AS h FROM convs
), turns AS (
  SELECT p.conv_id, o.pos, o.role, o.text FROM placed p JOIN own o ON o.conv_id = p.conv_id - p.conv_id % 100 AND o.pos <= p.h
  UNION ALL
  SELECT p.conv_id, o.pos, o.role, o.text FROM placed p JOIN own o ON o.conv_id = p.conv_id AND o.pos > p.h
), paths AS (
  SELECT p.conv_id, coalesce(list([role, text] ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS path FROM placed p LEFT JOIN turns USING (conv_id) GROUP BY p.conv_id
), members AS (
  SELECT conv_id, depth, len(path) = depth AS ends, sha256(CAST(path[:depth] AS VARCHAR)) AS key,
    CASE WHEN depth > 0 THEN length(path[depth][2]) ELSE 0 END AS chars
  FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM paths)
), nodes AS (
  SELECT depth, key, min(conv_id) AS node, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY depth, key
), held AS (
  SELECT m.conv_id, m.depth, n.node FROM members m JOIN nodes n USING (depth, key)
), parents AS (
  SELECT n.*, h.node AS parent FROM nodes n LEFT JOIN held h ON h.conv_id = n.node AND h.depth = n.depth - 1
), children AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM parents WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT p.*, coalesce(c.n, 0) AS n_children FROM parents p LEFT JOIN children c USING (depth, node)
)
SELECT a.node AS conv_id, a.depth, a.parent AS parent_conv_id, a.n_convs, a.n_children,
  CAST(count(*) FILTER (WHERE f.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((f.n_convs - 1) * f.chars) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM full_nodes f JOIN held h ON h.conv_id = f.node AND h.depth <= f.depth JOIN full_nodes a ON a.depth = h.depth AND a.node = h.node
GROUP BY ALL
"""

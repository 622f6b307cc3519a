"""Line dedup: drop lines whose normalised form many documents hold.

Lines are split at ``\\n`` and normalised to a key (white space ``\\x20 \\x09-\\x0D`` stripped at both
ends, A-Z lower-cased); keys are hashed to 128 bits, distinct documents are counted per hash, and
the lines of keys over the threshold go, but for those in the largest document id that holds the key.
The remaining lines are joined in their order.

Defined cases: a null or empty text is one empty line; a text whose lines all go becomes empty; the
same line repeated in one document counts once, and all its copies stay in the keeper; rows that
share a document id are one document; rows with a null id are not counted and lose every line that
the threshold condemns; further columns pass through, and a column named like an added one gives way.

At scale: only (hash, id) pairs are shuffled for counting, and partial counts are combined before the
exchange by hash, so a line held by a third of all documents is one row a task there. The pairs meet
the few condemned hashes in a join that AQE can split at hot hashes. Texts move once, to meet the
condemned hashes of their own document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, added, arrow_schema, byte_texts, map_arrow, materialize, with_columns

HASH = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])


def line_hashes(text: bytes, min_chars: int) -> list[bytes]:
    """The 128-bit hash of each line's key, or b"" where the key is too short."""
    out = []
    for line in text.lower().split(b"\n"):
        key = line.strip(SPACE)
        long_enough = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else b"")
    return out


def line_pairs(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc): the distinct line hashes of each row."""
    schema = T.StructType([*HASH.fields, T.StructField("doc", docs.schema[id_col].dataType)])
    out = arrow_schema(schema)

    def pairs(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, at = [], []
        for k, t in enumerate(byte_texts(b.column(1))):
            own = {*line_hashes(t, min_chars)} - {b""}
            keys += own
            at += [k] * len(own)
        h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(pa.array(at, pa.int64())).cast(out.field(2).type)], schema=out)

    return map_arrow(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), pairs, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text_col`` rewritten, and n_lines (before dropping) and n_dropped (long) added."""
    pairs = line_pairs(docs, id_col, text_col, min_chars)
    held = pairs.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("keeper"))
    # Written once: the join then has an exchange of its own on either side, so that AQE can split a hot hash.
    condemned = materialize(held.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "condemned-lines")
    drops = (
        pairs.join(condemned, ["h1", "h2"])
        .filter(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc").alias("__doc"))
        .agg(F.collect_set(F.struct("h1", "h2")).alias("__drop"))
    )
    joined = docs.join(drops, docs[id_col].eqNullSafe(drops["__doc"]), "left").drop("__doc")
    schema = added(docs.schema, n_lines=T.LongType(), n_dropped=T.LongType())
    out = arrow_schema(schema)

    def rewrite(b: pa.RecordBatch) -> pa.RecordBatch:
        drop = b.column("__drop")
        kept, n_lines, n_dropped = [], [], []
        flat = drop.flatten()
        h = np.stack([flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)], 1).astype("<i8").tobytes() if len(flat) else b""
        lens = [x or 0 for x in pa.compute.list_value_length(drop).to_pylist()]
        at = 0
        for t, n in zip(byte_texts(b.column(text_col)), lens):
            lines = t.split(b"\n")
            n_lines.append(len(lines))
            if n:
                gone = {h[16 * k : 16 * k + 16] for k in range(at, at + n)}
                at += n
                lines = [x for x, k in zip(lines, line_hashes(t, min_chars)) if k not in gone]
                t = b"\n".join(lines)
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(t)
        return with_columns(b, out, **{text_col: pa.array(kept, pa.binary()).cast(pa.string())}, n_lines=n_lines, n_dropped=n_dropped)

    return map_arrow(joined, rewrite, schema)


def report(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), condemned AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, coalesce(condemned.keeper <> keyed.doc_id, FALSE) AS gone
  FROM keyed LEFT JOIN condemned USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

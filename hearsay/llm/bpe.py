"""Byte-level BPE encoding and decoding by a public rank file.

Overlapping chunk encoding: a long text is cut into chunks, each with an overlap into the next, and
the chunks are split into pre-tokens in parallel as rows of their own. Splitting from a boundary
depends only on the text that follows it, so once a boundary of the chunk before is also a boundary
of the next chunk, the two agree from there on: the lists are stitched at that place. Boundaries
found close to a chunk's end may depend on text beyond it and are not used; where the lists never
meet inside the overlap, the stitcher goes on splitting by itself until they do. The stitched pieces
are then encoded one by one. Decoding concatenates the raw bytes of the ids.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows that share an id are
encoded one by one (identical rows give identical results); no special tokens exist: their strings are
ordinary text; further columns pass through, and a column named like an added one gives way.

At scale: texts up to a chunk's length are encoded in place, without a shuffle. Only longer ones move:
their chunks are dealt over the cluster, and the boundaries meet again by document. A document's ids
are one row, as its text is. The rank file (under 1 MB) travels with the tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, arrow_schema, map_arrow, with_columns

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
#: Boundaries this close to the end of a chunk's text may move when more text follows.
UNSURE_CHARS = 64
#: Pieces that a worker remembers at most, and the longest piece that is worth it.
CACHE_PIECES, CACHE_CHARS = 200_000, 64


def default_ranks() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Pre-tokeniser, piece encoder and decoder; made once in a worker."""

    _made: dict[tuple[int, str], Codec] = {}

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(n) for a, n in map(bytes.split, ranks.splitlines())}
        self.split = regex.compile(pattern).findall
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.raw = {n: b for b, n in table.items()}
        self.known: dict[str, list[int]] = {}

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> Codec:
        key = (hash(ranks), pattern)
        if key not in cls._made:
            cls._made[key] = cls(ranks, pattern)
        return cls._made[key]

    def piece(self, p: str) -> list[int]:
        ids = self.core.encode_ordinary(p)
        if len(p) <= CACHE_CHARS:
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            self.known[p] = ids
        return ids

    def encode(self, pieces: list[str]) -> list[int]:
        known, piece = self.known.get, self.piece
        return list(chain.from_iterable([known(p) or piece(p) for p in pieces]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


def cut(text: str, size: int, overlap: int) -> Iterator[tuple[int, str, str]]:
    """(chunk number, its own text, the overlap that follows)."""
    for k, at in enumerate(range(0, max(1, len(text)), size)):
        yield k, text[at : at + size], text[at + size : at + size + overlap]


def stitch(codec: Codec, text: str, chunks: list[tuple[int, int, list[int]]]) -> list[str]:
    """The pieces of ``text`` from the boundaries of its chunks: (start, end of what it saw, boundaries from the start)."""
    ends: list[int] = []
    at = 0
    for start, seen, own in chunks:
        sure = seen if seen >= len(text) else seen - UNSURE_CHARS
        edges = [e for e in (start, *(start + x for x in own)) if e <= sure]
        goal, last = set(edges), max(edges, default=0)
        while at < last and at not in goal:  # the lists haven't met yet: go on alone
            at += _next(codec, text, at)
            ends.append(at)
        ends += [e for e in edges if e > at]
        at = max(at, last)
    while at < len(text):
        at += _next(codec, text, at)
        ends.append(at)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _next(codec: Codec, text: str, at: int) -> int:
    """Length of the piece that starts at ``at``, looking as far ahead as it needs."""
    ahead = 256
    while True:
        first = len(codec.split(text[at : at + ahead])[0])
        if first < ahead - 2 or at + ahead >= len(text):
            return first
        ahead *= 4


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: bytes | None = None, pattern: str | None = None, decode: bool = False, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``docs`` with ids (array<int>) added, and with decoded (binary) if ``decode``.

    ``ranks`` is the content of a tiktoken rank file, ``pattern`` its splitting pattern.
    """
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    new = {"ids": T.ArrayType(T.IntegerType(), False)} | ({"decoded": T.BinaryType()} if decode else {})
    schema = added(docs.schema, **new)
    out = arrow_schema(schema)

    def results(codec: Codec, all_pieces: Iterator[list[str]]) -> dict[str, pa.Array]:
        ids = [codec.encode(p) for p in all_pieces]
        cols = {"ids": pa.array(ids, out.field("ids").type)}
        if decode:
            cols["decoded"] = pa.array([codec.decode(x) for x in ids], out.field("decoded").type)
        return cols

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(ranks, pattern)
        return with_columns(b, out, **results(codec, (codec.split(t or "") for t in b.column(text_col).to_pylist())))

    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    short = map_arrow(docs.filter(size <= chunk_chars), whole, schema, rows=500)

    # Long texts. The key is the row's id and text; equal rows share their chunks and are counted.
    key = F.struct(F.col(id_col).cast("string").alias("id"), F.sha2(F.col(text_col), 256).alias("sha"))
    long = docs.filter(size > chunk_chars).withColumn("__key", F.to_json(key))
    chunk_schema = T.StructType.fromDDL("key string, k int, body string, after string")
    split_schema = T.StructType.fromDDL("key string, k int, packed binary, n_after int, sizes binary")
    cut_out = arrow_schema(chunk_schema)

    def chunks(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(x, *c) for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in cut(t, chunk_chars, overlap_chars)]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(cut_out)], schema=cut_out)

    split_out = arrow_schema(split_schema)

    def split(b: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(ranks, pattern)
        body, after = b.column("body").to_pylist(), b.column("after").to_pylist()
        press = zstandard.ZstdCompressor(level=3).compress
        sizes = [press(np.array([len(p) for p in codec.split(x + y)], "<u4").tobytes()) for x, y in zip(body, after)]
        return with_columns(b, split_out, packed=[press(x.encode()) for x in body], n_after=[len(y) for y in after], sizes=sizes)

    texts = long.select(F.col("__key").alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    pieces = map_arrow(
        map_arrow(texts, chunks, chunk_schema, rows=16).repartition(F.col("key"), F.col("k")),
        split, split_schema, rows=64,
    )
    id_fields = T.StructType.fromDDL("__key2 string, __ids binary")

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        codec, open_ = Codec.of(ranks, pattern), zstandard.ZstdDecompressor().decompress
        pdf = pdf.sort_values("k")
        bodies, at, own = [open_(x).decode() for x in pdf["packed"]], 0, []
        for body, n_after, sizes in zip(bodies, pdf["n_after"], pdf["sizes"]):
            own.append((at, at + len(body) + n_after, np.cumsum(np.frombuffer(open_(sizes), "<u4"), dtype=np.int64).tolist()))
            at += len(body)
        ids = codec.encode(stitch(codec, "".join(bodies), own))
        return pd.DataFrame({"__key2": [pdf["key"].iloc[0]], "__ids": [zstandard.ZstdCompressor(level=3).compress(np.array(ids, "<u4").tobytes())]})

    def unpack(b: pa.RecordBatch) -> pa.RecordBatch:
        codec, open_ = Codec.of(ranks, pattern), zstandard.ZstdDecompressor().decompress
        ids = [np.frombuffer(open_(x), "<u4").tolist() for x in b.column("__ids").to_pylist()]
        cols = {"ids": pa.array(ids, out.field("ids").type)}
        if decode:
            cols["decoded"] = pa.array([codec.decode(x) for x in ids], out.field("decoded").type)
        return with_columns(b, out, **cols)

    encoded = pieces.groupBy("key").applyInPandas(join_up, id_fields)
    joined = map_arrow(long.drop(*new).join(encoded, F.col("__key") == F.col("__key2")).drop("__key", "__key2"), unpack, schema, rows=64)
    return short.unionByName(joined)


def report(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    x = encode(docs.select("doc_id", "text"), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return x.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Language-model scoring: unigram base score and a probabilistic suffix tree.

Texts are lower-cased (A-Z) and split into words; the words, one space between, and an end mark are the
symbols (bytes) that the tree predicts. Contexts are the last 0 to ``DEPTH`` symbols. A context is
retained where its next-symbol distribution diverges from that of its longest proper suffix: its gain,
n * KL(own || suffix) in bits, is at least ``MIN_GAIN`` and it was seen ``MIN_SEEN`` times. The suffixes of a
retained context are retained too. Every context that passes is retained: the tree grows with the corpus and
is a set of written tables, one a depth. Distributions are smoothed towards the suffix's (``PRIOR`` symbols),
and a text is scored by the longest retained suffix at each symbol: log10 of the product.

Rows are dealt into blocks. Each block sends its distinct words and its distinct grams (``DEPTH`` symbols and
the next one) once, with the counts of its training rows; a bucket of the keys adds them up. The sums of the
grams are the tree's statistics. Buckets then send back what each block asked for, in the order in which it
asked: the counts of its words, and for each gram the log10 probability under its longest retained context.
Blocks find their distinct keys anew and score their texts with these.

Defined cases: a null or empty text is the end mark alone (one token); without a training row every
count is 0 and the tree is uniform; a null id is a training row (crc32 of no bytes is 0); rows that share
an id are scored one by one; equal texts get equal scores; bytes outside the alphabet share one symbol and
split its probability evenly. Words are told apart by 64-bit hashes with their length.

At scale: texts move twice, to their block, many compressed together; they are read twice and stored nowhere. A word or gram moves once a block, however often
it occurs, in sorted arrays, so no key is hot. Divergence tests and probabilities are joins and sums by context
over the distinct grams. Nothing but sums, and the counts of 256 bytes, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, arrow_schema, byte_texts, map_arrow, materialize, mix64, ship, struct, word_hashes
from .langid import id_crc

#: Parameters of the tree.
DEPTH, MIN_SEEN, MIN_GAIN, PRIOR = 5, 32, 24.0, 4.0
ALPHABET = 64
#: Text bytes of a block of rows, of texts handled at a time, and for each bucket of keys.
BLOCK_BYTES, CHUNK_BYTES, BUCKET_BYTES = 5 << 20, 1 << 20, 48 << 20
END = 10  # the byte that marks a text's end; not in any word
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True
END_WORD = np.uint64(1)  # the end mark's key among the words
WORDS, GRAMS = 0, 1

ASKED = struct("block int, bucket int, kind int, keys binary, counts binary")
REPLY = struct("block int, bucket int, kind int, answers binary")
GRAM = struct("gram long, n long, bucket int")


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def stream(text: bytes) -> bytes:
    """What the tree sees of a text: its words, one space between, and the end mark."""
    if len(text) < CHUNK_BYTES // 4:
        return b" ".join(tokens(text)) + b"\n"
    x = np.frombuffer(text.lower(), np.uint8)  # of a long text, without an object for each word
    gap = IS_SPACE[x]
    keep = ~gap | np.concatenate([[False], ~gap[:-1]])
    return np.where(gap, 32, x)[keep].astype(np.uint8).tobytes().strip() + b"\n"


@dataclass
class Piece:
    """A stretch of the texts' symbols that starts and ends between words."""

    x: np.ndarray
    ahead: np.ndarray  # the DEPTH symbols before it
    since: int  # how far its text has come
    starts: np.ndarray  # where its texts start (the first one, or its rest, at 0)
    texts: np.ndarray  # their numbers

    def contexts(self) -> np.ndarray:
        """Each byte's gram: the byte before it highest, then the ones before that, and itself lowest, so that sorted grams
        share their nearest context. Before a text stand end marks."""
        x, n = self.x, len(self.x)
        out = x.astype(np.uint64)
        wide = np.concatenate([self.ahead, x])
        since = np.arange(n) - np.repeat(self.starts, np.diff(np.append(self.starts, n)))
        since[: self.starts[1] if len(self.starts) > 1 else n] += self.since
        for d in range(1, DEPTH + 1):
            before = wide[DEPTH - d : DEPTH - d + n].astype(np.uint64)
            before[since < d] = END
            out |= before << np.uint64(8 * (DEPTH + 1 - d))
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the words, in order, and how many each text has here."""
        gap = (self.x == 32) | (self.x == END)
        first = ~gap & np.concatenate([[True], gap[:-1]])
        return word_hashes(self.x.tobytes())[0], np.add.reduceat(first.astype(np.int64), self.starts)


def pieces(texts: list[bytes]) -> Iterator[Piece]:
    """The symbols of all texts in stretches of about ``CHUNK_BYTES``, whatever the texts' lengths."""
    at = 0
    while at < len(texts):
        last, size = at, 0
        while last < len(texts) and (size == 0 or size + len(texts[last]) <= CHUNK_BYTES):
            size += len(texts[last]) + 1
            last += 1
        parts = [stream(t) for t in texts[at:last]]
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        x = np.frombuffer(b"".join(parts), np.uint8)
        cut = 0
        while cut < len(x):
            end, look = min(len(x), cut + CHUNK_BYTES), 1 << 12
            while end < len(x):  # on to the next gap
                gaps = np.flatnonzero((x[end - 1 : end - 1 + look] == 32) | (x[end - 1 : end - 1 + look] == END))
                if len(gaps):
                    end += int(gaps[0])
                    break
                look *= 4
            before = x[max(0, cut - DEPTH) : cut]
            inside = np.unique(np.append(starts[(starts >= cut) & (starts < end)], cut))
            number = np.searchsorted(starts, inside, side="right") - 1
            yield Piece(x[cut:end], np.concatenate([np.full(DEPTH - len(before), END, np.uint8), before]), cut - int(starts[number[0]]), inside - cut, number + at)
            cut = end
        at = last


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    keys = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
    n = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


class Distinct:
    """The sorted distinct words and grams of a block's texts, and their counts in the rows that learn."""

    def __init__(self, texts: list[bytes], learn: list[bool]) -> None:
        found: dict[int, list] = {WORDS: [], GRAMS: []}
        for used in (True, False):
            for p in pieces([t for t, x in zip(texts, learn) if x == used]):
                ends = np.full(int((p.x == END).sum()), END_WORD)
                for kind, keys in ((WORDS, np.append(p.words()[0], ends)), (GRAMS, p.contexts())):
                    k, n = np.unique(keys, return_counts=True)
                    found[kind].append((k, n.astype(np.int64) * used))
                    if len(found[kind]) >= 8:
                        found[kind] = [add_up(found[kind])]
        self.keys, self.counts = {}, {}
        for kind, parts in found.items():
            self.keys[kind], self.counts[kind] = add_up(parts)

    def dealt(self, kind: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the keys in the order of their buckets, and where each bucket starts."""
        bucket = (mix64(self.keys[kind]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


class Places:
    """Finds keys among distinct ones: tables by hash, each for what the one before has no room for."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.tables = keys, []
        self.bits = np.uint64(64 - max(8, int(len(keys) * 4).bit_length()))
        left = np.arange(len(keys), dtype=np.int32)
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            table = np.full(1 << int(64 - self.bits), -1, np.int32)
            slot = self.slots(keys[left], np.uint64(factor))
            table[slot] = left
            left = left[table[slot] != left]
            self.tables.append((np.uint64(factor), table))
        self.rest = left[np.argsort(keys[left])]

    def slots(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(31))) * factor) >> self.bits).astype(np.int64)

    def of(self, asked: np.ndarray) -> np.ndarray:
        """The place of each asked key, all of which are there."""
        out = np.full(len(asked), -1, np.int32)
        open_ = slice(None)
        for factor, table in self.tables:
            q = asked[open_]
            at = table[self.slots(q, factor)]
            hit = (at >= 0) & (self.keys[at] == q)
            if isinstance(open_, slice):
                out = np.where(hit, at, -1)
                open_ = np.flatnonzero(~hit)
            else:
                out[open_[hit]] = at[hit]
                open_ = open_[~hit]
            if not len(open_):
                return out
        out[open_] = self.rest[np.searchsorted(self.keys[self.rest], asked[open_])]
        return out


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed differences: sorted keys and small counts take few bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(len(x), -1).T.tobytes())


def unpack(b: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def press(rows: pa.RecordBatch) -> bytes:
    """Rows compressed together."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(rows.serialize())


def unpress(parts: list[bytes], schema: pa.Schema) -> pa.Table:
    import zstandard

    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(zstandard.ZstdDecompressor().decompress(p)), schema) for p in parts], schema)


def rows_of(schema: T.StructType, columns: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_schema(schema))], schema=arrow_schema(schema))


def shape_digits(gram: Column, classes: np.ndarray) -> Column:
    """A gram of bytes as one of symbol numbers, 6 bits each: the oldest highest, the predicted one lowest."""
    lookup = F.split(F.lit(",".join(map(str, classes))), ",").cast("array<bigint>")
    g = F.lit(0).cast("long")
    for place in (*range(1, DEPTH + 1), 0):
        g = g * ALPHABET + lookup[F.shiftright(gram, 8 * place).bitwiseAND(F.lit(255)).cast("int")]
    return g


def byte_classes(grams: DataFrame) -> np.ndarray:
    """Byte → symbol number: the end mark, the space, the most frequent bytes, and one number for the rest."""
    low = F.col("gram").bitwiseAND(F.lit(255)).alias("b")
    sums = {r["b"]: r["n"] for r in grams.groupBy(low).agg(F.sum("n").alias("n")).collect()}  # 256 rows at most
    common = sorted((b for b in sums if b not in (END, 32)), key=lambda b: (-sums[b], b))
    classes = np.full(256, ALPHABET - 1, np.uint8)
    classes[END], classes[32] = 0, 1
    for k, b in enumerate(common[: ALPHABET - 3]):
        classes[b] = k + 2
    return classes


def fit(grams: DataFrame, classes: np.ndarray) -> tuple[DataFrame, list[DataFrame]]:
    """(g, p) of every distinct gram of symbol numbers, by its longest retained context; and the retained contexts of each depth.

    Level d has the grams of d symbols and the next one, with their counts; a longer level without its oldest symbol adds up to the next.
    """
    level = grams.select(shape_digits(F.col("gram"), classes).alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n"))
    levels = [materialize(level, f"lm-level{DEPTH}")]
    for d in range(DEPTH - 1, -1, -1):
        shorter = levels[0].select((F.col("g") % ALPHABET ** (d + 1)).alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n"))
        levels.insert(0, materialize(shorter, f"lm-level{d}"))
    ctx = F.floor(F.col("g") / ALPHABET).cast("long").alias("ctx")
    totals = [materialize(x.groupBy(ctx).agg(F.sum("n").alias("total")), "lm-totals") for x in levels]

    kept: list[DataFrame] = [None] * (DEPTH + 1)  # type: ignore[list-item]
    deeper = None
    for d in range(DEPTH, 0, -1):
        own = levels[d].filter(F.col("n") > 0).select("g", "n", ctx).join(totals[d].filter(F.col("total") >= MIN_SEEN), "ctx")
        up = levels[d - 1].select(F.col("g").alias("up"), F.col("n").alias("un"), ctx.alias("up_ctx"))
        both = own.withColumn("up", F.col("g") % ALPHABET**d).join(up, "up")
        both = both.join(totals[d - 1].select(F.col("ctx").alias("up_ctx"), F.col("total").alias("ut")), "up_ctx")
        part = F.col("n") * F.log2((F.col("n") / F.col("total")) / (F.col("un") / F.col("ut")))
        passed = both.groupBy("ctx").agg(F.sum(part).alias("gain")).filter(F.col("gain") >= MIN_GAIN).select("ctx")
        if deeper is not None:
            passed = passed.unionByName(deeper.select((F.col("ctx") % ALPHABET**d).alias("ctx"))).distinct()
        kept[d] = deeper = materialize(passed.join(totals[d], "ctx"), f"lm-contexts{d}")
    # The empty context is retained always.
    all_seen = levels[0].agg(F.sum("n")).first()[0] or 0
    p = levels[0].select("g", ((F.col("n") + 0.5) / (all_seen + 0.5 * ALPHABET)).alias("p"))
    for d in range(1, DEPTH + 1):
        x = levels[d].select("g", "n", ctx, (F.col("g") % ALPHABET**d).alias("up"))
        x = x.join(p.select(F.col("g").alias("up"), F.col("p").alias("q")), "up").join(kept[d], "ctx", "left")
        own_p = (F.col("n") + PRIOR * F.col("q")) / (F.col("total") + PRIOR)
        p = materialize(x.select("g", F.when(F.col("total").isNotNull(), own_p).otherwise(F.col("q")).alias("p")), f"lm-p{d}")
    return p, kept


def blocks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, pa.Schema, int]:
    """(block, rows): rows (id, text, learn) compressed; their schema; and the buckets that the corpus's keys ask for.

    Blocks are dealt by a hash of id and text, so that rows that share an id, or have none, don't share a block.
    """
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = x.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    x = x.withColumns({"learn": id_crc(F.col("id"), 5) != 1, "block": F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")})
    inner = arrow_schema(T.StructType([x.schema["id"], *struct("text string, learn boolean").fields]))
    schema = struct("block int, rows binary")
    out = arrow_schema(schema)

    def compress(b: pa.RecordBatch) -> pa.RecordBatch:
        block = b.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0, [True]])) if len(block) else np.zeros(1, np.int64)
        rows = pa.RecordBatch.from_arrays([b.column(f.name).take(pa.array(order)).cast(f.type) for f in inner], schema=inner)
        parts = [press(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in rows.slice(s, e - s).columns], schema=inner)) for s, e in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(block[order][edges[:-1]], pa.int32()), pa.array(parts, pa.binary())], schema=out)

    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // BUCKET_BYTES))
    return map_arrow(x, compress, schema, rows=4000), inner, buckets


def ask_all(x: DataFrame, inner: pa.Schema, buckets: int) -> DataFrame:
    """Each block's distinct words and grams, a row a bucket and kind: sorted keys, and their counts in training rows."""

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        rows = unpress(table.column("rows").to_pylist(), inner)
        own = Distinct([t for c in rows.column("text").chunks for t in byte_texts(c)], rows.column("learn").to_pylist())
        out = []
        for kind in (WORDS, GRAMS):
            order, edges = own.dealt(kind, buckets)
            for k in np.flatnonzero(np.diff(edges)).tolist():
                at = order[edges[k] : edges[k + 1]]
                out.append((block, k, kind, pack(own.keys[kind][at]), pack(own.counts[kind][at])))
        return rows_of(ASKED, list(zip(*out)) or [[]] * len(ASKED))

    return materialize(x.groupBy("block").applyInArrow(ask, ASKED), "lm-asked")


def bucket_sums(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each asking row of a bucket, and the bucket's distinct keys with their sums."""
    keys = [unpack(b, np.uint64) for b in table.column("keys").to_pylist()]
    counts = [unpack(b, np.int64) for b in table.column("counts").to_pylist()]
    return (keys, *add_up(list(zip(keys, counts))))


@dataclass
class Model:
    """Of a corpus: its blocks and what they ask, the grams with their counts, the tree's probabilities and contexts by depth, the byte classes."""

    blocks: DataFrame
    asked: DataFrame
    inner: pa.Schema
    buckets: int
    grams: DataFrame
    p: DataFrame
    contexts: list[DataFrame]
    classes: np.ndarray


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    ship(docs.sparkSession)
    x, inner, buckets = blocks(docs, id_col, text_col)
    asked = ask_all(x, inner, buckets)

    def sum_grams(table: pa.Table) -> pa.Table:
        _, keys, n = bucket_sums(table)
        return rows_of(GRAM, [keys.astype(np.int64), n, np.full(len(keys), table.column("bucket")[0].as_py())])

    grams = materialize(asked.filter(F.col("kind") == GRAMS).groupBy("bucket").applyInArrow(sum_grams, GRAM), "lm-grams")
    classes = byte_classes(grams)
    p, kept = fit(grams, classes)
    return Model(x, asked, inner, buckets, grams, p, kept, classes)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    import zstandard

    m = learn(docs, id_col, text_col)
    inner, buckets, classes = m.inner, m.buckets, m.classes

    def replies_of(table: pa.Table, kind: int, answers: list[bytes]) -> pa.Table:
        return rows_of(REPLY, [table.column("block").to_pylist(), table.column("bucket").to_pylist(), [kind] * len(answers), answers])

    def word_counts(table: pa.Table) -> pa.Table:
        asking, keys, n = bucket_sums(table)
        answers = [n[np.searchsorted(keys, k)] for k in asking]
        answers[0] = np.append(answers[0], (n > 0).sum())  # the first one is also told how many words of the bucket were learned
        return replies_of(table, WORDS, [pack(a) for a in answers])

    word_replies = m.asked.filter(F.col("kind") == WORDS).groupBy("bucket").applyInArrow(word_counts, REPLY)

    # The probability of a byte is that of its symbol, split among the symbol's bytes.
    members = F.split(F.lit(",".join(str(k) for k in np.bincount(classes, minlength=ALPHABET))), ",").cast("array<double>")
    coded = m.grams.select("gram", "bucket", shape_digits(F.col("gram"), classes).alias("g")).join(m.p, "g")
    known = coded.select("gram", F.log10(F.col("p") / members[(F.col("g") % ALPHABET).cast("int")]).alias("logp"), "bucket")

    def gram_scores(table: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("gram").to_numpy())
        keys, logp = found.column("gram").to_numpy()[order].astype(np.uint64), found.column("logp").to_numpy()[order].astype(np.float32)
        small = zstandard.ZstdCompressor(level=1).compress
        return replies_of(table, GRAMS, [small(logp[np.searchsorted(keys, unpack(b, np.uint64))].tobytes()) for b in table.column("keys").to_pylist()])

    gram_replies = m.asked.filter(F.col("kind") == GRAMS).groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(gram_scores, REPLY)
    replies = word_replies.unionByName(gram_replies)

    done_schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *struct("learn boolean, n_tokens long, n_known long, logs double, score double, learned long").fields])
    done_out = arrow_schema(done_schema)

    def answer(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return done_out.empty_table()
        rows = unpress(table.column("rows").to_pylist(), inner)
        texts = [t for c in rows.column("text").chunks for t in byte_texts(c)]
        own = Distinct(texts, rows.column("learn").to_pylist())
        large = zstandard.ZstdDecompressor().decompress
        got = sorted(zip(*(reply.column(c).to_pylist() for c in ("kind", "bucket", "answers"))), key=lambda r: r[:2])
        values, learned = {}, 0
        for kind, read in ((WORDS, lambda a: unpack(a, np.int64)), (GRAMS, lambda a: np.frombuffer(large(a), np.float32))):
            order, edges = own.dealt(kind, buckets)
            parts = [(read(a), int(edges[b + 1] - edges[b])) for k, b, a in got if k == kind]
            learned += sum(int(v[n]) for v, n in parts if len(v) > n)
            values[kind] = np.empty(len(order), parts[0][0].dtype)
            values[kind][order] = np.concatenate([v[:n] for v, n in parts])
        c, logp = values[WORDS], values[GRAMS]
        words_at, grams_at = Places(own.keys[WORDS]), Places(own.keys[GRAMS])
        end = int(c[words_at.of(np.array([END_WORD]))[0]])
        log = np.log10(c + 0.5)
        size = rows.num_rows
        n_tokens, n_known, logs, score = np.ones(size, np.int64), np.full(size, int(end > 0)), np.full(size, np.log10(end + 0.5)), np.zeros(size)
        for p in pieces(texts):
            words, n = p.words()
            at, cut = words_at.of(words), np.cumsum(n) - n
            sums = lambda v, cut=cut, n=n: np.where(n > 0, np.add.reduceat(np.append(v, 0), cut), 0)
            n_tokens[p.texts] += n
            n_known[p.texts] += sums((c[at] > 0).astype(np.int64))
            logs[p.texts] += sums(log[at])
            score[p.texts] += np.add.reduceat(logp[grams_at.of(p.contexts())].astype(np.float64), p.starts)
        columns = [rows.column("id"), rows.column("learn"), *(pa.array(v) for v in (n_tokens, n_known, logs, score, [learned] + [0] * (size - 1)))]
        return pa.Table.from_arrays([v.cast(f.type) for v, f in zip(columns, done_out)], schema=done_out)

    done = materialize(m.blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(answer, done_schema), "lm-scores")
    n, v = done.agg(F.sum(F.when(F.col("learn"), F.col("n_tokens"))), F.sum("learned")).first()
    n, v = n or 0, v or 0
    per_token = float(np.log10(n + 0.5 * (v + 1)))
    return done.select(
        F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), "score",
    )


def report(docs: DataFrame) -> DataFrame:
    return score_documents(docs)

"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that an earlier document holds too.

A sparse suffix array: of all suffixes, those that start at anchors are sorted. Anchors are the places where a
hash of ``GRAM`` bytes is least among the windows of some string of LENGTH bytes; they depend on that string
alone, so two equal strings hold the same anchor at the same offset, and every string holds one.

1. Blocks of documents ask which anchor hashes other documents have too; the other anchors go.
2. Each block sorts the suffixes at its anchors (LENGTH bytes), each followed by what stands before it, read
   backwards. Equal entries become one, with the smallest id. The sorted run is sent front-coded: the length
   of the prefix shared with the entry before, and the rest; split by anchor hash, so that equal anchors meet.
3. A loser tree merges the runs that meet. It knows the prefix that each entry shares with the last one out,
   compares on from there only, and gives the prefixes shared by neighbours of the merged order. From these and
   the bytes before the anchors follows, for each offset of an anchor in a string, the smallest id that has
   the same string. Entries with a smaller one get a bit for the offset.
4. Each block marks its strings and cuts the covered bytes out. Where its entries stand it has sent along with its
   runs (``state``), so that nothing is searched or sorted twice; its rows have one order whenever they meet.

All comparisons are of bytes; hashes only choose anchors and the place where they meet.

Defined cases: a null or empty text has no bytes; strings cross no document; a text shorter than LENGTH stays
whole; rows that share an id are one document and don't dedupe each other; a null id counts as larger than
any other and removes nothing; ids are whole numbers; a cut may leave broken UTF-8, so kept bytes are binary.

At scale: texts move once, to their block (an exchange that is re-used); of the anchors (one byte in 16) 32
bits, and suffixes only of those found elsewhere too. A string that very many documents hold is one entry a
block. Memory is that of a block, or of the runs of one bucket of hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, _POWERS, arrow_schema, blocked, mix64, ship
from .shared_keys import answers, bucket_bits, bucket_keys, holds, known, runs_of

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM  # bytes of a string that may stand before its anchor
ENTRY = LENGTH + REACH + 2  # suffix, what stands before it, and how much of either the document has
BLOCK_BYTES, CHUNK_BYTES = 8 << 20, 1 << 20
NO_ID = np.iinfo(np.int64).max


def _slide(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """The least (or largest) of each ``n`` neighbours, by doubling."""
    size = 1
    while size * 2 <= n:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def text_chunks(lens: np.ndarray) -> list[tuple[int, int]]:
    """Runs of texts of about ``CHUNK_BYTES``; a longer text is a run of its own."""
    out, at, size = [], 0, 0
    for k, n in enumerate(lens.tolist()):
        if size and size + n > CHUNK_BYTES:
            out.append((at, k))
            at, size = k, 0
        size += n
    return [*out, (at, len(lens))] if at < len(lens) else out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, places and 64-bit hashes of the anchors of some texts."""
    b = np.frombuffer(b"".join(texts), np.uint8)
    if len(b) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    up, down = _POWERS.of(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    h = mix64((total[GRAM:] - total[:-GRAM]) * down[: len(b) - GRAM + 1])
    n = REACH + 1
    least = _slide(h, n, np.minimum)  # of each string
    left = np.repeat(ends, lens)[: len(least)] - np.arange(len(least))
    least[left < LENGTH] = 0  # no string: it would reach into the next text
    edge = np.zeros(n - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), n, np.maximum)
    at = np.flatnonzero((most == h) & (most > 0))
    doc = np.searchsorted(ends, at, side="right")
    return doc, at - (ends - lens)[doc], h[at]


def _press(x: np.ndarray) -> bytes:
    """An array by its bytes' places, compressed, its size in front."""
    import zstandard

    raw = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
    return len(raw).to_bytes(8, "little") + raw


def _unpress(data: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    """The array of ``n`` numbers at a place of ``data``, and how much room it takes there."""
    import zstandard

    size = int.from_bytes(data[at : at + 8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + size]), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T if n else raw).view(kind).reshape(-1), size + 8


class Block:
    """The documents of a block: ids, texts, anchors."""

    def __init__(self, table: pa.Table, bits: int) -> None:
        ids, texts = table.column("id").to_pylist(), [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (NO_ID if ids[k] is None else ids[k], texts[k]))
        self.own_ids, self.texts = [ids[k] for k in order], [texts[k] for k in order]
        self.ids = [NO_ID if k is None else k for k in self.own_ids]
        self.bits = bits
        self.lens = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        # Of equal texts in a block the first id alone has anchors; the others are covered by it.
        first: dict[bytes, int] = {}
        for k, t in sorted(zip(self.ids, self.texts), key=lambda x: x[0]):
            first.setdefault(t, k)
        seen: set[bytes] = set()
        self.leads = []
        for k, t in zip(self.ids, self.texts):
            self.leads.append(first[t] == k and t not in seen)
            if self.leads[-1]:
                seen.add(t)
        self.first = first

    def find(self) -> Block:
        """The anchors of the block: text numbers, places, keys."""
        found = []
        for a, b in text_chunks(self.lens):
            doc, at, h = anchors([t if lead else b"" for t, lead in zip(self.texts[a:b], self.leads[a:b])])
            found.append((doc + a, at, bucket_keys(h, self.bits)))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.found = tuple(np.concatenate(v) for v in zip(none, *found))
        return self

    def keys(self) -> list[np.ndarray]:
        """The distinct keys of each text, all together."""
        doc, _, key = self.found
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])[: len(key)]
        return [key[first]]

    def runs(self, reply_buckets: list[int], reply_bits: list[bytes]) -> None:
        """Makes the sorted entries of the anchors that others have too: per bucket, and where each is in the texts."""
        shared = known(self.keys(), reply_buckets, reply_bits)
        use = holds(shared, self.found[2])
        self.doc, self.place, key = (x[use] for x in self.found)
        bucket = (key >> np.uint64(32)).astype(np.int64)
        rows = []
        for a, b in text_chunks(self.lens):
            first, last = np.searchsorted(self.doc, [a, b])
            if first == last:
                continue
            x = np.frombuffer(b"".join([bytes(REACH), *self.texts[a:b], bytes(LENGTH)]), np.uint8)
            starts = np.cumsum(self.lens[a:b]) - self.lens[a:b]
            doc, at = self.doc[first:last] - a, self.place[first:last]
            around = np.lib.stride_tricks.sliding_window_view(x, REACH + LENGTH)[starts[doc] + at]  # from at - REACH on
            right, left = np.minimum(self.lens[a:b][doc] - at, LENGTH), np.minimum(at, REACH)
            after = np.where(np.arange(LENGTH) < right[:, None], around[:, REACH:], 0)
            before = np.where(np.arange(REACH) < left[:, None], around[:, REACH - 1 :: -1], 0)
            rows.append(np.concatenate([after, before, np.stack([right, left], 1)], 1).astype(np.uint8))
        self.rows = np.concatenate(rows) if rows else np.zeros((0, ENTRY), np.uint8)
        # sorted by bucket, then bytes: the bucket goes in front as two big-endian 32-bit words would
        wide = np.concatenate([bucket.astype(">u4").view(np.uint8).reshape(-1, 4), self.rows], 1) if len(bucket) else np.zeros((0, ENTRY + 4), np.uint8)
        text = wide.tobytes()
        entries = [text[j : j + ENTRY + 4] for j in range(0, len(text), ENTRY + 4)]
        names = {e: k for k, e in enumerate(sorted(set(entries)))}
        self.entry = np.fromiter(map(names.__getitem__, entries), np.int64, len(entries))
        self.sorted = np.frombuffer(b"".join(names), np.uint8).reshape(-1, ENTRY + 4)
        ids = np.array(self.ids, np.int64)
        self.least = np.full(len(names), NO_ID, np.int64)
        np.minimum.at(self.least, self.entry, ids[self.doc])
        self.buckets = self.sorted[:, :4].copy().view(">u4").reshape(-1).astype(np.int64)

    def front_coded(self) -> list[tuple[int, bytes, bytes, bytes]]:
        """(bucket, shared prefix lengths, the rest of each entry, least ids) of each bucket's run."""
        out = []
        for a, b in zip(*runs_of(self.buckets)):
            run = self.sorted[a:b, 4:]
            shared = np.zeros(len(run), np.uint8)
            shared[1:] = (run[1:] != run[:-1]).argmax(axis=1)  # entries are distinct
            out.append((int(self.buckets[a]), shared.tobytes(), run[np.arange(ENTRY) >= shared[:, None]].tobytes(), self.least[a:b].astype("<i8").tobytes()))
        return out

    def state(self) -> bytes:
        """Where the entries stand, their numbers, which of them an earlier text of the block has, and the entries of each bucket."""
        ids = np.array(self.ids, np.int64)
        place = (np.cumsum(self.lens) - self.lens)[self.doc] + self.place
        later = np.packbits(ids[self.doc] > self.least[self.entry])
        first, ends = runs_of(self.buckets)
        parts = [np.diff(place, prepend=0).astype("<u4"), self.entry.astype("<u4"), later, self.buckets[first].astype("<u4"), (ends - first).astype("<u4")]
        return b"".join(len(p).to_bytes(8, "little") + _press(p) for p in parts)

    def load(self, state: bytes) -> list[int]:
        """Takes what ``state`` gave; the buckets in the order of their entries."""
        parts, at = [], 0
        for kind in ("<u4", "<u4", "u1", "<u4", "<u4"):
            n = int.from_bytes(state[at : at + 8], "little")
            part, size = _unpress(state, at + 8, n, kind)
            parts.append(part)
            at += 8 + size
        place, self.entry, later, buckets, self.sizes = (p.astype(np.int64) if k != 2 else p for k, p in enumerate(parts))
        place = np.cumsum(place)
        starts = np.cumsum(self.lens) - self.lens
        self.doc = np.searchsorted(starts, place, side="right") - 1
        self.place = place - starts[self.doc]
        self.later = np.unpackbits(later)[: len(place)].astype(bool)
        return buckets.tolist()

    def removed(self, masks: np.ndarray) -> list[np.ndarray]:
        """For each text which bytes go; ``masks`` has a bit for each entry and offset."""
        n_right, n_left = np.minimum(self.lens[self.doc] - self.place, LENGTH), np.minimum(self.place, REACH)
        later = self.later  # its own block has an earlier one with all of the entry
        mask = np.where(later, np.uint32((1 << (REACH + 1)) - 1), masks[self.entry] if len(masks) else np.uint32(0))
        starts = np.cumsum(self.lens) - self.lens
        place = starts[self.doc] + self.place
        size = int(self.lens.sum()) + 1
        edge = np.zeros(size, np.int32)
        for o in range(REACH + 1):  # strings end within their text, so texts can lie one behind the other
            hit = place[(n_left >= o) & (n_right >= LENGTH - o) & ((mask >> np.uint32(o)) & np.uint32(1)).astype(bool)] - o
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + LENGTH, -1)
        covered = np.cumsum(edge, out=edge)[:-1] > 0
        gone = [covered[a : a + n].copy() for a, n in zip(starts.tolist(), self.lens.tolist())]
        for k, (t, lead) in enumerate(zip(self.texts, self.leads)):
            if not lead and len(t) >= LENGTH:
                if self.ids[k] > self.first[t]:
                    gone[k][:] = True
                else:  # another row of the same id
                    gone[k] = gone[next(j for j, u in enumerate(self.texts) if u == t and self.leads[j])].copy()
        return gone


class LoserTree:
    """Merges front-coded sorted runs. ``shared[r]`` is the prefix that run r's entry shares with the last one out."""

    def __init__(self, runs: list[tuple[bytes, bytes]]) -> None:
        self.runs = [(s, rest) for s, rest in runs]
        n = 1
        while n < len(runs):
            n *= 2
        self.n = n
        self.next = [0] * n
        self.at = [0] * n
        self.entry: list[bytes | None] = [None] * n
        self.shared = [0] * n
        for r in range(len(runs)):
            self._advance(r)
        self.loser = [0] * n
        self.top = self._play(1)

    def _advance(self, r: int) -> None:
        """The run's next entry, made from the one before."""
        shared, rest = self.runs[r]
        k = self.next[r]
        if k >= len(shared):
            self.entry[r] = None
            return
        h, at = shared[k], self.at[r]
        end = at + ENTRY - h
        self.entry[r] = (self.entry[r][:h] if h else b"") + rest[at:end]
        self.next[r], self.at[r], self.shared[r] = k + 1, end, h

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser): the smaller entry wins. Bytes are compared only beyond what both share with the last one out."""
        x, y = self.entry[a], self.entry[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        ha, hb = self.shared[a], self.shared[b]
        if ha != hb:  # who shares more with the last one out is closer to it
            return (a, b) if ha > hb else (b, a)
        if x[ha:] == y[ha:]:
            self.shared[b] = ENTRY
            return a, b
        h = ha
        while x[h : h + 8] == y[h : h + 8]:
            h += 8
        while x[h] == y[h]:
            h += 1
        if x[h] < y[h]:
            self.shared[b] = h
            return a, b
        self.shared[a] = h
        return b, a

    def _play(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        winner, self.loser[node] = self._match(self._play(2 * node), self._play(2 * node + 1))
        return winner

    def __iter__(self):  # noqa: ANN204
        """(run, its entry's number, entry, prefix shared with the one before) in order."""
        while self.entry[self.top] is not None:
            r = self.top
            yield r, self.next[r] - 1, self.entry[r], self.shared[r]
            self._advance(r)
            node = (r + self.n) >> 1
            while node:
                r, self.loser[node] = self._match(r, self.loser[node])
                node >>= 1
            self.top = r


def offsets_with_earlier(entries: np.ndarray, shared: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each merged entry a bit for each offset at which a smaller id has the same string."""
    n = len(entries)
    masks = np.zeros(n, np.uint32)
    n_right, n_left = entries[:, -2].astype(np.int64), entries[:, -1].astype(np.int64)
    before = np.zeros(n, np.int64)  # class of the bytes before the anchor, one byte more with each offset
    for o in range(REACH + 1):
        if o:
            before = np.unique(before * 256 + entries[:, LENGTH + o - 1], return_inverse=True)[1]
        use = np.flatnonzero((n_left >= o) & (n_right >= LENGTH - o))
        if len(use) < 2:
            continue
        after = np.cumsum(shared < LENGTH - o)  # class of the LENGTH - o bytes from the anchor on
        same = np.unique(after[use] * (int(before.max()) + 1) + before[use], return_inverse=True)[1]
        least = np.full(int(same.max()) + 1, NO_ID, np.int64)
        np.minimum.at(least, same, ids[use])
        masks[use[least[same] < ids[use]]] |= np.uint32(1 << o)
    return masks


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept, n_bytes, n_removed, n_spans) of every row of ``docs``; kept is binary."""
    ship(docs.sparkSession)
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.octet_length("text")
    bits = bucket_bits(x.agg(F.sum(size)).first()[0] or 0)
    x = blocked(x, "id", size, BLOCK_BYTES)
    replies = answers(x, lambda table: Block(table, bits).find().keys())

    run_schema = T.StructType.fromDDL("bucket int, block int, shared binary, rest binary, ids binary")
    run_out = arrow_schema(run_schema)

    def send(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return run_out.empty_table()
        block = Block(table, bits).find()
        block.runs(reply.column("bucket").to_pylist(), reply.column("shared").to_pylist())
        own = table.column("block")[0].as_py()
        rows = [(b, own, s, r, i) for b, s, r, i in block.front_coded()]
        rows.append((-1 - own, own, block.state(), None, None))  # to be handed on to the last step, under a number of its own
        return pa.Table.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(run_out)], schema=run_out)

    mask_schema = T.StructType.fromDDL("block int, bucket int, masks binary")
    mask_out = arrow_schema(mask_schema)

    def merge(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return pa.Table.from_arrays([table.column(c).combine_chunks() for c in ("block", "bucket", "shared")], schema=mask_out)
        runs = list(zip(table.column("shared").to_pylist(), table.column("rest").to_pylist()))
        run_of, number, entries, shared = [], [], [], []
        for r, k, e, h in LoserTree(runs):
            run_of.append(r)
            number.append(k)
            entries.append(e)
            shared.append(h)
        ids = [np.frombuffer(i, "<i8") for i in table.column("ids").to_pylist()]
        starts = np.cumsum([0, *map(len, ids)])
        at = starts[np.array(run_of)] + np.array(number)
        rows = np.frombuffer(b"".join(entries), np.uint8).reshape(-1, ENTRY)
        masks = np.zeros(len(at), np.uint32)
        masks[at] = offsets_with_earlier(rows, np.array(shared, np.int64), np.concatenate(ids)[at])
        parts = [masks[a:b].astype("<u4").tobytes() for a, b in zip(starts, starts[1:])]
        return pa.Table.from_arrays([table.column("block").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(parts, pa.binary())], schema=mask_out)

    masks = x.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(send, run_schema).groupBy("bucket").applyInArrow(merge, mask_schema)
    kept_schema = T.StructType.fromDDL("id long, kept binary, n_bytes long, n_removed long, n_spans long")
    kept_out = arrow_schema(kept_schema)

    def cut(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return kept_out.empty_table()
        block = Block(table, bits)
        found = dict(zip(reply.column("bucket").to_pylist(), reply.column("masks").to_pylist()))
        parts = [np.frombuffer(found[b], "<u4") for b in block.load(next(m for b, m in found.items() if b < 0))]
        gone = block.removed(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
        kept = [t if not g.any() else np.frombuffer(t, np.uint8)[~g].tobytes() for t, g in zip(block.texts, gone)]
        spans = [int((np.diff(np.concatenate([[0], g.view(np.int8)])) == 1).sum()) for g in gone]
        cols = (block.own_ids, kept, [len(t) for t in block.texts], [int(g.sum()) for g in gone], spans)
        return pa.Table.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(cols, kept_out)], schema=kept_out)

    return x.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(cut, kept_schema).withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    return cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

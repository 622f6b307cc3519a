"""Benchmark decontamination: a BM25 index of test items, queried with every passage by block-max WAND.

Items are indexed by word with BM25 impacts, each divided by the item's score for itself, so that a
passage's score is the share of the item it holds. Postings are kept in blocks with their largest
impact; list and block bounds skip whatever cannot reach ``THRESHOLD``. All items at or above it are
retrieved, and each is verified: the share of its words that stand in the passage in the item's order, within
half as many words again as it has, must reach ``OVERLAP``, and in that place the question (the item without its
last quarter) ``QUESTION`` and the answer (the last quarter) ``ANSWER``; an edited word takes one word of a share, so a
question without its answer is clean, and an item with a word or two changed anywhere is found. An item shorter than ``SHORT_WORDS`` must stand there whole. Passages are windows of words, each
overlapping the next by half, at least twice as long as the longest item: any copy of an item lies
whole in one of them. Before the search, a passage is held against the largest impacts of groups of
items: only one whose bound reaches the threshold in some group is searched.

Defined cases: a null or empty text has no passage and is clean; null or wordless items are left out;
equal items are each found; an empty benchmark finds nothing; ties don't arise, since all items over the
threshold count; a document's hits are sorted by item, one each, with the best score; further columns
pass through, and a column named like an added one gives way.

At scale: documents aren't shuffled. The benchmark is read in parts of ``PART_ITEMS`` items, whose size in
bytes is checked first, each sent with one pass over the documents: a query set against all rows, in blocks. Document
frequencies, the number of items and their mean length are counted over all items, so parts change no score.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, arrow_schema, map_arrow, materialize, with_columns

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, QUESTION, ANSWER, BLOCK = 0.6, 0.6, 0.5, 0.5, 64
MIN_WINDOW = 128
#: A part of the benchmark holds at most so many items, and so many bytes of text.
PART_ITEMS, PART_BYTES = 4_096, 16 << 20
#: Items are bounded together in groups of so many, or in so many groups if those are larger.
GROUP, MAX_GROUPS = 4, 64
#: Texts whose passages are bounded at a time.
TEXTS = 64
#: Items that occur in no real text by chance need so many words; shorter ones must be held whole.
SHORT_WORDS = 8
WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall


def words_of(text: str | None) -> list[str]:
    return WORDS(text.lower()) if text else []


def in_order(item: list[str], words: list[str]) -> tuple[int, int]:
    """The most words of ``item`` that stand in its order within half as many words again as it has, and where these start."""
    at: dict[str, int] = defaultdict(int)
    for k, w in enumerate(item):
        at[w] |= 1 << k
    masks = [at.get(w, 0) for w in words]
    span, full = len(item) + len(item) // 2, (1 << len(item)) - 1
    best, place = 0, 0
    for start in range(len(words)):
        if not masks[start]:
            continue
        near = [m for m in masks[start : start + span] if m]
        if len(near) <= best:
            continue
        v = full  # longest common subsequence, a bit each word of the item
        for m in near:
            u = v & m
            v = ((v + u) | (v - u)) & full
        n = len(item) - v.bit_count()
        if n > best:
            best, place = n, start
    return best, place


def holds_whole(item: list[str], words: list[str]) -> bool:
    n = len(item)
    return any(words[k : k + n] == item for k in range(len(words) - n + 1))


class Index:
    """Postings by term number: item numbers, impacts, and the largest impact of each block and list.

    ``whole``: of the whole benchmark, the number of items, their mean length, and the items that hold each of these items'
    words; counted from ``items`` if they are all there are.
    """

    def __init__(self, items: list[tuple[object, str]], whole: tuple[int, float, dict[str, int]] | None = None) -> None:
        own = [(key, w) for key, text in items if (w := words_of(text))]
        self.keys = [k for k, _ in own]
        self.longest = max((len(w) for _, w in own), default=0)
        mean = sum(len(w) for _, w in own) / max(1, len(own))
        df: dict[str, int] = Counter(t for _, w in own for t in set(w))
        n = len(own)
        total, mean, held = whole or (n, mean, df)
        idf = {t: math.log(1 + (total - held[t] + 0.5) / (held[t] + 0.5)) for t in df}
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for at, (_, w) in enumerate(own):
            tf = Counter(w)
            impact = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            whole = sum(impact.values())
            for t, x in impact.items():
                lists[self.terms[t]].append((at, x / whole))
        self.items = [[p[0] for p in lists[k]] for k in range(len(self.terms))]
        self.impacts = [[p[1] for p in lists[k]] for k in range(len(self.terms))]
        self.block_max = [[max(x[j : j + BLOCK]) for j in range(0, len(x), BLOCK)] for x in self.impacts]
        self.bound = [max(x) for x in self.block_max]
        each = max(GROUP, -(-n // MAX_GROUPS))
        self.group_max = np.zeros((len(self.terms), max(1, -(-n // each))), np.float32)
        for k, (at, x) in enumerate(zip(self.items, self.impacts)):
            np.maximum.at(self.group_max[k], np.array(at) // each, np.array(x, np.float32))
        self.half = max(MIN_WINDOW // 2, self.longest)
        self.words = [w for _, w in own]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item number, score) of all items that reach the threshold, by block-max WAND."""
        items, impacts, bound, block_max = self.items, self.impacts, self.bound, self.block_max
        threshold -= 1e-9  # of float sums
        open_ = [[items[t][0], t, 0] for t in terms]  # item now at, term, position
        out = []
        while open_:
            open_.sort()
            total, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(open_):
                total += bound[t]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return out
            goal = open_[pivot][0]
            while pivot + 1 < len(open_) and open_[pivot + 1][0] == goal:
                pivot += 1
            # bounds of the blocks that hold the pivot's item, and where the first of them ends
            near, ends = 0.0, math.inf
            for x in open_[: pivot + 1]:
                t, p = x[1], x[2]
                j = p if x[0] == goal else bisect_left(items[t], goal, p)
                if j < len(items[t]):
                    b = j // BLOCK
                    near += block_max[t][b]
                    ends = min(ends, items[t][min((b + 1) * BLOCK, len(items[t])) - 1])
            if near < threshold:
                after = min(ends + 1, open_[pivot + 1][0] if pivot + 1 < len(open_) else math.inf)
                goal, score = max(goal + 1, after), None
            elif open_[0][0] == goal:
                score = 0.0
                for x in open_[: pivot + 1]:
                    score += impacts[x[1]][x[2]]
                if score >= threshold:
                    out.append((goal, score))
                goal += 1
            for x in open_[: pivot + 1]:
                if x[0] < goal:
                    x[2] = bisect_left(items[x[1]], goal, x[2]) if goal != math.inf else len(items[x[1]])
                    x[0] = items[x[1]][x[2]] if x[2] < len(items[x[1]]) else -1
            open_ = [x for x in open_ if x[0] >= 0]
        return out

    def passages(self, texts: list[list[str]]) -> list[list[tuple[int, list[int]]]]:
        """For each text the passages (number, terms) that can reach the threshold, by the group bounds."""
        get, half, n_terms = self.terms.get, self.half, max(1, len(self.terms))
        out: list[list[tuple[int, list[int]]]] = [[] for _ in texts]
        keys, owner, number = [], [], []
        for k, words in enumerate(texts):
            ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            at = np.flatnonzero(ids >= 0)
            if not len(at):
                continue
            last = max(1, -(-len(words) // half) - 1) - 1  # the last passage's number
            h = at // half
            base = len(owner)
            owner += [k] * (last + 1)
            number += range(last + 1)
            for passage in (np.minimum(h, last), np.clip(h - 1, 0, last)):
                keys.append((base + passage) * n_terms + ids[at])
        if not keys:
            return out
        pairs = np.unique(np.concatenate(keys))
        passage, term = pairs // n_terms, pairs % n_terms
        first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        ends = np.append(first[1:], len(pairs))
        step = 4096  # passages summed at a time
        for j in range(0, len(first), step):
            lo, hi = first[j], ends[min(j + step, len(first)) - 1]
            bound = np.add.reduceat(self.group_max[term[lo:hi]], first[j : j + step] - lo, axis=0).max(axis=1)
            for m in np.flatnonzero(bound >= THRESHOLD - 1e-4) + j:
                p = int(passage[first[m]])
                out[owner[p]].append((number[p], term[first[m] : ends[m]].tolist()))
        return out

    def hits(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text: item number → (score, question share, answer share) of the verified items."""
        out = []
        for j in range(0, len(texts), TEXTS):
            words = [words_of(t) for t in texts[j : j + TEXTS]]
            out += [self._verified(w, p) for w, p in zip(words, self.passages(words))]
        return out

    def _verified(self, words: list[str], passages: list[tuple[int, list[int]]]) -> dict[int, tuple[float, float, float]]:
        found: dict[int, tuple[float, float, float]] = {}
        for k, terms in passages:
            for item, score in self.search(terms, THRESHOLD):
                if item in found and found[item][0] >= score:
                    continue
                own = self.words[item]
                n, at = in_order(own, passage := words[k * self.half : (k + 2) * self.half])
                if not (holds_whole(own, passage) if len(own) < SHORT_WORDS else n >= OVERLAP * len(own)):
                    continue
                cut, near = len(own) - max(1, len(own) // 4), passage[at : at + len(own) + len(own) // 2]
                question, answer = own[:cut], own[cut:]
                parts = in_order(question, near)[0] / len(question) if question else 1.0, in_order(answer, near)[0] / len(answer)
                if parts[0] >= QUESTION and parts[1] >= ANSWER:
                    found[item] = (score, *parts)
        return found


HIT = [T.StructField(k, T.DoubleType()) for k in ("score", "question", "answer")]


def search_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with hits: array<struct<item_id, score, question, answer>>, sorted by item."""
    kind = items.schema[item_id].dataType
    hit = T.StructType([T.StructField("item_id", kind), *HIT])
    out = docs.withColumn("hits", F.array().cast(T.ArrayType(hit)))
    bench = items.select(F.col(item_id).alias("k"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull() & F.col("k").isNotNull())
    n, size = bench.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(1, -(-n // PART_ITEMS), -(-size // PART_BYTES))
    if parts == 1:
        rows = bench.collect() if n else []
        return _search_part(out, Index(sorted((r[0], r[1]) for r in rows)), text_col) if rows else out
    held = materialize(item_words(bench.withColumn("part", F.pmod(F.xxhash64("k", "t"), F.lit(parts)).cast("int"))), "item-words")
    total, mean = held.filter("word = ''").agg(F.count(F.lit(1)), F.avg("n")).first()
    counts = materialize(held.filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.collect_set("part").alias("parts")), "item-word-counts")
    for p in range(parts):
        mine = bench.filter(F.pmod(F.xxhash64("k", "t"), F.lit(parts)) == p)
        df = {r[0]: r[1] for r in counts.filter(F.array_contains("parts", p)).select("word", "df").collect()}
        index = Index(sorted((r[0], r[1]) for r in mine.collect()), (total, mean, df))  # a part's size is bounded above
        out = _search_part(out, index, text_col)
    return out


def item_words(bench: DataFrame) -> DataFrame:
    """(part, word, n): the distinct words of each item, and a row without a word that has its length."""
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    out = arrow_schema(schema)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for part, text in zip(b.column("part").to_pylist(), b.column("t").to_pylist()):
            w = words_of(text)
            rows += [(part, "", len(w))] * bool(w) + [(part, x, 1) for x in sorted(set(w))]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(out)], schema=out)

    return map_arrow(bench, run, schema)


def _search_part(docs: DataFrame, index: Index, text_col: str) -> DataFrame:
    schema = added(docs.schema, hits=docs.schema["hits"].dataType)
    out = arrow_schema(schema)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hits = []
        for found, before in zip(index.hits(b.column(text_col).to_pylist()), b.column("hits").to_pylist()):
            new = [{"item_id": index.keys[k], "score": s, "question": q, "answer": a} for k, (s, q, a) in found.items()]
            hits.append(sorted((before or []) + new, key=lambda h: h["item_id"]))
        return with_columns(b, out, hits=hits)

    return map_arrow(docs, run, schema)


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    return search_documents(docs, items).filter(F.size("hits") == 0).drop("hits")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items (sorted ids), best_score (0 without a hit)."""
    x = search_documents(docs.select("doc_id", "text"), items)
    return x.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"),
        F.col("hits.item_id").alias("items"), F.coalesce(F.array_max("hits.score"), F.lit(0.0)).alias("best_score"),
    )

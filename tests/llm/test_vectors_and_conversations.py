"""Hard negatives, the prefix trie and the multi-index against brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from hearsay.llm import hard_negatives, multi_index, prefix_trie

EMBEDDINGS = "vec_id long, embedding array<float>, label int, id string, v string, block string, cell string, rank string, score string, mean string"
CONVERSATIONS = "conv_id long, turn long, role string, text string, turns string, base string, n string, depth string"


def embeddings_rows(n=700, width=24, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width)) / math.sqrt(width)
    v[200:260] = v[200] + rng.normal(size=(60, width)) * 0.01  # near copies
    v[300:340] = v[300]  # exact copies: ties
    rows = [[k, [float(np.float32(x)) for x in v[k]], int(rng.integers(0, 4))] for k in range(n)]
    rows[50][1] = None
    rows[51][1][3] = None
    rows[52][1][3] = float("nan")
    rows[53][1][3] = float("inf")
    rows[54][1] = [0.0] * width
    rows[55][1] = []
    rows[56][1] = rows[56][1][:7]
    rows[57][2] = None
    rows.append([None, rows[1][1], 1])
    rows += [list(rows[100]), list(rows[150])]  # repeated rows, of which one is an anchor and a query
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def vectors():
    return embeddings_rows()


@pytest.fixture(scope="module")
def embeddings(spark, vectors):
    return spark.createDataFrame([(*r, *"abcdefg") for r in vectors], EMBEDDINGS).repartition(4)


def clean(rows, labelled):
    out = {}
    for i, v, label in rows:
        if i is None or v is None or (labelled and label is None) or any(x is None or not math.isfinite(x) for x in v):
            continue
        out[i] = (v + [0.0] * (24 - len(v)), label)
    return out


def brute_negatives(rows):
    kept = {i: ([math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, (v, label) in clean(rows, True).items()}
    ids = sorted(kept)
    m, label = np.array([kept[i][0] for i in ids]), np.array([kept[i][1] for i in ids])
    out = set()
    for k, i in enumerate(ids):
        if i % 50:
            continue
        score = m @ m[k]
        order = sorted(range(len(ids)), key=lambda j: (-score[j], ids[j]))
        for p in [j for j in order if label[j] == label[k] and j != k][:5]:
            hard = [j for j in order if label[j] != label[k] and 50 * score[p] <= 100 * score[j] <= 95 * score[p]][:3]
            out |= {(i, ids[p], r + 1, ids[j], int(score[p]), int(score[j])) for r, j in enumerate(hard)}
    return out


def test_hard_negatives(embeddings, vectors):
    got = [tuple(r) for r in hard_negatives.report(embeddings).collect()]
    want = brute_negatives(vectors)
    assert len(got) == len(set(got)) and set(got) == want and want


def test_hard_negatives_blocks_and_chunks(embeddings, vectors, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(hard_negatives, "BATCH", 16)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = hard_negatives.mine(embeddings.select("vec_id", "embedding", moved.alias("label")), F.col("id") % 50 == 0, block_bytes=1500)
    assert {tuple(r) for r in x.collect()} == brute_negatives(vectors)


def test_segment_bounds_hold_and_narrow():
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(size=(60, 48)) * 80)
    mean, dev = hard_negatives.summarise(v, hard_negatives.NARROW)
    wide = hard_negatives.widened(mean, dev, hard_negatives.WIDE // hard_negatives.NARROW, hard_negatives.NARROW)
    for x, y in zip(wide, hard_negatives.summarise(v, hard_negatives.WIDE)):
        assert np.allclose(x, y)
    spreads = []
    for n, (m, d) in ((hard_negatives.WIDE, wide), (hard_negatives.NARROW, (mean, dev))):
        gap = np.abs(v @ v.T - n * (m @ m.T))
        assert (gap <= d @ d.T + 1e-6).all()
        spreads.append((d @ d.T).mean())
    assert spreads[1] < spreads[0]


def test_scores_beyond_floating_point_are_exact():
    a = np.array([[2.0**20 - 1] * 8192, [1.0] * 8192])
    assert hard_negatives.exact(a, a, np.array([0, 0]), np.array([0, 1])).tolist() == [(2**20 - 1) ** 2 * 8192, (2**20 - 1) * 8192]


def brute_neighbours(rows, k=10):
    kept = {i: v for i, (v, _) in clean(rows, False).items() if any(v)}
    ids = np.array(sorted(kept))
    m = np.array([kept[i] for i in ids])
    out = {}
    for n, i in enumerate(ids):
        if i % 100 == 0:
            d = np.sqrt(((m - m[n]) ** 2).sum(1))
            out[int(i)] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if j != n][:k]
    return out


@pytest.mark.parametrize("block_bytes", [multi_index.BLOCK_BYTES, 2000])
def test_multi_index_recall(embeddings, vectors, block_bytes):
    from pyspark.sql import functions as F

    want = brute_neighbours(vectors)
    got = {}
    for r in multi_index.neighbours(embeddings, F.col("id") % 100 == 0, block_bytes=block_bytes).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, x in got.items():
        x.sort()
        assert [r for r, _, _ in x] == list(range(1, 11)) and [(s, i) for _, i, s in x] == sorted((s, i) for _, i, s in x)
        hits += len({i for _, i, _ in x} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    assert [i for _, i, _ in got[300]] == [i for i, _ in want[300]]  # exact copies: the smallest ids


def test_multi_index_is_exact_at_the_triangle_bound(embeddings, vectors):
    from pyspark.sql import functions as F

    want = brute_neighbours(vectors)
    rows = multi_index.neighbours(embeddings, F.col("id") % 100 == 0, margin=math.sqrt(24)).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in rows} == {(q, k + 1, i) for q, x in want.items() for k, (i, _) in enumerate(x)}
    assert all(abs(r.score - dict(want[r.query_id])[r.vec_id]) < 1e-12 for r in rows)


def test_few_rows_give_all_candidates(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert [(r.query_id, r["rank"], r.vec_id) for r in multi_index.report(few).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], EMBEDDINGS)
    assert hard_negatives.report(none).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives.report(none).count() == 0
    assert multi_index.report(none).count() == 0
    assert prefix_trie.report(spark.createDataFrame([], CONVERSATIONS)).count() == 0


# ---------------------------------------------------------------------------------------------
def conversation_rows():
    rng = random.Random(8)
    rows = []
    for c in list(range(0, 40)) + list(range(90, 130)) + [250, 399, 1000]:
        for t in range(rng.choice([1, 2, 3, 3, 6])):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["hi", "ho", "", None, "é" * 5])))
    rows += [(7, t, "user", f"long {t % 3}") for t in range(10, 260)]  # a very long conversation
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in (None, 1, 5)]  # copies, null turn first
    rows += [(340, None, "assistant", "first"), (340, 0, "user", "second"), (341, 2, "a", "x"), (341, 2, "a", "x"), (None, 1, "user", "nobody")]
    rng.shuffle(rows)
    return rows


def brute_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    out = set()
    for node, m in members.items():
        subtree = [x for x in members if x[: len(node)] == node]
        inner = {x[:-1] for x in members if x}
        ends = sorted(c for c in m if len(paths[c]) == len(node))
        out.add((
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(x) == len(node) + 1 for x in subtree), sum(x not in inner for x in subtree),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in subtree if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


@pytest.fixture(scope="module")
def conversations(spark):
    rows = conversation_rows()
    return rows, spark.createDataFrame([(*r, *"abcd") for r in rows], CONVERSATIONS).repartition(5)


def test_prefix_trie(conversations):
    rows, table = conversations
    got = [tuple(r) for r in prefix_trie.report(table).select(prefix_trie.RESULT).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_prefix_trie_is_the_same_over_any_ranges(conversations, monkeypatch):
    rows, table = conversations
    monkeypatch.setattr(prefix_trie, "RUN_IDS", 3)
    x = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.hashed(table)), range_bytes=200)
    assert {tuple(r) for r in x.collect()} == brute_trie(rows)

"""The suffix tree of language-model scoring against one in plain Python."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from hearsay.llm import lm_score

SCHEMA = "doc_id long, text string, block string, id string, learn string, g string"


def corpus(n=120, seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(vocab[: 8 + i % 30]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return [*rows, (None, "ab  ABC\tab"), (3, "ab ab"), (3, "ab ab"), (n, None), (n + 1, "\x01\x02 zzz"), (n + 2, "a" * 5000)]


def stream(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def brute(rows, classes):
    """Retained contexts of symbol numbers, and a function that scores a text."""
    learn = [zlib.crc32(str(i).encode()) % 5 != 1 if i is not None else True for i, _ in rows]
    counts = [collections.defaultdict(collections.Counter) for _ in range(lm_score.DEPTH + 1)]

    def grams(text):
        s = [0] * lm_score.DEPTH + [int(classes[b]) for b in stream(text)]
        return [(tuple(s[k - lm_score.DEPTH : k]), s[k]) for k in range(lm_score.DEPTH, len(s))]

    for (_, t), used in zip(rows, learn):
        for c, s in grams(t) if used else ():
            for d in range(lm_score.DEPTH + 1):
                counts[d][c[lm_score.DEPTH - d :]][s] += 1
    kept = set()
    for d in range(1, lm_score.DEPTH + 1):
        for c, n in counts[d].items():
            total, up = sum(n.values()), counts[d - 1][c[1:]]
            gain = sum(x * math.log2((x / total) / (up[s] / sum(up.values()))) for s, x in n.items())
            if total >= lm_score.MIN_SEEN and gain >= lm_score.MIN_GAIN:
                kept |= {c[j:] for j in range(len(c))}

    def prob(c, s):
        if not c:
            n = counts[0][()]
            return (n[s] + 0.5) / (sum(n.values()) + 0.5 * lm_score.ALPHABET)
        n = counts[len(c)][c]
        return (n[s] + lm_score.PRIOR * prob(c[1:], s)) / (sum(n.values()) + lm_score.PRIOR)

    def score(text):
        out = 0.0
        for c, s in grams(text):
            while c and c not in kept:
                c = c[1:]
            out += math.log10(prob(c, s) / int((classes == s).sum()))
        return out

    return kept, score


@pytest.mark.parametrize("seen,gain,block", [(32, 24.0, 8 << 20), (2, 0.5, 900)])
def test_tree_and_scores(spark, monkeypatch, seen, gain, block):
    monkeypatch.setattr(lm_score, "MIN_SEEN", seen)
    monkeypatch.setattr(lm_score, "MIN_GAIN", gain)
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 4 * block)
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 700)
    rows = corpus()
    docs = spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA).repartition(3)
    m = lm_score.learn(docs)
    kept, score = brute(rows, np.array(m.classes))
    got = {tuple((r.ctx // 64 ** (d - 1 - j)) % 64 for j in range(d)) for d in range(1, lm_score.DEPTH + 1) for r in m.contexts[d].collect()}
    assert got == kept and kept
    out = collections.defaultdict(list)
    for r in lm_score.report(docs).collect():
        out[r.doc_id].append(r.score)
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append(score(t))
    assert set(out) == set(want)
    for i in want:
        assert sorted(out[i]) == pytest.approx(sorted(want[i]), rel=1e-5)


def test_the_tree_grows_with_the_corpus(spark):
    sizes = []
    for n in (60, 600):
        docs = spark.createDataFrame([(*r, *"abcd") for r in corpus(n)], SCHEMA)
        sizes.append(sum(x.count() for x in lm_score.learn(docs).contexts[1:]))
    assert sizes[1] > 1.3 * sizes[0]
    assert not hasattr(lm_score, "MAX_STATES")

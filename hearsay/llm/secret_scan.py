"""Secret scans: three base patterns, and a character convolutional network over every other candidate.

Base findings are the leftmost non-overlapping matches per kind that are long enough. Further
candidates are maximal runs of ``MIN_RUN`` and more credential characters that no base finding touches and that aren't
plainly a word (a digit, capitals inside, or ``LONG_RUN`` characters); the network sees each with its
surrounding context, in windows over the whole run, and adds a span (kind ``net``) where the calibrated
probability of any window reaches the threshold.

Training: labelled findings are taken from all texts of the same table. The values of base findings are
secrets; as such tokens come in many shapes, each is also altered (``ALPHABETS``: other characters, lengths and
prefixes) and put into the context of ordinary text, so that neither the keyword nor the base patterns' alphabet is
what is learned. Ordinary words (all of the table), and identifiers, paths, file names, dates and numbers made of them,
aren't secrets, nor are runs of digits. Scores are calibrated (a logistic fit) on findings set aside. The threshold is
the largest that keeps ``RECALL`` of the secrets of kinds that the network has never seen (``UNSEEN``).

Defined cases: a null or empty text has no spans; base_sha256 of no span is that of an empty string;
with fewer than ``MIN_FINDINGS`` base findings or distinct words in the table no network is trained and only base spans are
returned; equal findings in equal surroundings are learned as one; the network depends on the texts alone, not on their ids or
partitions; equal texts get equal spans; offsets are code points, the end exclusive; spans are sorted by
start, then kind (assign, access, hex, net); further columns pass through, and a column named like an
added one gives way.

At scale: one pass over all texts writes the labelled findings, words and contexts. A hash deals them into blocks of about
``BLOCK_BYTES`` of text, the blocks into ``ROUNDS`` rounds and one that is set aside. In a round each block is a group that makes its
examples and trains on them from the last round's network; the means of the blocks' networks, summed as whole numbers, are
the next one. Calibration and threshold come from counts of rounded scores. Nothing is capped: each finding, number and word
is in an example, findings and words are only used more often where they are few. Then one pass over all texts without a
shuffle. The network travels with the tasks (some 20 KB).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cnn import ByteCNN
from .common import added, arrow_schema, map_arrow, materialize, ship, small_batches, struct, with_columns

KINDS = ("assign", "access", "hex", "net")
#: The base patterns and the lengths that their findings need.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)  # maximal runs of 24 and more: the same as dropping shorter ones
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

MIN_RUN, LONG_RUN = 12, 20
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
INSIDE = re.compile(r"[0-9]|[a-z][A-Z]|[A-Z]{2}[A-Za-z+/_=-]*[a-z]")
WORD = re.compile(r"[^\W\d_]{3,}")

#: Shapes that labelled secrets are altered to, and those of them that only the threshold sees.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "hex": DIGITS + "abcdef", "upper_hex": DIGITS + "ABCDEF", "base32": UPPER + "234567", "lower36": LOWER + DIGITS, "upper36": UPPER + DIGITS,
    "base62": LOWER + UPPER + DIGITS, "base64": LOWER + UPPER + DIGITS + "+/", "base64url": LOWER + UPPER + DIGITS + "-_", "letters": LOWER + UPPER, "lower": LOWER,
}
UNSEEN = ("base62", "upper36", "lower36")

#: Window: context before, a slice of the candidate, context after.
BEFORE, SLICE, AFTER = 20, 44, 8
LENGTH = BEFORE + SLICE + AFTER
#: Training (documented parameters): base findings and words that it needs, rounds, text a block, secrets that a block makes at least,
#: findings (numbers, words, contexts) that it holds at least where the table has as many, how far apart a text's contexts lie,
#: and what the threshold must keep.
MIN_FINDINGS, ROUNDS, BLOCK_BYTES, LEAST, HELD, APART = 12, 5, 4 << 20, 4_000, 64, 1_000
#: A task's distinct words leave it when they are about as many.
TOLD = 300_000
#: Scores are counted, and weights summed, in units of one in so many.
SCORE, WEIGHT = 256, 1 << 32
RECALL = 0.98


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind number, end) of the base findings, sorted; and the runs that no base finding touches, without plain words."""
    runs = [m.span() for m in RUN.finditer(text)]
    base = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # Such characters are of a run's, so their runs lie within those.
    base += [(m.start(), 2, m.end()) for a, e in runs if e - a >= MIN_HEX for m in HEX.finditer(text, a, e)]
    base.sort()
    asked = [(a, e) for a, e in runs if e - a >= LONG_RUN or INSIDE.search(text, a, e)]
    if asked and base:
        asked = [(a, b) for a, b in asked if not any(s < b and a < e for s, _, e in base)]
    return base, asked


def windows(text: str, start: int, end: int) -> list[bytes]:
    """The candidate, slice by slice, each with what stands around it; LENGTH bytes each."""
    out = []
    for a in range(start, end, SLICE):
        b = min(a + SLICE, end)
        before = text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0")
        body = text[a:b].ljust(SLICE, "\0")
        after = text[b : b + AFTER].ljust(AFTER, "\0")
        # one byte a character: what isn't Latin-1 is only context
        out.append((before + body + after).encode("latin-1", "replace"))
    return out


@dataclass
class Detector:
    net: ByteCNN
    slope: float
    shift: float
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.net.logits(x).astype(np.float64)
        return self.calibrated(z[:, 1] - z[:, 0])

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))


LABELLED = struct("kind string, before string, body string, after string")


def labelled(text: str) -> tuple[list[tuple[str, str, str, str]], list[str]]:
    """(kind, before, body, after) of a text's base findings, runs of digits and contexts; and the parts of it that hold its ordinary words."""
    rows: list[tuple[str, str, str, str]] = []
    put = lambda kind, a, e, body: rows.append((kind, text[max(0, a - BEFORE) : a], body, text[e : e + AFTER]))
    base, asked = spans_of(text)
    for start, kind, end in base:
        if not (kind == 2 and any(k == 0 and s <= start and end <= e for s, k, e in base)):  # the same value once
            a = ASSIGN.match(text, start).start(2) if kind == 0 else start
            put("secret", a, end, text[a:end])
    for a, e in asked:
        if text[a:e].isdigit():
            put("number", a, e, text[a:e])
    # Neither pieces of findings nor of what the network is asked about are ordinary words.
    taken = sorted([(s, e) for s, _, e in base] + asked)
    for p in range(0, len(text), APART):
        m = WORD.search(text, p)
        if m and not any(s < m.end() and m.start() < e for s, e in taken):
            put("context", m.start(), m.end(), "")
    parts, at = [], 0
    for s, e in taken:
        parts.append(text[at:s])
        at = max(at, e)
    return rows, [*parts, text[at:]]


def findings(docs: DataFrame, text_col: str) -> DataFrame:
    """``labelled`` of all rows, the words as rows of kind word; of equal rows some are left out where they lie."""
    out = arrow_schema(LABELLED)

    def batch(rows: Iterable[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()

        def words() -> pa.RecordBatch:
            return batch([("word", None, w, None) for w in {w for t in held for w in WORD.findall(t)}])

        for b in small_batches(batches):
            found: set[tuple] = set()
            for text in b.column(0).to_pylist():
                rows, parts = labelled(text or "")
                found.update(rows)
                for part in parts:
                    held.update(part.split())  # no word crosses white space, and equal pieces are looked at once
            yield batch(found)
            if len(held) >= TOLD:
                yield words()
                held.clear()
        yield words()

    ship(docs.sparkSession)
    return docs.select(text_col).mapInArrow(run, LABELLED)


def altered(rng: random.Random, kind: str, length: int) -> str:
    """A token of another shape, of about the length of a labelled one."""
    least = 24 if kind in ("letters", "lower") else MIN_RUN
    n = rng.randrange(least, 40) if rng.random() < 0.6 else min(max(length + rng.randrange(-8, 17), least), 64)
    body = "".join(rng.choices(ALPHABETS[kind], k=n))
    if kind == "base64":
        body += "=" * rng.randrange(0, 3)
    if rng.random() < 0.25:
        body = "".join(rng.choices(LOWER, k=rng.randrange(2, 5))) + "_-"[rng.randrange(2)] + body
    return body


class Words:
    """Words in a drawn order, again and again."""

    def __init__(self, rng: random.Random, words: list[str]) -> None:
        self.words = rng.sample(words, len(words))
        self.used = 0

    def __call__(self, n: int) -> list[str]:
        out = [self.words[k % len(self.words)] for k in range(self.used, self.used + n)]
        self.used += n
        return out


def ordinary(rng: random.Random, pick: Words) -> str:
    """What looks like a token and is none: words alone or joined to identifiers, paths and titles, file names, dates, numbers, rulers."""
    number = lambda a, b: "".join(rng.choices(DIGITS, k=rng.randrange(a, b)))
    few, shape = rng.randrange(2, 6), rng.randrange(14)
    date = f"20{number(2, 3)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}" if shape in (8, 10) else ""
    joined_words = [
        lambda: pick(1)[0], lambda: "_".join(pick(few)).lower(), lambda: "-".join(pick(few)).lower(), lambda: "/".join(pick(few)).lower(),
        lambda: "".join(w.capitalize() for w in pick(few)), lambda: "_".join(pick(few)).upper(), lambda: pick(1)[0].lower() + "".join(w.capitalize() for w in pick(few)),
        lambda: "-".join(pick(few)).lower() + "-" + number(1, 5), lambda: f"{pick(1)[0].upper()[:4]}_{date}_{number(4, 7)}", lambda: "/".join([*pick(few), number(4, 5), *pick(1)]),
        lambda: f"{date[:4]}-{date[4:6]}-{date[6:]}" + (f"T{number(6, 7)}" if rng.random() < 0.5 else "-" + "-".join(pick(2))), lambda: number(12, 25),
        lambda: "-".join(number(a, a + 1) for a in (3, 3, 4)) if rng.random() < 0.5 else "-".join(altered(rng, "hex", 20)[:n] for n in (8, 4, 4, 4, 12)),
        lambda: (pick(1)[0][:2] if rng.random() < 0.5 else "=-_+/"[rng.randrange(5)]) * rng.randrange(8, 25),
    ]
    return joined_words[shape]()


def examples(found: Iterable[tuple], aside: bool, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels (1: secret) and whether a window's kind is kept from the network (only in what is set ``aside``), of a block's findings.

    Every secret is altered to every kind and stands as it was found, with or without its keyword; every word is in an example, every number is one.
    """
    own: dict[str, list[tuple[str, str, str]]] = {"secret": [], "word": [], "context": [], "number": []}
    for kind, *rest in sorted({(f[0], f[1] or "", f[2], f[3] or "") for f in found}):
        own[kind].append(tuple(rest))
    rng = random.Random(seed)
    secrets, contexts, pick = own["secret"], own["context"], Words(rng, [w for _, w, _ in own["word"]])
    kinds = [k for k in ALPHABETS if aside or k not in UNSEEN]
    rows: list[tuple[str, str, str, int, bool]] = [(*n, 0, False) for n in own["number"]]
    if secrets and contexts and pick.words:
        wanted = max(LEAST, len(ALPHABETS) * len(secrets))
        while len(rows) < 2 * wanted or pick.used < len(pick.words):
            before, _, after = rng.choice(contexts)
            rows.append((before, ordinary(rng, pick), after, 0, False))
        for k in range(max(wanted, len(rows) // 2)):
            turn = k // len(secrets) + k % len(secrets)
            before, body, after = secrets[k % len(secrets)]
            context, kind = rng.choice(contexts), kinds[turn % len(kinds)]
            if turn % 4 == 0:  # as it was found, with or without its keyword
                around = (before, after) if turn % 8 else (context[0], context[2])
                rows.append((around[0], body, around[1], 1, False))
            rows.append((context[0], altered(rng, kind, len(body)), context[2], 1, kind in UNSEEN))
    x, y, unseen = [], [], []
    for before, body, after, label, hidden in rows:
        for w in windows(before + body + after, len(before), len(before) + len(body)):
            x.append(w)
            y.append(label)
            unseen.append(hidden)
    return np.frombuffer(b"".join(x), np.uint8).reshape(-1, LENGTH), np.array(y, np.int64), np.array(unseen, bool)


def dealt(found: DataFrame, kind: str, n: int, blocks: int) -> DataFrame:
    """The ``n`` rows of a kind, each in one block by a hash; in several where a block would hold less than ``HELD``."""
    copies = min(blocks, max(1, -(-HELD * blocks // max(1, n))))
    at = F.pmod(F.xxhash64("before", "body", "after"), F.lit(blocks))
    x = found.filter(F.col("kind") == kind)
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) if copies > 1 else x.withColumn("copy", F.lit(0))
    return x.withColumn("block", F.pmod(at + F.col("copy"), F.lit(blocks)).cast("int")).drop("copy")


def rows_of(table: pa.Table) -> Iterable[tuple]:
    return zip(*(table.column(c).to_pylist() for c in LABELLED.names))


def average(blocks: DataFrame, net: ByteCNN, turn: int, seed: int) -> ByteCNN:
    """The mean of the networks that a round's blocks make of ``net``; whole-number sums, so in any order."""
    out = arrow_schema(struct("place int, total long"))

    def trained(table: pa.Table) -> pa.Table:
        own = seed * 1_000_003 + table.column("block")[0].as_py()
        x, y, _ = examples(rows_of(table), False, own)
        if not y.any():
            return out.empty_table()
        flat = net.copy().fit(x, y, epochs=1, seed=own, part=turn, parts=ROUNDS).flat()
        total = np.append(np.rint(flat.astype(np.float64) * WEIGHT).astype(np.int64), 1)  # the last: a block
        return pa.table([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], schema=out)

    found = blocks.groupBy("block").applyInArrow(trained, struct("place int, total long"))
    sums = {r["place"]: r["s"] for r in found.groupBy("place").agg(F.sum("total").alias("s")).collect()}
    if not sums:
        return net
    *total, n = (sums[k] for k in range(len(sums)))
    return net.like(np.array([t / n / WEIGHT for t in total]))


def scores(blocks: DataFrame, net: ByteCNN, seed: int) -> list[tuple[bool, int, float, int]]:
    """(unseen, label, score, windows) of the blocks set aside, scores rounded down to one in ``SCORE``."""
    out = arrow_schema(kinds := struct("unseen boolean, label int, score long, n long"))

    def judged(table: pa.Table) -> pa.Table:
        x, y, unseen = examples(rows_of(table), True, seed * 1_000_003 + table.column("block")[0].as_py())
        z = net.logits(x).astype(np.float64)
        keys, n = np.unique(np.stack([unseen, y, np.floor((z[:, 1] - z[:, 0]) * SCORE).astype(np.int64)], 1), axis=0, return_counts=True)
        return pa.table([pa.array(keys[:, 0].astype(bool)), pa.array(keys[:, 1], pa.int32()), pa.array(keys[:, 2]), pa.array(n.astype(np.int64))], schema=out)

    found = blocks.groupBy("block").applyInArrow(judged, kinds).groupBy("unseen", "label", "score").agg(F.sum("n").alias("n"))
    return sorted((r["unseen"], r["label"], r["score"] / SCORE, r["n"]) for r in found.collect())


def train(docs: DataFrame, text_col: str = "text", seed: int = 3) -> Detector | None:
    """A detector from the labelled findings of all of ``docs``."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    if not size:
        return None
    found = materialize(findings(docs, text_col), "labelled-findings")
    seen = {r["kind"]: r for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("before", "body", "after"), 0.02).alias("d")).collect()}
    if any(k not in seen or seen[k][c] < MIN_FINDINGS for k, c in (("secret", "n"), ("word", "d"))) or "context" not in seen:
        return None
    turns = ROUNDS + 1  # the last is set aside
    blocks = turns * max(1, -(-size // (turns * BLOCK_BYTES)))
    x = dealt(found, "secret", seen["secret"]["d"], blocks)
    for kind in sorted(seen.keys() - {"secret"}):
        x = x.unionByName(dealt(found, kind, seen[kind]["d"], blocks))
    of = lambda turn: x.filter(F.col("block") % turns == turn)
    net = ByteCNN.new(2, widths=(2, 3, 5), filters=16, dim=8, seed=seed)
    for turn in range(ROUNDS):
        net = average(of(turn), net, turn, seed)
    told = scores(of(ROUNDS), net, seed)
    z, t, n = (np.array([r[k] for r in told if not r[0]], np.float64) for k in (2, 1, 3))
    slope, shift = 1.0, 0.0
    for _ in range(400):  # logistic calibration by gradient steps, slightly regularised
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -60, 60)))
        slope -= 0.05 * (np.average((p - t) * z, weights=n) + 0.01 * (slope - 1))
        shift -= 0.05 * (np.average(p - t, weights=n) + 0.01 * shift)
    d = Detector(net, slope, shift, 0.0)
    hidden = [(r[2], r[3]) for r in told if r[0]]
    upto = np.cumsum([k for _, k in hidden])
    d.threshold = float(d.calibrated(np.array(hidden[int(np.searchsorted(upto, int((1 - RECALL) * upto[-1]), side="right"))][0])))
    return d


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", detector: Detector | None = None, fit: bool = True) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_net (long), base_spans and spans (string, kind:start:end)."""
    if fit and detector is None:
        detector = train(docs, text_col)
    counts = ("n_assign", "n_access", "n_hex", "n_net")
    schema = added(docs.schema, **{c: T.LongType() for c in counts}, base_spans=T.StringType(), spans=T.StringType())
    out = arrow_schema(schema)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in b.column(text_col).to_pylist()]
        found = [spans_of(t) for t in texts]
        base = [b for b, _ in found]
        extra: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if detector:
            asked = [(k, a, e, w) for k, t in enumerate(texts) for a, e in found[k][1] for w in windows(t, a, e)]
            if asked:
                p = detector.probability(np.frombuffer(b"".join(w for *_, w in asked), np.uint8).reshape(-1, LENGTH))
                for (k, a, e, _), hit in zip(asked, p >= detector.threshold):
                    if hit and (a, 3, e) not in extra[k][-1:]:
                        extra[k].append((a, 3, e))
        n = [[sum(s[1] == kind for s in x) for x in base] for kind in range(3)]
        return with_columns(b, out, n_assign=n[0], n_access=n[1], n_hex=n[2], n_net=[len(x) for x in extra], base_spans=[joined(x) for x in base], spans=[joined(sorted(x + y)) for x, y in zip(base, extra)])

    return map_arrow(docs, run, schema)


def report(docs: DataFrame) -> DataFrame:
    x = scan(docs.select("doc_id", "text"))
    return x.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_net")

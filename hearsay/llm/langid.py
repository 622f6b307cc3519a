"""Language identification by a byte convolutional network.

Filters of several widths, max pooling and softmax, trained in numpy on a bounded sample of labelled
texts, and applied to batches of fixed-length windows over every byte of every text. A document's
classes are the windows' log probabilities, added up.

Learning reads text and lang of rows that aren't held out (crc32 of the id as text, mod 4, is 2 for
held-out rows); a prediction reads the text alone.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no labelled row every
text is ``und``; with one language all others texts get it; ties go to the language that sorts first;
a null id isn't held out; equal texts get equal predictions; further columns pass through, and a column
named like an added one gives way.

At scale: one count by language and one filtered scan give the sample: at most ``PER_LANG`` rows a
language in expectation (a hash of the id decides), fewer each where there are so many languages that ``SAMPLE_ROWS`` have to do.
Predictions are one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cnn import ByteCNN, windows_of
from .common import added, arrow_schema, map_arrow, materialize, with_columns

#: The bound of the training sample (documented parameters).
SAMPLE_ROWS, PER_LANG, SAMPLE_WINDOWS = 51_200, 800, 4
WINDOW, OVERLAP = 256, 3
LETTER = regex.compile(r"\p{L}")


def id_crc(id_col: Column, mod: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """(lang, text) of at most PER_LANG rows a language in expectation, fewer where SAMPLE_ROWS have to do for many languages;
    texts as pieces spread over the whole."""
    known = docs.filter((id_crc(F.col(id_col), 4) != 2) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = known.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__count"))
    # A sample of SAMPLE_ROWS can't have a row of more languages than that; so the counts are small, and texts stay where they are.
    counts = materialize(counts.orderBy(F.desc("__count"), "__lang").limit(SAMPLE_ROWS), "language-counts")
    n_langs = counts.count()
    if not n_langs:
        return []
    each = max(1, min(PER_LANG, SAMPLE_ROWS // n_langs))
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    size, piece = F.length(text_col), 4 * WINDOW
    starts = [F.lit(1), *[(F.greatest(size - piece, F.lit(0)) * k / SAMPLE_WINDOWS + 1).cast("int") for k in range(1, SAMPLE_WINDOWS)]]
    pieces = F.concat_ws("\n", *[F.substring(F.col(text_col), s, F.lit(WINDOW)) for s in starts])
    rows = (
        known.join(F.broadcast(counts), known[lang_col] == counts["__lang"]).filter(draw < F.lit(float(each)) / F.col("__count"))
        .select(lang_col, pieces.alias("text")).limit(2 * each * n_langs).collect()
    )
    return sorted((r[0], r[1]) for r in rows)


def train(sample: list[tuple[str, str]], seed: int = 5) -> tuple[list[str], ByteCNN] | None:
    """Languages and the network. Windows are cut to random lengths, so that short texts are learned too."""
    if not sample:
        return None
    langs = sorted({s[0] for s in sample})
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for lang, text in sample:
        b = text.encode()
        for _ in range(3):
            n = int(rng.integers(8, WINDOW + 1))
            at = int(rng.integers(0, max(1, len(b) - n + 1)))
            w = np.zeros(WINDOW, np.uint8)
            w[: len(b[at : at + n])] = np.frombuffer(b[at : at + n], np.uint8)
            xs.append(w)
            ys.append(langs.index(lang))
    return langs, ByteCNN.new(len(langs)).fit(np.stack(xs), np.array(ys))


def predict(docs: DataFrame, model: tuple[list[str], ByteCNN] | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred (string) and score (double)."""
    schema = added(docs.schema, lang_pred=T.StringType(), score=T.DoubleType())
    out = arrow_schema(schema)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(text_col).to_pylist()
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        judged = [k for k, t in enumerate(texts) if model and t and LETTER.search(t)]
        if judged:
            names, net = model
            parts = [windows_of(texts[k].encode(), WINDOW, OVERLAP) for k in judged]
            logp = net.log_probs(np.concatenate(parts))
            first = np.cumsum([0, *map(len, parts)])[:-1]
            total = np.add.reduceat(logp, first, axis=0)
            total -= total.max(axis=1, keepdims=True)
            prob = np.exp(total)
            prob /= prob.sum(axis=1, keepdims=True)
            for k, p in zip(judged, prob):
                best = int(p.argmax())
                langs[k], scores[k] = names[best], float(p[best])
        return with_columns(b, out, lang_pred=langs, score=scores)

    return map_arrow(docs, run, schema, rows=500)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with held_out, lang_pred and score; the network is trained on its rows that aren't held out."""
    model = train(training_sample(docs, id_col, text_col, lang_col))
    return predict(docs, model, text_col).withColumn("held_out", id_crc(F.col(id_col), 4) == 2)


def report(docs: DataFrame) -> DataFrame:
    model = train(training_sample(docs, "doc_id", "text", "lang"))
    held = docs.select("doc_id", "text", (id_crc(F.col("doc_id"), 4) == 2).alias("held_out"))
    return predict(held, model).select("doc_id", "held_out", "lang_pred", "score")

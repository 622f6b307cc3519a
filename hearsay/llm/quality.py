"""Quality rules: base counts, and distribution divergence from language references.

Every text gets two histograms: characters by class, and words by whose list of common words they are
in. References are the summed histograms of all documents of a language that pass the base rules.
A document is judged by the Jensen-Shannon distance (base 2, 0 to 1) to the references, for either
histogram, and only from a minimum length on: short texts have ragged histograms. Characters, by classes of any
script, fail beyond a fixed distance to the nearest reference; words, in lower case, where each reference is nearly
as far as it is from a text without a common word (how far that is depends on the references) and the text has no
common words of its own either: prose of any language comes back to its short words, so a text of a language
without a list stays if at least ``MIN_REUSE`` of its words occurred in it before.

Defined cases: a null text is empty; an empty text has no words and fails the base rules (fewer than
50 words); a null or unlisted language adds to no reference but is judged like any other; without any
reference (an empty table, no listed language) only the base rules hold; equal rows get equal verdicts;
further columns pass through, and a column named like an added one gives way.

At scale: one pass over the texts, row by row, in DataFrame functions alone; what moves is one row of
counts a task and language. The references that come to the driver are one row a listed language.
Window hashes (64 bits) stand for the 3-word windows of one text; windows are compared by sorting, so
a long text costs n log n.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"

#: Common words by language (parameter).
COMMON_WORDS = {
    "de": "der die das und ist nicht mit von ein eine den dem sich auf für zu des im auch es".split(),
    "en": "the of and to in a is that for it as was with be by on he not are this".split(),
    "es": "el la los las de que y en un una por con para del se no al es lo su".split(),
    "fr": "le la les de des et un une du est que qui dans en pour par sur au pas il".split(),
}
#: Character classes: name and what is not in it (Java regular expressions). Letters without case count as lower.
CHAR_CLASSES = {
    "lower": r"[^\p{Ll}\p{Lo}]+",
    "upper": r"[^\p{Lu}]+",
    "digit": r"[^0-9]+",
    "space": r"[^\x20\x09-\x0D]+",
    "stop": r"[^.,;:!?'\"()\-]+",
}
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: From these lengths on a histogram is judged; beyond this distance, or this share of a text's without common words, to
#: every reference it fails, the latter if fewer of its words than this share are a word it had before.
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.25
MIN_LIST_WORDS, MAX_WORD_SHARE, MIN_REUSE = 80, 0.8, 0.12


def _n(x: Column) -> Column:
    return x.cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text without nulls."""
    bare = F.btrim(text, F.lit(WS_CHARS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    return {
        "__words": words,
        "__folded": F.transform(words, F.lower),
        "n_words": _n(F.size(words)),
        "word_chars": _n(F.length(F.array_join(words, ""))),
        "n_symbols": _n(F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))),
        "n_dup_lines": _n(F.size(lines) - F.size(F.array_distinct(lines))),
    }


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = F.size(words)
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def marked(windows: Column) -> Column:
        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(order: Column) -> Column:
            again = F.filter(
                order,
                lambda x, j: F.coalesce(F.get(order, j + 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.when(j > 0, F.get(order, j - 1)["h"]) == x["h"], F.lit(False)),
            )
            places = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.size(F.array_distinct(places))

        return _let(order, twice)

    return _n(_let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(marked(w))))


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: the only element of an array, mapped."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def histograms(text: Column, words: Column) -> dict[str, Column]:
    """Counts by character class (and the rest), and by common-word list (and the rest)."""
    out = {f"__c_{k}": _n(F.length(F.regexp_replace(text, rest, ""))) for k, rest in CHAR_CLASSES.items()}
    return out | {f"__w_{k}": _n(F.size(F.filter(words, _is_in(v)))) for k, v in COMMON_WORDS.items()}


def reuse(words: Column) -> Column:
    """The share of the words that the text had before, of those with a letter; marks are short, so longer words aren't looked at."""
    marks = F.filter(words, lambda w: (F.length(w) <= 3) & ~w.rlike(r"\p{L}"))
    again = lambda x: F.size(x) - F.size(F.array_distinct(x))
    return _let(marks, lambda m: (again(words) - again(m)) / F.greatest(F.size(words) - F.size(m), F.lit(1)))


def _is_in(values: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(values)


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed and the histogram columns (``__c_*``, ``__w_*``)."""
    x = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    x = x.withColumns(base_columns(F.col("__text")))
    x = x.withColumns({"n_repeat_words": repeat_words(F.col("__words")), "__chars": _n(F.length("__text")), "__reuse": reuse(F.col("__folded"))} | histograms(F.col("__text"), F.col("__folded")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return x.withColumn("base_failed", failed).drop("__text", "__words", "__folded")


def _bins(prefix: str, names: list[str], total: Column) -> list[Column]:
    counts = [F.col(f"{prefix}{k}").cast("double") for k in names]
    rest = total.cast("double")
    for c in counts:
        rest = rest - c
    return [*counts, F.greatest(rest, F.lit(0.0))]  # a word may be in several lists


CHAR_BINS = ("__c_", list(CHAR_CLASSES), "__chars")
WORD_BINS = ("__w_", list(COMMON_WORDS), "n_words")


def references(feats: DataFrame, lang_col: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Language → (character histogram, word histogram), as shares; at most one row a listed language."""
    bins = [*_bins(CHAR_BINS[0], CHAR_BINS[1], F.col(CHAR_BINS[2])), *_bins(WORD_BINS[0], WORD_BINS[1], F.col(WORD_BINS[2]))]
    n = len(CHAR_BINS[1]) + 1
    rows = (
        feats.filter(F.col(lang_col).isin(list(COMMON_WORDS)) & ~F.col("base_failed"))
        .groupBy(lang_col).agg(*[F.sum(b).alias(f"b{k}") for k, b in enumerate(bins)]).collect()
    )
    out = {}
    for r in sorted(rows, key=lambda r: r[0]):
        chars, words = list(r[1 : n + 1]), list(r[n + 1 :])
        if sum(chars) and sum(words):
            out[r[0]] = ([x / sum(chars) for x in chars], [x / sum(words) for x in words])
    return out


def _distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram to a reference, both arrays of shares."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = F.zip_with(shares, F.array(*[F.lit(q) for q in reference]), term)
    return F.sqrt(F.greatest(_sum(terms) / 2, F.lit(0.0)))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda total, v: total + v)


def distance_of_none(reference: list[float]) -> float:
    """The distance to a reference of a histogram with all in its last bin: of a text without common words."""
    terms = [q * math.log2(2) for q in reference[:-1] if q > 0]
    m = (1 + reference[-1]) / 2
    terms += [math.log2(1 / m)] + ([reference[-1] * math.log2(reference[-1] / m)] if reference[-1] > 0 else [])
    return math.sqrt(max(sum(terms) / 2, 0.0))


def nearest(spec: tuple[str, list[str], str], refs: list[list[float]], limits: list[float]) -> Column:
    """near: the least distance to a reference; over: the least excess of a distance over the reference's limit. Bins are
    arrays, so that the plan stays small with many bins and references."""

    def least(shares: Column) -> Column:
        ds = F.array(*[F.round(_distance(shares, r), 12) for r in refs])
        over = lambda ds: F.array_min(F.zip_with(ds, F.array(*[F.lit(x) for x in limits]), lambda d, x: d - x))
        return _let(ds, lambda ds: F.struct(F.array_min(ds).alias("near"), over(ds).alias("over")))

    def shares(bins: Column) -> Column:
        return _let(F.greatest(_sum(bins), F.lit(1.0)), lambda total: F.transform(bins, lambda x: x / total))

    return _let(_let(F.array(*_bins(spec[0], spec[1], F.col(spec[2]))), shares), least) if refs else F.struct(F.lit(0.0).alias("near"), F.lit(0.0).alias("over"))


def judged(feats: DataFrame, refs: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """``feats`` with char_distance, word_distance and kept; the histogram columns go."""
    chars, words = [r[0] for r in refs.values()], [r[1] for r in refs.values()]
    x = feats.withColumns({
        "__char": nearest(CHAR_BINS, chars, [MAX_CHAR_DISTANCE] * len(chars)),
        "__word": nearest(WORD_BINS, words, [MAX_WORD_SHARE * distance_of_none(r) for r in words]),
    })
    x = x.withColumns({"char_distance": F.col("__char.near"), "word_distance": F.col("__word.near")})
    odd = ((F.col("__chars") >= MIN_CHARS) & (F.col("__char.over") > 0)) | (
        (F.col("n_words") >= MIN_LIST_WORDS) & (F.col("__word.over") > 0) & (F.col("__reuse") < MIN_REUSE))
    x = x.withColumn("kept", ~F.col("base_failed") & ~odd)
    return x.drop("__chars", "__reuse", "__char", "__word", *[f"{p}{k}" for p, names, _ in (CHAR_BINS, WORD_BINS) for k in names])


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distances and kept."""
    # Written with the rows: a distance reads each count many times, and must not compute it as often.
    feats = materialize(features(docs, text_col), "quality-features")
    return judged(feats, references(feats, lang_col))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]


def report(docs: DataFrame) -> DataFrame:
    """The query's rows. Counts are written once, without the texts; references and verdicts read them."""
    feats = materialize(features(docs.select("doc_id", "text", "lang")).drop("text"), "quality-features")
    return judged(feats, references(feats)).select(*COLUMNS)

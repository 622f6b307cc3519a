"""P9 sentiment scoring as a relational Spark job.

Rule-based valence scoring after the published method (Hutto & Gilbert, ICWSM 2014):
token valences from a lexicon *table* (an argument of every caller), intensifier/dampener words up
to three tokens back (decayed 1 / 0.95 / 0.9), capitals where only some words of the text are in
capitals (0.733 for the word and for its intensifier), negation within three tokens (×-0.74), contrast
on the first 'but' (×0.5 before, ×1.5 after), '!' emphasis (0.292 each, at most 4) and the normalisation
``s / sqrt(s² + 15)``, rounded to 4 places. Bit parity with any packaged scorer is not claimed.

Plan: texts that can't hold a word of the lexicon score 0 and aren't taken apart (``may_hit``, in Arrow batches). A text's words are cut into runs of ``RUN`` with the three words before each *before* the explode, so context
needs no window; a word carries its run, whose size is bounded, so work is in proportion to the text, and neighbours are looked up
for lexicon hits alone; the lexicon is a bounded broadcast table joined on the token (a hash lookup,
not a linear map scan); a single ``groupBy(id)`` sums contributions. All tokens of a post sit
in the same input partition, so the partial aggregate emits one row per post before the
shuffle — the exchange carries posts, not tokens.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import fixtures as fx
from . import text as tx

MICRO = 1_000_000
#: Words a run, and how many before it are its context.
RUN, BEFORE = 64, 3
#: What an intensifier counts for one, two and three words before.
DECAY = (1.0, 0.95, 0.9)
#: The spellings whose lower case is "but".
BUTS = ["".join(c) for c in product("bB", "uU", "tT")]


def _booster(word: Column, mixed: Column) -> Column:
    """What an intensifier (or dampener) adds to a positive valence; more where it stands out in capitals."""
    low = F.lower(word)
    step = F.when(low.isin(*fx.BOOSTERS_UP), F.lit(fx.BOOSTER_INCR)).when(low.isin(*fx.BOOSTERS_DOWN), F.lit(-fx.BOOSTER_INCR))
    return F.coalesce(step + F.when(mixed & tx.is_caps(word), F.lit(fx.CAPS_INCR)).otherwise(F.lit(0.0)), F.lit(0.0))


def token_contribution(valence: Column, word: Column, p1: Column, p2: Column, p3: Column, pos: Column, but_pos: Column, mixed: Column) -> Column:
    """Contribution of one lexicon token, in micro-units (exact integer sums downstream).

    Words come as they are written; ``mixed`` says that some but not all words of the text are in capitals.
    """
    sign = F.when(valence < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    caps = F.when(mixed & tx.is_caps(word), F.lit(fx.CAPS_INCR)).otherwise(F.lit(0.0))
    # Folds over the three words: written out for each, they make the generated method too long for Java to compile, and the
    # exploded words would pass through it as well.
    before = F.array(p1, p2, p3)
    steps = F.zip_with(before, F.array(*map(F.lit, DECAY)), lambda w, d: _booster(w, mixed) * d)
    v = valence + sign * caps + sign * F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
    negated = F.exists(before, lambda w: F.lower(w).isin(*fx.NEGATORS))
    v = F.when(F.coalesce(negated, F.lit(False)), v * F.lit(fx.NEGATION_SCALAR)).otherwise(v)
    v = (
        F.when((but_pos > 0) & (pos < but_pos), v * F.lit(fx.CONTRAST_BEFORE))
        .when((but_pos > 0) & (pos > but_pos), v * F.lit(fx.CONTRAST_AFTER))
        .otherwise(v)
    )
    return F.round(v * F.lit(float(MICRO))).cast("bigint")


def compound_from_sum(sum_micro: Column, exclamations: Column) -> Column:
    s = sum_micro / F.lit(float(MICRO))
    ep = F.least(exclamations, F.lit(fx.EXCLAMATION_MAX)) * F.lit(fx.EXCLAMATION_STEP)
    s = F.when(s > 0, s + ep).when(s < 0, s - ep).otherwise(s)
    c = s / F.sqrt(s * s + F.lit(fx.NORMALIZE_ALPHA))
    return tx.rnd(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)), 4)


def _lexicon_pieces(tokens: list[str]) -> list[str] | None:
    """For each token its longest run of ASCII letters, digits and _, which each text with that word holds between other characters.

    None where a token has other letters, whose lower case may be spelled in several ways.
    """
    if not all(t.isascii() for t in tokens):
        return None
    runs = [re.findall("[a-z0-9_]+", t) for t in tokens]
    return sorted({max(r, key=len) for r in runs if r})  # a token without any is no word


def may_hit(text: Column, lexicon: DataFrame) -> Column | None:
    """Whether a text may hold a word whose lower case is a token of the lexicon (rows of a parameter); None: can't be told.

    A batch's bytes become lower-case ASCII word characters and spaces, and what lies between spaces is looked up, so the
    cost doesn't depend on the size of the lexicon. The Kelvin sign is the one other character whose lower case is ASCII.
    """
    pieces = _lexicon_pieces([r["token"] for r in lexicon.select("token").collect() if r["token"] is not None])
    if pieces is None:
        return None
    kept = {ord(c): ord(c.lower()) for c in tx.ASCII_UPPER + tx.ASCII_LOWER + "0123456789_"}
    table = np.array([kept.get(b, ord(" ")) for b in range(256)], np.uint8)

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        if data is None:
            return pa.array(np.zeros(len(texts), bool))
        plain = pa.py_buffer(table[np.frombuffer(data, np.uint8)])
        words = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), offsets, plain, offset=texts.offset))
        hits = pc.is_in(words.flatten(), value_set=pa.array(pieces, pa.large_string())).to_numpy(zero_copy_only=False)
        out = pc.match_substring(texts, "\u212a").to_numpy(zero_copy_only=False).copy()
        out[pc.list_parent_indices(words).to_numpy()[hits]] = True
        return pa.array(out)

    return found(text)


def score(df: DataFrame, lexicon: DataFrame, text: Column | None = None, key: str = "id", carry: list[str] | None = None) -> DataFrame:
    """Add ``compound`` to ``df`` (one row per ``key``), keeping the ``carry`` columns.

    Only (key, run, word) rows are exploded; the inner broadcast join with the lexicon keeps
    lexicon hits alone, which are summed per key and joined back. The input is hash-partitioned
    by ``key`` (the dedupe exchange), so neither the sum nor the join-back adds an exchange,
    and the wide post columns never ride along with the tokens. ``lexicon`` is a (token,
    valence) frame that is broadcast.
    """
    text = text if text is not None else tx.combine_for_scoring()
    carry = [c for c in (carry if carry is not None else df.columns) if c != key]
    # Each array is a column of a projection of its own, so that it is built once a text: what a generator's consumer
    # derives from an array is evaluated for every exploded row, and the array is carried along (so a word's is a run).
    may = may_hit(text, lexicon)
    words = (df if may is None else df.where(may)).select(F.col(key), tx.score_tokens(text).alias("_words"))
    mixed = F.exists("_words", tx.is_caps) & F.exists("_words", lambda t: ~tx.is_caps(t))
    staged = words.select(F.col(key), F.filter("_words", lambda t: F.length(t) >= 2).alias("word"), mixed.alias("_mixed"))
    padded = F.concat(F.array(*[F.lit(None).cast("string")] * BEFORE), F.col("word"))
    first_but = F.coalesce(F.least(*[F.nullif(F.array_position("word", b), F.lit(0).cast("bigint")) for b in BUTS]), F.lit(0).cast("bigint"))
    near = staged.select(F.col(key).alias("_k"), "_mixed", F.size("word").alias("_n"), padded.alias("_padded"), first_but.alias("_but"))
    starts = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1, F.lit(RUN)))
    cut = F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice("_padded", s + 1, RUN + BEFORE).alias("words")))
    runs = near.select("_k", "_mixed", "_but", cut.alias("_runs"))
    # The outer form, as the inner one would add a filter on the array's size that tokenises every text once more.
    run = runs.select("_k", "_mixed", "_but", F.explode_outer("_runs").alias("_r"))
    run = run.select("_k", "_mixed", "_but", F.col("_r.at").alias("_from"), F.col("_r.words").alias("_run"))
    exploded = run.select("_k", "_mixed", "_but", "_from", "_run", F.posexplode_outer(F.slice("_run", BEFORE + 1, RUN)).alias("_at", "_word"))
    # A lexicon is rows of a parameter; without the hint its size is unknown and the tokens would be moved to it.
    lex = F.broadcast(lexicon.select(F.col("token").alias("_tok"), F.col("valence").alias("_val")))
    hits = exploded.join(lex, F.lower(exploded["_word"]) == lex["_tok"], "inner")
    word, *back = [F.get("_run", F.col("_at") + (BEFORE - k)) for k in range(BEFORE + 1)]
    contrib = token_contribution(F.col("_val"), word, *back, F.col("_from") + F.col("_at") + 1, F.col("_but"), F.col("_mixed"))
    sums = hits.groupBy("_k").agg(F.sum(contrib).alias("_s"))
    base = df.select(F.col(key), *[F.col(c) for c in carry], tx.count_char(text, "!").alias("_bang"))
    joined = base.join(sums, base[key] == sums["_k"], "left")
    s_micro = F.coalesce(F.col("_s"), F.lit(0).cast("bigint"))
    return joined.select(key, *carry, compound_from_sum(s_micro, F.col("_bang")).alias("compound"))

"""P11-P13 entity tagging with a pattern taxonomy (a parameter; default = fixtures.TAXONOMY).

Each label is one regex on the lower-cased whole text. The default patterns are spelled so that RE2 and Java agree, and are
matched by Arrow's RE2 on batches of texts: one pass finds the texts that hold any label, and these take one pass a label, however many
branches it has; patterns of a caller's go to ``rlike``.
A family is ``array_compact(array(when(match, label), ...))`` in declaration order, so the result is ordered and
duplicate-free like the reference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import fixtures as fx
from . import text as tx


def _matches(text: Column, patterns: list[str]) -> Column:
    """Which of ``patterns`` (at most 63) match, as the bits of a number; A-Z is folded first."""

    any_of = "|".join(f"(?:{p})" for p in patterns)

    @F.arrow_udf("long")
    def bits(texts: pa.Array) -> pa.Array:
        low = pc.ascii_lower(texts)
        out, at = np.zeros(len(low), np.int64), pc.indices_nonzero(pc.match_substring_regex(low, any_of))
        some, found = low.take(at), np.zeros(len(at), np.int64)
        for i, p in enumerate(patterns):
            found |= pc.match_substring_regex(some, p).to_numpy(zero_copy_only=False).astype(np.int64) << i
        out[at.to_numpy()] = found
        return pa.array(out)

    return bits(text)


def _family(rows: list[tuple], found: list[Column]) -> Column:
    hits = [F.when(m, F.lit(label)) for (_, label, _, _), m in zip(rows, found)]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def entities(text: Column | None = None, taxonomy: list | None = None, lowered: bool = False) -> Column:
    """struct<vehicles, energy_products, issues>; empty arrays for empty/null text.

    Pass a column that is already case-folded with ``lowered=True`` (computed once in an earlier
    projection) where a ``taxonomy`` is given: its patterns refer to the text one by one.
    """
    text = F.coalesce(text if text is not None else tx.combine_for_scoring(), F.lit(""))
    rows = sorted(taxonomy or fx.taxonomy_rows(), key=lambda r: r[2])
    if taxonomy is None:
        found = _matches(text, [r[3] for r in rows])
        match = {r[:2]: found.bitwiseAND(F.lit(1 << i)) != 0 for i, r in enumerate(rows)}
    else:
        t = text if lowered else tx.ascii_lower(text)
        match = {r[:2]: t.rlike(r[3]) for r in rows}
    families = {fam: [r for r in rows if r[0] == fam] for fam in fx.FAMILIES}
    return F.struct(*[_family(own, [match[r[:2]] for r in own]).alias(fam) for fam, own in families.items()])


def primary_product(ent: Column) -> Column:
    """First energy label, else first vehicle, else NULL (``get`` is NULL-safe under ANSI)."""
    return F.coalesce(F.get(ent["energy_products"], 0), F.get(ent["vehicles"], 0))

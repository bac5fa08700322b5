"""Search-term highlighting as an expression: text -> ``ARRAY<STRUCT<t, hit>>``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglathe.functions.fields import let

#: Characters to mark hits with; the first two that no term has are used.
_MARKS = [chr(0xE000 + i) for i in range(64)]


def _marked(value: Column, term: str, mark: str) -> Column:
    """The text with every character of a term's hits replaced by the mark: case-insensitive, left to
    right, without self-overlap. Case folding keeps the number of characters, so places stay."""
    literal = "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", term, flags=re.ASCII)
    return F.regexp_replace(value, literal, mark * len(term))


def highlight(value: Column, terms: Sequence[str]) -> Column:
    """Segments covering the whole text; adjacent and overlapping hits of any terms form one segment.

    Every step is one pass over the characters: a mask for each term, the characters that any mask
    hits, the places where that changes, and the text between those places.
    """
    terms = [t for t in terms if t]
    if not terms:
        return F.array(F.struct(value.alias("t"), F.lit(False).alias("hit")))
    mark, other = [m for m in _MARKS if not any(m in t for t in terms)][:2]
    plain = F.translate(value, mark, other)
    masks = F.array(*[F.split(_marked(plain, t, mark), "") for t in terms])

    def between(chars: Column, hits: Column, starts: Column) -> Column:
        return F.transform(starts, lambda s, k: F.struct(
            F.array_join(F.slice(chars, s + 1, F.coalesce(F.get(starts, k + 1), F.size(chars)) - s), "").alias("t"),
            F.get(hits, s).alias("hit")))

    def changes(hits: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(hits) - 1), lambda i: (i == 0) | (F.get(hits, i) != F.get(hits, i - 1)))

    segments = let(F.split(value, ""), lambda chars: let(
        let(masks, lambda all_: F.transform(
            chars, lambda _, i: F.exists(all_, lambda m: F.get(m, i) == mark))),
        lambda hits: let(changes(hits), lambda starts: between(chars, hits, starts))))
    return F.filter(segments, lambda s: s["t"] != "")

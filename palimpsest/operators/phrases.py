"""Phrase compression: fillers go, wordy turns are shortened, spaces and marks tightened."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.strings import begun, chained, found


DELETIONS = [(f"(?iU){p}", "") for p in fixed.DELETED]
REWRITES = [(f"(?iU){p}", r) for p, r in fixed.REWRITTEN]


def delete(c: str | Column) -> Column:
    return chained(c, DELETIONS)


def rewrite(c: str | Column) -> Column:
    return chained(c, REWRITES)


def tighten(c: str | Column) -> Column:
    return chained(c, fixed.TIGHTENED)


def compress(skeleton: str | Column) -> Column:
    return chained(skeleton, [*DELETIONS, *REWRITES, *fixed.TIGHTENED])


def negations(c: Column) -> Column:
    """Negation words in order, in lower case and without apostrophes."""
    return F.transform(found(c, begun(fixed.NEGATION, fixed.NEGATION_START)), lambda x: F.replace(F.lower(x), F.lit("'"), F.lit("")))

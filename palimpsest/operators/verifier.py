"""Invariants of a text that a rewrite must keep, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.strings import begun, found, mapped
from palimpsest.operators.phrases import negations


def numbers(c: Column) -> Column:
    """The multiset of numbers as a sorted array."""
    return F.array_sort(found(c, fixed.NUMBER))


def comparators(c: Column) -> Column:
    return F.transform(found(c, begun(fixed.COMPARATOR, fixed.COMPARATOR_START), 1, fixed.COMPARATOR_SHAPE), lambda x: mapped(F.lower(x), fixed.COMPARATOR_SIGNS))


def modality(c: Column) -> Column:
    return F.transform(found(c, begun(fixed.MODALITY, fixed.MODALITY_START), 1), lambda x: mapped(F.lower(x), fixed.MODALITY_CLASSES))


def negation_classes(c: Column) -> Column:
    """Every prohibition counts as the same; except, unless and only stay apart."""
    return F.transform(negations(c), lambda x: F.when(x.isin(*fixed.PROHIBITIONS), "NEG").otherwise(x))


def signature(c: Column) -> Column:
    return F.struct(negations(c).alias("negations"), numbers(c).alias("numbers"), comparators(c).alias("comparators"), modality(c).alias("modality"))


CHECKS = (("negation", negation_classes), ("numbers", numbers), ("comparators", comparators), ("modality", modality))


def invariants(c: Column) -> Column:
    """What ``verify`` compares of a text."""
    return F.struct(*[f(c).alias(name) for name, f in CHECKS])


def verify(original: Column, candidate: Column, held: Column | None = None) -> Column:
    """struct(ok, confidence, failures). ``held``: the original's ``invariants``, where they are at hand."""
    of = {name: f(original) if held is None else held[name] for name, f in CHECKS}
    failures = F.filter(F.array(*[F.when(of[name] != f(candidate), name) for name, f in CHECKS]), lambda x: x.isNotNull())
    failures = F.when(original == candidate, F.array().cast("array<string>")).otherwise(failures)  # equal texts need no look
    confidence = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(fixed.FAILURE_COST) * F.size(failures))
    return F.struct((F.size(failures) == 0).alias("ok"), confidence.alias("confidence"), failures.alias("failures"))

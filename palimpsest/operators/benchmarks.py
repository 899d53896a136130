"""Benchmark operators: representation matrix, shares, winners, cumulative replay, answer quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.tokens import estimate


def matrix(items: DataFrame) -> DataFrame:
    """Items (id, category, rep, text): id, category, rep, tokens. Null and empty representations are left out."""
    return items.filter("coalesce(text, '') != ''").select("id", "category", "rep", estimate(F.col("text")).alias("tokens"))


def share_of_raw(counts: DataFrame, raw: str) -> DataFrame:
    """rep, tokens, pct of the raw representation over all items."""
    total = counts.groupBy("rep").agg(F.sum("tokens").alias("tokens"))
    base = total.filter(F.col("rep") == raw).select(F.col("tokens").alias("raw_tokens"))
    return total.join(F.broadcast(base), how="inner", on=F.lit(True)).select("rep", "tokens", F.bround(F.col("tokens") * 100.0 / F.col("raw_tokens"), 1).alias("pct"))  # one row


def winners(counts: DataFrame) -> DataFrame:
    """Per item the representation with the fewest tokens; ties go to the name that sorts first."""
    return counts.groupBy("id").agg(F.min(F.struct("tokens", "rep")).alias("x")).select("id", F.col("x.rep").alias("rep"), F.col("x.tokens").alias("tokens"))


def investment_cost(overhead: Column, turn: Column) -> Column:
    """The replay's own rule: the block's face value on the first turn, a tenth afterwards."""
    return F.when(turn == 1, overhead).otherwise(F.bround(overhead * F.lit(0.1)).cast("long"))


def quality(answers: DataFrame) -> DataFrame:
    """Answers (task, answer, groups): passed if every group has an alternative that the answer contains, whatever the case."""
    low = F.lower(F.col("answer"))
    return answers.select("task", F.forall("groups", lambda g: F.exists(g, lambda a: F.contains(low, F.lower(a)))).alias("passed"))

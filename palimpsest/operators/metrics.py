"""Savings metrics over the events table.

Events: ts double (epoch seconds), session, model, profile, exact, original_tokens,
encoded_tokens, dict_overhead, saved, pct, latency_ms, fallback, representation,
direction, provider, project, fallback_reason, eff_overhead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def migrated(events: DataFrame) -> DataFrame:
    """Older tables lack two columns: old fallbacks are ``legacy``, the effective overhead is the face value."""
    out = events
    if "fallback_reason" not in out.columns:
        out = out.withColumn("fallback_reason", F.lit(None).cast("string"))
    if "eff_overhead" not in out.columns:
        out = out.withColumn("eff_overhead", F.lit(None).cast("long"))
    return out.withColumns({
        "fallback_reason": F.coalesce("fallback_reason", F.when(F.col("fallback") == 1, "legacy").otherwise("")),
        "eff_overhead": F.coalesce("eff_overhead", "dict_overhead"),
    })


def since(events: DataFrame, hours: float | None, now: float) -> DataFrame:
    """The last hours; 0 or none means all."""
    return events.filter(F.col("ts") >= now - hours * 3600) if hours else events


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("int")) * 100


def summary(events: DataFrame) -> DataFrame:
    """One row about requests."""
    out = events.filter("direction = 'in'").agg(
        F.count(F.lit(1)).alias("requests"), _total("original_tokens").alias("original"), _total("encoded_tokens").alias("encoded"), _total("dict_overhead").alias("overhead"),
        _total("eff_overhead").alias("eff_overhead"), _total("saved").alias("saved"), F.coalesce(F.sum(F.col("original_tokens") - F.col("encoded_tokens") - F.col("eff_overhead")), F.lit(0)).alias("saved_effective"),
        F.avg("latency_ms").alias("avg_latency_ms"), _share(F.col("fallback") == 1).alias("fallback_pct"), _share(F.col("fallback_reason").startswith("error:")).alias("error_pct"),
        _share(F.col("fallback_reason") == "not-worth-it").alias("reverted_pct"),
    )
    return out


def reductions(totals: DataFrame) -> DataFrame:
    """Adds raw and effective reduction in percent; 0 without input."""
    share = lambda part: F.coalesce(F.bround(F.try_divide(F.col(part) * 100.0, F.col("original")), 2), F.lit(0.0))
    return totals.withColumns({"reduction_pct": share("saved"), "reduction_effective_pct": share("saved_effective")})


def output_summary(events: DataFrame) -> DataFrame:
    """One row about replies."""
    return events.filter("direction = 'out'").agg(F.count(F.lit(1)).alias("replies"), _total("encoded_tokens").alias("generated"), _total("original_tokens").alias("expanded"), _total("saved").alias("saved"))


def by_model(events: DataFrame) -> DataFrame:
    return events.filter("direction = 'in'").groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.sum("saved").alias("saved"), F.round(F.avg("pct"), 1).alias("avg_pct")).orderBy(F.desc("saved"), "model")


def by_representation(events: DataFrame) -> DataFrame:
    return events.filter("direction = 'in'").groupBy("representation").agg(F.count(F.lit(1)).alias("requests"), F.sum("saved").alias("saved")).orderBy(F.desc("saved"), "representation")


def representation(labels: Column) -> Column:
    """The event's label: distinct labels in order, or passthrough."""
    joined = F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return F.when(joined == "", "passthrough").otherwise(joined)


def cached(puts: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The result cache after insert-or-replace: the latest value of each key."""
    others = [c for c in puts.columns if c != key]
    return puts.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("x")).select(key, "x.*")


#: What the cells of a cube are told apart by.
CELL = ["hour", "direction", "model", "representation"]
_SUMMED = {"original": "original_tokens", "encoded": "encoded_tokens", "overhead": "dict_overhead", "eff_overhead": "eff_overhead", "saved": "saved"}


def cells(events: DataFrame) -> DataFrame:
    """The events as sums and counts by hour, direction, model and representation. Cells of parts of the events add up, in any order, so events may come as late as they like."""
    when = lambda condition: F.count(F.when(condition, 1))
    effective = F.col("original_tokens") - F.col("encoded_tokens") - F.col("eff_overhead")
    return events.withColumn("hour", F.floor(F.col("ts") / 3600)).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("requests"), *[_total(c).alias(out) for out, c in _SUMMED.items()], F.coalesce(F.sum(effective), F.lit(0)).alias("saved_effective"),
        F.count("latency_ms").alias("timed"), F.sum("latency_ms").alias("latency"), F.count("pct").alias("rated"), F.sum("pct").alias("pct"), F.count("fallback").alias("flagged"),
        when(F.col("fallback") == 1).alias("fallbacks"), F.count("fallback_reason").alias("reasoned"),
        when(F.col("fallback_reason").startswith("error:")).alias("errors"), when(F.col("fallback_reason") == "not-worth-it").alias("reverted"),
    )


def rolled_up(cube: DataFrame, *by: str) -> DataFrame:
    """The summary of requests by each prefix of ``by``, the total included, in one pass over the cells; ``level`` is the number of columns that a row is of.

    Times and ratings are sums of doubles: their averages are those of ``summary`` up to the order of adding.
    """
    share = lambda part, whole: F.try_divide(F.sum(part) * 100.0, F.sum(whole))
    level = (F.lit(len(by)) - F.bit_count(F.grouping_id())) if by else F.lit(0)
    asked = cube.filter("direction = 'in'")
    return (asked.rollup(*by) if by else asked.groupBy()).agg(
        level.cast("long").alias("level"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("requests", *_SUMMED, "saved_effective")],
        F.try_divide(F.sum("latency"), F.sum("timed")).alias("avg_latency_ms"), F.round(F.try_divide(F.sum("pct"), F.sum("rated")), 1).alias("avg_pct"),
        share("fallbacks", "flagged").alias("fallback_pct"), share("errors", "reasoned").alias("error_pct"), share("reverted", "reasoned").alias("reverted_pct"),
    )

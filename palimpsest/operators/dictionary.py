"""Alias dictionaries: seeds, substitution, expansion, phrase mining and minting of generations.

Tables: aliases(scope, code, expansion, surface_forms, members), generations
(scope, version, codes, bootstrap), nursery(scope, phrase, count, tokens,
first_seen). Every scope has its own dictionary.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.strings import begun, chained, found, replaced_each, strip
from palimpsest.functions.tokens import estimate

ALIASES = "scope string, code string, expansion string, surface_forms array<string>, members array<string>"


def seeds(spark: SparkSession, scope: str = "global") -> DataFrame:
    """The standard aliases and their bundle."""
    rows = [(scope, code, expansion, list(forms), None) for code, expansion, forms in fixed.SEEDS]
    by_code = {code: expansion for code, expansion, _ in fixed.SEEDS}
    label = f"{fixed.BUNDLE_LABEL}: " + " + ".join(by_code[m] for m in fixed.BUNDLE_MEMBERS)
    return spark.createDataFrame([*rows, (scope, fixed.BUNDLE, label, [], list(fixed.BUNDLE_MEMBERS))], ALIASES)


def definition() -> Column:
    """The line that defines an alias."""
    return F.concat(F.col("code"), F.lit("="), F.when(F.size("members") > 0, F.array_join("members", "+")).otherwise(F.col("expansion")))


def generation(aliases: DataFrame, version: int | Column = 1) -> DataFrame:
    """Freezes all aliases of each scope: scope, version, codes (in code order), bootstrap."""
    ordered = F.array_sort(F.collect_list(F.struct(F.substring("code", 1, 1).alias("family"), F.substring("code", 2, 20).cast("long").alias("number"), "code", definition().alias("line"))))
    version = F.lit(version) if isinstance(version, int) else version
    head, _, tail = fixed.BOOTSTRAP.partition("{version}")
    return (
        aliases.groupBy("scope").agg(ordered.alias("x")).withColumn("version", version)
        .select("scope", "version", F.col("x.code").alias("codes"), F.concat(F.lit(head), F.col("version").cast("string"), F.lit(tail), F.array_join("x.line", "; ")).alias("bootstrap"))
    )


def active(generations: DataFrame) -> DataFrame:
    """The latest generation of each scope."""
    return generations.groupBy("scope").agg(F.max("version").alias("version"), F.max_by("codes", "version").alias("codes"), F.max_by("bootstrap", "version").alias("bootstrap"))


def substitutable(aliases: DataFrame, generations: DataFrame) -> DataFrame:
    """Usable surface forms of each scope, the longest form text first, then by code and form."""
    usable = active(generations).select("scope", F.explode("codes").alias("code"))
    forms = aliases.join(usable, ["scope", "code"]).select("scope", "code", F.explode("surface_forms").alias("form"))
    order = Window.partitionBy("scope").orderBy(F.length("form").desc(), F.substring("code", 1, 1), F.substring("code", 2, 20).cast("long"), "form")
    return forms.withColumn("rank", F.row_number().over(order))


def rules_of(table: DataFrame, scope: str = "global", most: int = 5000) -> list[tuple[str, str]]:
    """(pattern, code) of one scope's table in order. Dictionaries are prompt-sized; a larger one raises."""
    rows = table.filter(F.col("scope") == scope).orderBy("rank").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"scope {scope} has more than {most} surface forms")
    return [(f"(?iU){r['form']}", r["code"]) for r in rows]


def seed_rules() -> list[tuple[str, str]]:
    forms = [(form, code) for code, _, all_forms in fixed.SEEDS for form in all_forms]
    return [(f"(?iU){form}", code) for form, code in sorted(forms, key=lambda x: (-len(x[0]), int(x[1][1:]), x[0]))]


def bundle(c: Column) -> Column:
    """Runs of the bundle's members, in order, become its code."""
    return F.regexp_replace(c, "(?U)" + fixed.BUNDLE_GAP.join(rf"\b{m}\b" for m in fixed.BUNDLE_MEMBERS), fixed.BUNDLE)


def substitute(c: str | Column, rules: list[tuple[str, str]]) -> Column:
    return chained(c, rules)


def alias_entities(c: Column, pairs: Column, whole_words: bool) -> Column:
    """``pairs``: array<struct<name, code>>, longest name first. Whole words for texts that ship unverified."""
    if whole_words:
        quoted = lambda n: F.concat(F.lit(r"(?U)\b\Q"), n, F.lit(r"\E\b"))
        return F.aggregate(pairs, c, lambda t, p: F.regexp_replace(t, quoted(p["name"]), p["code"]))
    return F.aggregate(pairs, c, lambda t, p: F.replace(t, p["name"], p["code"]))


def alias_pass(c: str | Column, rules: list[tuple[str, str]], pairs: Column) -> Column:
    return alias_entities(bundle(substitute(c, rules)), pairs, True)


def codes(c: Column) -> Column:
    """All codes in a text, in order."""
    return found(c, begun(fixed.CODE, fixed.CODE_START), 1, fixed.CODE_SHAPE)


def expand(c: Column, expansions: Column) -> Column:
    """Every known code becomes its expansion, in one pass; unknown codes stay. ``expansions``: map<code, text>."""
    return replaced_each(c, begun(fixed.CODE, fixed.CODE_START), lambda m, i: F.coalesce(F.try_element_at(expansions, m), m), fixed.CODE_SHAPE)


def expansions(aliases: DataFrame) -> DataFrame:
    """scope, expansions: all aliases, usable or not."""
    return aliases.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("code", "expansion"))).alias("expansions"))


def seed_expansion_texts() -> dict[str, str]:
    by_code = {code: expansion for code, expansion, _ in fixed.SEEDS}
    return by_code | {fixed.BUNDLE: f"{fixed.BUNDLE_LABEL}: " + " + ".join(by_code[m] for m in fixed.BUNDLE_MEMBERS)}


def seed_expansions() -> Column:
    return F.create_map(*[F.lit(x) for kv in seed_expansion_texts().items() for x in kv])


def clauses(c: Column) -> Column:
    """Clauses of a compressed skeleton that may be learnt: long enough and without a placeholder."""
    parts = F.transform(F.split(c, fixed.CLAUSE_END), strip)
    return F.filter(parts, lambda x: (F.length(x) > fixed.LEAST_CLAUSE) & ~F.contains(x, F.lit(fixed.OPEN)))


def nursery(sightings: DataFrame) -> DataFrame:
    """Sightings (scope, clause, seq) counted by phrase: scope, phrase, count, tokens (of the last sighting), first_seen. Counts are combined before the shuffle."""
    rows = sightings.withColumn("phrase", F.lower(strip(F.col("clause")))).filter(F.length("phrase") >= fixed.LEAST_PHRASE)
    return rows.groupBy("scope", "phrase").agg(F.count(F.lit(1)).alias("count"), F.max_by(estimate(F.col("clause")), F.col("seq")).alias("tokens"), F.min("seq").alias("first_seen"))


def promotable(table: DataFrame) -> DataFrame:
    """Phrases worth an alias, with their expected net saving."""
    uses = F.least(F.col("count") * 2, F.lit(fixed.HORIZON))
    net = (F.col("tokens") - fixed.CODE_COST) * uses - (F.col("tokens") + fixed.DEFINITION_COST)
    return table.withColumn("net", net).filter((F.col("net") >= fixed.LEAST_NET) & (F.col("count") >= fixed.LEAST_COUNT))


def mint(table: DataFrame, aliases: DataFrame) -> DataFrame:
    """New aliases of scopes whose promotable phrases together repay a new generation: scope, code, expansion, surface_forms, members.

    Numbers follow net saving, then first sighting, then the phrase. They are
    found by ranks within net-saving groups and a running sum over the groups,
    so that no scope's phrases are sorted in one task.
    """
    cands = promotable(table)
    total = cands.groupBy("scope").agg(F.sum("net").alias("total")).filter(F.col("total") > fixed.MINT_COST).select("scope")
    last = aliases.filter(F.col("code").startswith("K")).groupBy("scope").agg(F.max(F.substring("code", 2, 20).cast("long")).alias("last"))
    groups = cands.groupBy("scope", "net").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("scope").orderBy(F.col("net").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = groups.select("scope", "net", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("scope", "net").orderBy("first_seen", "phrase"))
    rows = cands.join(total, "scope", "left_semi").withColumn("rank", rank).join(offset, ["scope", "net"]).join(last, "scope", "left")
    code = F.concat(F.lit("K"), (F.coalesce("last", F.lit(0)) + F.col("before") + F.col("rank")).cast("string"))
    return rows.select("scope", code.alias("code"), F.col("phrase").alias("expansion"), F.array(escaped(F.col("phrase"))).alias("surface_forms"), F.lit(None).cast("array<string>").alias("members"), "net")


def left_in_nursery(table: DataFrame, minted: DataFrame) -> DataFrame:
    return table.join(minted.select("scope", F.col("expansion").alias("phrase")), ["scope", "phrase"], "left_anti")


def imported(aliases: DataFrame, pack: DataFrame) -> DataFrame:
    """Known codes keep their aliases; the pack adds the rest."""
    return aliases.unionByName(pack.join(aliases.select("scope", "code"), ["scope", "code"], "left_anti"))


def removed(aliases: DataFrame, gone: DataFrame) -> DataFrame:
    return aliases.join(gone, ["scope", "code"], "left_anti")


def upserted(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Manual aliases replace those of the same code; they become usable with the next generation."""
    return removed(aliases, new.select("scope", "code")).unionByName(new)


def bootstrap_for(used: Column, definitions: Column, version: Column) -> Column:
    """The block that defines the used codes, in their order; empty if none is known. ``definitions``: map<code, line>."""
    head, _, tail = fixed.BOOTSTRAP.partition("{version}")
    known = F.filter(F.transform(used, lambda c: F.try_element_at(definitions, c)), lambda x: x.isNotNull())
    return F.when(F.size(known) == 0, "").otherwise(F.concat(F.lit(head), version.cast("string"), F.lit(tail), F.array_join(known, "; ")))


def seed_definitions() -> Column:
    lines = {code: f"{code}={expansion}" for code, expansion, _ in fixed.SEEDS} | {fixed.BUNDLE: f"{fixed.BUNDLE}={'+'.join(fixed.BUNDLE_MEMBERS)}"}
    return F.create_map(*[F.lit(x) for kv in lines.items() for x in kv])


def escaped(phrase: str | Column) -> str | Column:
    """A literal phrase's surface form: what would mean something in a pattern stands for itself."""
    if isinstance(phrase, str):
        return re.escape(phrase)
    return F.regexp_replace(phrase, r"([\\.\[\]{}()*+?^$|#&~\s-])", r"\\$1")

"""Operator 3: URL filter by mined association rules. DataFrame functions only.

A URL becomes a set of tokens: the parts of its host, path and query. A page is
labelled by the labels of its document and, where a given rule fits it, by that
rule's verdict. FP-growth over the labelled pages' tokens and their label finds
token combinations that go with bad pages; a rule stays if its support, confidence and lift reach their
thresholds and no shorter rule over some of its tokens is as confident. Kept
rules form an inverted index from token to rule: a page's tokens are looked up,
and a rule fits when all of its tokens were found.

Tokens that occur on exactly the same labelled pages (the constant parts of a
site's URLs, say) are one item for the miner, named by its smallest token, so that
it doesn't list all their subsets: n such tokens give one item, not 2^n sets. Rules
over one of them hold for any of them, so a page has the item if it has one of
its tokens. Whether a shorter rule is as confident is found level by level: a set
looks at the sets with one item less, and takes over the best that those know.

Given rules (host and path prefixes) go first; the longest that fits wins.
Mined rules decide about the other pages: blocked if one fits, else allowed.

Null URLs and those without ``://`` have an empty host and path, no token and
no rule, and are allowed. Labels may be missing, null or repeated (one bad label
is enough). A page whose URL names no document counts under its own number. Without labels, or without a rule that reaches the thresholds,
given rules decide alone. Repeated rows get the same verdict.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stored

#: Share of the labelled pages that a combination needs; share of its pages that must be bad; and how many times the usual share that must be.
SUPPORT, CONFIDENCE, LIFT = 0.002, 0.8, 1.5
#: Pages that a combination needs whatever the number of labels; fewer say nothing.
LEAST_PAGES = 25
BAD = "=bad"


@dataclass(frozen=True)
class Rule:
    """Fits the host and all its subdomains where the URL's path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule's text and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels and their hyphenated parts, path segments (digits as #), query parameters and fragment."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    fragment = F.regexp_extract(F.coalesce(url, F.lit("")), r"#(.*)$", 1)
    named = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    digits = lambda x: F.regexp_replace(x, r"\d+", "#")
    return F.array_distinct(F.concat(
        named("host:", F.split(host, r"\.")), named("word:", F.flatten(F.transform(F.filter(F.split(host, r"\."), lambda x: x.contains("-")), lambda x: F.split(x, "-")))), named("path:", F.transform(F.split(path, "/"), digits)),
        named("query:", F.transform(F.split(query, "&"), digits)), named("fragment:", F.array(digits(fragment))),
    ))


def document_of(page_id: Column, url: Column) -> Column:
    """The number that ends the URL's path, else the page's own."""
    return F.coalesce(F.regexp_extract(path_of(url), r"/(\d{1,18})(?:\.\w+)?/?$", 1).try_cast("bigint"), page_id)


def labelled(pages: DataFrame, labels: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per labelled page: page_id, url, bad. A label of its document or a given rule that blocks it makes it bad."""
    is_bad = F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))
    label = labels.groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max(is_bad).alias("by_label"))
    known = pages.select("page_id", "url", document_of(F.col("page_id"), F.col("url")).alias("document"), (best_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"] == "block").alias("by_rule"))
    found = known.join(label, F.col("document") == F.col("labelled_id"), "left").filter("by_label is not null or by_rule is not null")
    return found.select("page_id", "url", (F.coalesce("by_label", F.lit(False)) | F.coalesce("by_rule", F.lit(False))).alias("bad"))


def items(known: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(baskets, classes): per labelled page its items (array, with ``=bad`` where it is), and token, item of all tokens on ``least`` pages or more. Tokens of equal page sets share an item."""
    rows = stored(known.select(F.monotonically_increasing_id().alias("row"), "bad", url_tokens(F.col("url")).alias("tokens")))
    each = rows.select("row", F.explode("tokens").alias("token"))
    # pages as sums of two hashes: equal for equal sets, whatever their order, and combined before the shuffle
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(20,0)")).alias(f"mark{seed}")
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), mark(1), mark(2)).filter(F.col("n") >= least)
    named = counts.groupBy("n", "mark1", "mark2").agg(F.min("token").alias("item"))
    classes = stored(counts.join(named, ["n", "mark1", "mark2"]).select("token", "item"))
    found = each.join(classes, "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    none = F.array().cast("array<string>")
    baskets = rows.join(found, "row", "left").select(F.concat(F.coalesce("items", none), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(none)).alias("items"))
    return baskets, classes


def shortest(sets: DataFrame) -> DataFrame:
    """Of sets (tokens, n, confidence, rule: whether thresholds are reached) the rules that no shorter rule over some of their tokens matches in confidence.

    Every subset of a set is among them, so ``best``, the highest confidence of a rule inside a set, goes from level to level.
    """
    own = F.when(F.col("rule"), F.col("confidence"))
    sets = stored(sets.withColumn("id", F.xxhash64("tokens")))
    depth = sets.agg(F.max("n")).first()[0] or 0
    below, kept = None, []
    for n in range(1, depth + 1):
        level = sets.filter(F.col("n") == n)
        if below is None:
            level = level.withColumn("inside", F.lit(None).cast("double"))
        else:
            parts = level.select("id", F.explode(F.transform("tokens", lambda t: F.xxhash64(F.array_remove(F.col("tokens"), t)))).alias("part"))
            inside = parts.join(below.select(F.col("id").alias("part"), "best"), "part").groupBy("id").agg(F.max("best").alias("inside"))
            level = level.join(inside, "id", "left")
        below = stored(level.withColumn("best", F.greatest(own, "inside")))
        kept.append(below.filter("rule and (inside is null or inside < confidence)").select("id", "tokens", "n", "confidence"))
    if not kept:
        return sets.select("id", "tokens", "n", "confidence")
    return reduce(DataFrame.unionByName, kept)


def mine(known: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, least: int = LEAST_PAGES) -> tuple[DataFrame, DataFrame]:
    """Rules (id, tokens: their items, n, confidence) from labelled pages (url, bad), and the items (token, item). Their number depends on the support, not on the corpus."""
    total = known.count()
    share = max(support, min(1.0, least / max(1, total)))
    baskets, classes = items(known, math.ceil(share * total))
    baskets = stored(baskets.filter(F.size("items") > 0))  # read twice by the miner
    share = max(support, min(1.0, least / max(1, baskets.count())))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=0.0).fit(baskets)
    sets = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    reached = (F.col("confidence") >= confidence) & (F.col("lift") >= lift)
    return shortest(sets.select(F.array_sort("antecedent").alias("tokens"), F.size("antecedent").alias("n"), "confidence", reached.alias("rule"))), classes


def fitting(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """The distinct URLs of ``urls`` that a mined rule fits: (url, mined), the smallest rule text being named, in the URL's own tokens."""
    index = rules.select("id", "n", F.explode("tokens").alias("item"))
    usable = classes.join(index.select("item").distinct(), "item", "left_semi")
    tokens = urls.select("url").distinct().withColumn("token", F.explode(url_tokens(F.col("url"))))
    own = tokens.join(usable, "token").groupBy("url", "item").agg(F.min("token").alias("token"))
    text = F.array_join(F.array_sort(F.collect_list("token")), " ")
    return (
        own.join(index, "item").groupBy("url", "id", "n").agg(F.count(F.lit(1)).alias("found"), text.alias("text"))
        .filter("found = n").groupBy("url").agg(F.min("text").alias("mined"))
    )


def judged(pages: DataFrame, labels: DataFrame, rules: list[Rule], **thresholds: float) -> DataFrame:
    """Per page: page_id, host, path, rule (a given rule's text or null), verdict, mined (a mined rule's tokens or null)."""
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("given", best_rule(F.col("host"), F.col("path"), rules))
    found = fitting(pages, *mine(stored(labelled(pages, labels, rules)), **thresholds)).withColumnRenamed("url", "__url")
    return base.join(found, F.col("url") == F.col("__url"), "left").select(
        "page_id", "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined",
    )

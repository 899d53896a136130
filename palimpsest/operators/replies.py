"""Replies: codes and references expanded, requests for expansion recognised, sizes accounted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.strings import found, lines, replaced_each
from palimpsest.operators.dictionary import expand

ASKED = r"(?i)\[?(?:code|ref):\s*([0-9a-f]{16})"


def expand_references(c: Column, originals: Column) -> Column:
    """References become the stored originals (map<hash, text>); unknown ones stay."""
    return replaced_each(c, fixed.REFERENCE, lambda m, i: F.coalesce(F.try_element_at(originals, F.lower(F.regexp_extract(m, fixed.REFERENCE, 1))), m))


def decode(c: Column, expansions: Column, originals: Column | None = None, route: str = "human") -> Column:
    """What a human reads; agents get the text as it is."""
    if route == "agent":
        return c
    out = expand(c, expansions)
    return expand_references(out, originals) if originals is not None else out


def asked_hashes(c: Column) -> Column:
    """Distinct hashes on lines that say expand, in order."""
    hits = F.filter(lines(c), lambda x: x.rlike(r"(?Ui)\bexpand"))
    return F.array_distinct(F.transform(F.flatten(F.transform(hits, lambda x: found(x, ASKED, 1))), F.lower))


def expansion_requests(replies: DataFrame, originals: DataFrame) -> DataFrame:
    """Replies (conv_id, seq, reply) that ask for stored originals (conv_id, hash, text): conv_id, seq, pos, hash, text."""
    asked = replies.select("conv_id", "seq", F.posexplode(asked_hashes(F.col("reply"))).alias("pos", "hash"))
    return asked.join(originals, ["conv_id", "hash"])


def supplement(requests: DataFrame, most: int = 3) -> DataFrame:
    """The text that a retry appends: the first few originals of each reply."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "hash", "text")))
    return requests.groupBy("conv_id", "seq").agg(F.array_join(F.transform(F.slice(ordered, 1, most), lambda x: F.concat(F.lit("["), x["hash"], F.lit("]\n"), x["text"])), "\n\n").alias("supplement"))


def accounted(replies: DataFrame, expansions: Column, count) -> DataFrame:
    """Adds decoded, original_tokens (of the decoded text), encoded_tokens (generated) and saved."""
    out = replies.withColumn("decoded", expand(F.col("reply"), expansions))
    out = out.withColumns({"original_tokens": count(F.col("decoded")), "encoded_tokens": count(F.col("reply")), "direction": F.lit("out")})
    return out.withColumn("saved", F.col("original_tokens") - F.col("encoded_tokens"))

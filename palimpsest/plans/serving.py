"""State around encoding, as joins and aggregates over the log of requests: result cache, minting epochs, asked expansions, session store, failed requests.

A request log has one row per encode, with ``seq`` as its order. Nothing here
sorts a scope, a session or a key in one task: what comes first is a minimum,
ranks come from counts per range of ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.strings import content_hash, text

#: Width of the ranges of ``seq`` that are ranked each by itself.
RANGE = 4096


def cache_key(messages: Column, model: Column, mode: Column, session: Column, scope: Column, generations: Column) -> Column:
    """Key of a request: equal for equal messages (array<struct>), model, mode, session, scope and number of generations. Null for requests that aren't cached: those with more than one message, or in mode OFF."""
    parts = F.struct(messages.alias("messages"), model.alias("model"), mode.alias("mode"), session.alias("session"), scope.alias("scope"), generations.alias("generations"))
    return F.when((F.size(messages) == 1) & (mode != "OFF"), F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256))


def cache_fills(log: DataFrame) -> DataFrame:
    """key, filled: the first request of each key (seq, key, fallback) that didn't fall back; the others fill nothing."""
    return log.filter("key is not null and not fallback").groupBy("key").agg(F.min("seq").alias("filled"))


def with_hits(log: DataFrame) -> DataFrame:
    """Adds ``cached``: whether an earlier request had filled the cache. Requests without a key are never cached."""
    return log.join(cache_fills(log), "key", "left").withColumn("cached", F.coalesce(F.col("seq") > F.col("filled"), F.lit(False))).drop("filled")


def epochs(log: DataFrame, every: int = fixed.MINT_EVERY) -> DataFrame:
    """Adds ``epoch`` to the encodes of a log (scope, seq) that weren't cached: how often minting was tried in their scope before."""
    rows = log.withColumn("part", F.floor(F.col("seq") / RANGE))
    counts = rows.groupBy("scope", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("scope").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("scope", "part").orderBy("seq"))
    ranked = rows.withColumn("place", place).join(counts.select("scope", "part", before.alias("before")), ["scope", "part"])
    return ranked.withColumn("epoch", F.floor((F.col("before") + F.col("place") - 1) / every)).drop("part", "place", "before")


def with_generation(log: DataFrame, minted: DataFrame, first: int = 1) -> DataFrame:
    """Adds ``generation``, as of each encode: ``first`` and one for every earlier epoch whose minting succeeded (scope, epoch). A new generation is used from the epoch after on."""
    marks = log.select("scope", "epoch", F.lit(0).alias("new")).union(minted.select("scope", "epoch", F.lit(1))).filter("epoch is not null")
    steps = marks.groupBy("scope", "epoch").agg(F.max("new").alias("new")).withColumn("part", F.floor(F.col("epoch") / RANGE))
    counts = steps.groupBy("scope", "part").agg(F.sum("new").alias("n"))
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("scope", "part", so_far("n", Window.partitionBy("scope").orderBy("part")).alias("before"))
    within = steps.withColumn("within", so_far("new", Window.partitionBy("scope", "part").orderBy("epoch")))
    number = within.join(before, ["scope", "part"]).select("scope", "epoch", (F.col("before") + F.col("within")).alias("n"))
    return log.join(number, ["scope", "epoch"]).withColumn("generation", F.col("n") + first).drop("n")


def pending(asked: DataFrame, routed: DataFrame) -> DataFrame:
    """conv_id, req_no, hash: the first request from each asking (conv_id, hash, since) on that sends the text as an old turn. It ships verbatim there, once."""
    old = routed.filter("route not in ('new', 'empty')").select("conv_id", "req_no", "hash").distinct()
    return asked.join(old, ["conv_id", "hash"]).filter("req_no >= since").groupBy("conv_id", "hash", "since").agg(F.min("req_no").alias("req_no")).select("conv_id", "req_no", "hash").distinct()


def advance(store: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The session store after a batch of messages (session, seq, content): session, kind, key, first.

    A long table: the hash of each content and each code in it, with their first
    use, and one row per turn. Merging is a minimum per key, so a batch may come
    twice or late, sessions of any length stay spread, and no history is replayed.
    """
    said = batch.select("session", "seq", text("content").alias("content"))
    codes = F.array_distinct(F.regexp_extract_all("content", F.lit(fixed.CODE), F.lit(1)))
    facts = said.select("session", F.lit("hash").alias("kind"), content_hash(F.col("content")).alias("key"), "seq").union(
        said.select("session", F.lit("code").alias("kind"), F.explode(codes).alias("key"), "seq")
    ).union(said.select("session", F.lit("turn").alias("kind"), F.col("seq").cast("string").alias("key"), "seq"))
    new = facts.groupBy("session", "kind", "key").agg(F.min("seq").alias("first"))
    return new if store is None else store.unionByName(new).groupBy("session", "kind", "key").agg(F.min("first").alias("first"))


def failed(bodies: DataFrame, error: str = "MalformedBody") -> DataFrame:
    """Requests that can't be read (body, malformed) pass on as they are: adds ``content``, ``fallback`` and ``fallback_reason``. No request is lost and none fails another."""
    return bodies.withColumns({
        "content": F.when(F.col("malformed"), F.col("body")), "fallback": F.col("malformed"), "fallback_reason": F.when(F.col("malformed"), f"error:{error}").otherwise(""),
    })

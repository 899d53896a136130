"""Sessions: ids, learnt entities, repeated blobs and used codes, as functions of a conversation's ordered messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.strings import begun, content_hash, found, text


def session_ids(messages: DataFrame) -> DataFrame:
    """conv_id, session: hash of the heads of the first system and the first user message."""
    head = lambda role: F.coalesce(F.substring(F.min_by(F.when(F.col("role") == role, text("content")), F.when(F.col("role") == role, F.col("idx"))), 1, 400), F.lit(""))
    return messages.groupBy("conv_id").agg(content_hash(F.concat(head("system"), head("user"))).alias("session"))


def entity_names(c: Column) -> Column:
    """Runs of two to four capitalised words without leading stop words, if two words and eight letters are left."""
    words = F.transform(found(c, begun(fixed.ENTITY, "A-Z"), 1, fixed.ENTITY_SHAPE), lambda n: F.split(n, r"(?U)\s+"))
    dropped = F.transform(words, lambda ws: F.aggregate(ws, F.array().cast("array<string>"), lambda kept, w: F.when((F.size(kept) == 0) & w.isin(*fixed.ENTITY_STOPS), kept).otherwise(F.array_append(kept, w))))
    return F.transform(F.filter(dropped, lambda ws: (F.size(ws) >= 2) & (F.length(F.array_join(ws, " ")) >= 8)), lambda ws: F.array_join(ws, " "))


def sightings(messages: DataFrame) -> DataFrame:
    """conv_id, req_no, idx, pos, name: one row per entity mention of user and system messages, each time that a request sends it."""
    return messages.filter(F.col("role").isin("user", "system")).select("conv_id", "req_no", "idx", F.posexplode(entity_names(text("content"))).alias("pos", "name"))


def entities(seen: DataFrame) -> DataFrame:
    """conv_id, req_no (from which on it is known), number, code, name: names in the order in which they were read for the second time.

    A history that is sent again is read again, so a name that was mentioned
    once becomes an entity with the second request.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id", "name").orderBy("req_no", "idx", "pos"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("req_no", "idx", "pos"))
    return seen.withColumn("nth", nth).filter("nth = 2").select("conv_id", "req_no", number.alias("number"), F.concat(F.lit("E"), number.cast("string")).alias("code"), "name")


def entity_pairs(table: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request (conv_id, req_no): pairs (longest name first), codes, and the block of definitions in code order."""
    known = requests.select("conv_id", "req_no").join(table.withColumnRenamed("req_no", "since"), "conv_id").filter("since <= req_no")
    by_length = F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("order"), "number", "name", "code")))
    by_number = F.array_sort(F.collect_list(F.struct("number", "code", F.concat_ws("=", "code", "name").alias("line"))))
    return known.groupBy("conv_id", "req_no").agg(by_length.alias("x"), by_number.alias("y")).select(
        "conv_id", "req_no", F.transform("x", lambda p: F.struct(p["name"].alias("name"), p["code"].alias("code"))).alias("pairs"),
        F.col("y.code").alias("entity_codes"), F.concat(F.lit("ENT: "), F.array_join("y.line", "; ")).alias("entity_block"),
    )


def repeated(blobs: DataFrame) -> DataFrame:
    """Blobs (conv_id, idx, content) with hash, seen (before in the conversation) and first_idx."""
    rows = blobs.withColumn("hash", content_hash(text("content")))
    # the first place is a minimum, combined before the shuffle; contents aren't sorted
    first = rows.groupBy("conv_id", "hash").agg(F.min("idx").alias("first_idx"))
    return rows.join(first.select(F.col("conv_id").alias("__conv"), F.col("hash").alias("__hash"), "first_idx"), F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("hash") == F.col("__hash"))).drop("__conv", "__hash").withColumn("seen", F.col("idx") > F.col("first_idx"))


def used_codes(mentions: DataFrame) -> DataFrame:
    """Mentions (conv_id, req_no, pos, code): conv_id, codes in the order of their first use."""
    first = mentions.groupBy("conv_id", "code").agg(F.min(F.struct("req_no", "pos")).alias("first"))
    return first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "code")))["code"].alias("codes"))

"""Requests of a conversation: each user turn sends all messages up to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def requests(messages: DataFrame) -> DataFrame:
    """conv_id, req_no (from 1), last_idx: one request per user message."""
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("idx"))
    return messages.filter("role = 'user'").select("conv_id", number.alias("req_no"), F.col("idx").alias("last_idx"))


def final_requests(messages: DataFrame) -> DataFrame:
    """One request per conversation that sends everything."""
    return messages.groupBy("conv_id").agg(F.lit(1).alias("req_no"), F.max("idx").alias("last_idx"))


def replayed(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """Messages of every request. The rows are as many as what the requests send; sums over prefixes alone are cheaper with ``prefix_tokens``."""
    return asked.join(messages, "conv_id").filter("idx <= last_idx")


def prefix_tokens(counted: DataFrame) -> DataFrame:
    """conv_id, idx, upto: tokens of all messages up to idx, by a running sum instead of a prefix join."""
    window = Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("upto", F.sum("tokens").over(window))

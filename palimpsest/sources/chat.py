"""Sources and sinks of chat traffic: request bodies, reply streams, dictionary packs, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BODY = "model string, stream boolean, system string, prompt string, messages array<struct<role:string,content:string,tool_calls:string,tool_call_id:string>>"
PARTS = "array<struct<type:string,text:string>>"


def content_text(content: Column) -> Column:
    """Text of a content value: a JSON list of parts gives its parts' texts, null an empty text."""
    parts = F.from_json(content, PARTS)
    listed = content.startswith("[") & parts.isNotNull()
    return F.when(listed, F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(F.coalesce(content, F.lit("")))


def bodies(df: DataFrame, body: str = "body") -> DataFrame:
    """Parsed request bodies beside a ``malformed`` flag; broken ones pass on unparsed."""
    parsed = F.from_json(F.col(body), BODY, {"mode": "PERMISSIVE"})
    return df.withColumn("request", parsed).withColumn("malformed", F.col("request.messages").isNull() & F.col("request.prompt").isNull())


def chat_messages(df: DataFrame, provider: str) -> DataFrame:
    """Requests (conv_id, request) as message rows; both chat forms differ by provider alone."""
    rows = df.select("conv_id", F.col("request.model").alias("model"), F.posexplode("request.messages").alias("idx", "m"))
    return rows.select(
        "conv_id", F.lit(provider).alias("provider"), "model", "idx", F.col("m.role").alias("role"), content_text(F.col("m.content")).alias("content"),
        F.coalesce(F.col("m.tool_calls").isNotNull(), F.lit(False)).alias("has_tool_calls"), F.col("m.tool_call_id").alias("tool_call_id"),
    )


def with_system_first(messages: DataFrame, systems: DataFrame) -> DataFrame:
    """A top-level system text (conv_id, system) becomes message 0; the others move up by one where there is one."""
    there = systems.filter("system is not null").select("conv_id", "system")
    moved = messages.join(there.select("conv_id", F.lit(1).alias("shift")), "conv_id", "left").withColumn("idx", F.col("idx") + F.coalesce("shift", F.lit(0))).drop("shift")
    first = there.select("conv_id", F.lit(0).alias("idx"), F.lit("system").alias("role"), F.col("system").alias("content"))
    return moved.unionByName(first, allowMissingColumns=True)


def system_block(messages: DataFrame) -> DataFrame:
    """All system texts of a conversation, joined by a newline in order: conv_id, system."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "content")))
    return messages.filter("role = 'system'").groupBy("conv_id").agg(F.array_join(ordered["content"], "\n").alias("system"))


def generate_messages(prompts: DataFrame) -> DataFrame:
    """Requests with a system text and a prompt (conv_id, system, prompt) as one or two messages."""
    both = F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")), F.struct(F.lit("user").alias("role"), F.coalesce("prompt", F.lit("")).alias("content")))
    there = F.filter(both, lambda m: (m["role"] == "user") | (F.coalesce(m["content"], F.lit("")) != ""))
    return prompts.select("conv_id", F.posexplode(there).alias("idx", "m")).select("conv_id", "idx", "m.role", "m.content")


def generate_request(messages: DataFrame) -> DataFrame:
    """Message rows back as one system text and one prompt, each joined by blank lines: conv_id, system, prompt."""
    ordered = lambda cond: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("idx", "role", "content"))), lambda m: cond(m["role"])), lambda m: m["content"]), "\n\n")
    return messages.groupBy("conv_id").agg(ordered(lambda r: r == "system").alias("system"), ordered(lambda r: r != "system").alias("prompt"))


def sse_deltas(frames: DataFrame, path: str = "$.choices[0].delta.content") -> DataFrame:
    """Server-sent frames (session, seq, frame), batch or streaming: session, seq, delta, done. Other fields and comments give no row."""
    data = F.regexp_extract("frame", r"^data:\s*(.*)$", 1)
    rows = frames.filter(F.startswith(F.col("frame"), F.lit("data:"))).withColumn("data", data)
    done = (F.col("data") == "[DONE]") | F.coalesce(F.get_json_object("data", "$.type") == "message_stop", F.lit(False))
    return rows.select("session", "seq", F.when(~done, F.get_json_object("data", path)).alias("delta"), done.alias("done")).filter("done or delta is not null")


def block_deltas(frames: DataFrame) -> DataFrame:
    """Server-sent frames whose deltas are content blocks."""
    return sse_deltas(frames, "$.delta.text")


def ndjson_deltas(frames: DataFrame, path: str = "$.message.content") -> DataFrame:
    """Newline-delimited frames: session, seq, delta, done; an error frame ends the reply."""
    done = F.coalesce(F.get_json_object("frame", "$.done") == "true", F.lit(False)) | F.get_json_object("frame", "$.error").isNotNull()
    return frames.select("session", "seq", F.get_json_object("frame", path).alias("delta"), done.alias("done")).filter("done or delta is not null")


def with_end(deltas: DataFrame) -> DataFrame:
    """Deltas of finished streams (session, seq, delta, done), of which those that broke off get a last row with ``done``, so that what a decoder holds comes out."""
    return deltas.unionByName(missing_ends(deltas))


def missing_ends(deltas: DataFrame) -> DataFrame:
    """The last rows that streams which broke off lack."""
    last = deltas.groupBy("session").agg(F.max("seq").alias("seq"), F.max("done").alias("ended"))
    return last.filter("not ended").select("session", (F.col("seq") + 1).alias("seq"), F.lit(None).cast("string").alias("delta"), F.lit(True).alias("done"))


def write_dictionary(aliases: DataFrame, generations: DataFrame, path: str) -> None:
    """One folder per table, partitioned by scope; only the scopes written are replaced."""
    for name, table in (("aliases", aliases), ("generations", generations)):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope").parquet(f"{path}/{name}")


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(aliases, generations); scopes are strings, whatever their names look like."""

    def table(name: str) -> DataFrame:
        found = spark.read.parquet(f"{path}/{name}").schema
        return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType() if f.name == "scope" else f.dataType) for f in found])).parquet(f"{path}/{name}")

    return table("aliases"), table("generations")


def exported(aliases: DataFrame) -> DataFrame:
    """scope, pack: the aliases as JSON."""
    return aliases.groupBy("scope").agg(F.to_json(F.array_sort(F.collect_list(F.struct("code", "expansion", "surface_forms", "members")))).alias("pack"))


def pack_aliases(packs: DataFrame) -> DataFrame:
    """The aliases of JSON packs (scope, pack)."""
    kind = "array<struct<code:string,expansion:string,surface_forms:array<string>,members:array<string>>>"
    return packs.select("scope", F.explode(F.from_json("pack", kind)).alias("a")).select("scope", "a.*")


def append_events(events: DataFrame, path: str) -> None:
    """Appends to the events table, partitioned by day so that time filters prune."""
    day = F.to_date(F.timestamp_seconds(F.col("ts")))
    events.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def hook_filtered(prompts: DataFrame, least_chars: int = 200, least_saved: int = 20) -> DataFrame:
    """Prompts (prompt, fallback, saved) with ``applied``: long ones whose encoding pays."""
    return prompts.withColumn("applied", (F.length("prompt") >= least_chars) & ~F.col("fallback") & (F.col("saved") >= least_saved))

"""Folding of old turns: fences and repeats become references, long texts their key lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.strings import content_hash, found, lines, replaced_each, rstrip, strip


def fence_reference(body: Column, seen: Column) -> Column:
    return F.concat(F.lit("[code:"), content_hash(body), F.lit(" "), (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))).cast("string"), F.lit("L"), F.when(seen, " seen").otherwise(""), F.lit("]"))


def fold_fences(c: Column, seen_before: Column | None = None) -> Column:
    """Fences become references; one that occurred earlier in the text, or whose hash is in ``seen_before``, says so."""
    bodies = found(c, fixed.FENCE)
    known = seen_before if seen_before is not None else F.array().cast("array<string>")
    return replaced_each(c, fixed.FENCE, lambda m, i: F.when(m.isNotNull(), fence_reference(m, F.array_contains(F.slice(bodies, F.lit(1), i), m) | F.array_contains(known, content_hash(m)))))


def blob_reference(c: Column, kind: Column, turn: Column) -> Column:
    """``kind`` and ``turn`` of the first sighting, null for none; short texts stay."""
    ref = F.concat(F.lit("[ref:"), content_hash(c), F.lit(" "), kind, F.lit(" unchanged from turn "), turn.cast("string"), F.lit("]"))
    return F.when((F.length(c) >= fixed.LEAST_BLOB) & kind.isNotNull(), ref).otherwise(c)


def with_key_lines(df: DataFrame, column: str, out: str, most: int) -> DataFrame:
    """Adds the ``most`` best lines in their order, and how many were folded; everything if there are no more than that.

    Each step is a column of its own, so that no expression is evaluated, or
    planned, once per use.
    """
    c, units, scored = F.col(column), F.col("__units"), F.col("__scored")
    rows = df.withColumn("__plain", F.filter(F.transform(lines(c), rstrip), lambda x: F.length(strip(x)) > 0))
    sentences = F.filter(F.flatten(F.transform("__plain", lambda x: F.transform(F.split(x, fixed.SENTENCE_GAP), strip))), lambda x: x != "")
    rows = rows.withColumn("__units", F.when((F.size("__plain") <= most) & (F.length(c) > 200), sentences).otherwise(F.col("__plain")))

    def score(line: Column, i: Column) -> Column:
        edge = F.when((i == 0) | (i == F.size(units) - 1), 2).otherwise(0)
        key = F.when(line.rlike(fixed.KEY_LINE), 3).otherwise(0)
        return edge + key + F.when(line.rlike(fixed.HEADER), 1).otherwise(0) - F.when(F.length(line) > 200, 1).otherwise(0)

    rows = rows.withColumn("__scored", F.array_sort(F.transform(units, lambda x, i: F.struct((-score(x, i)).alias("worst"), i.alias("i"), x.alias("line")))))
    best = F.array_sort(F.transform(F.slice(scored, 1, most), lambda s: F.struct(s["i"].alias("i"), s["line"].alias("line"))))
    shown = F.transform(best, lambda s: F.when(F.length(s["line"]) > fixed.LINE_LENGTH, F.concat(F.substring(s["line"], 1, fixed.LINE_LENGTH - 3), F.lit("..."))).otherwise(s["line"]))
    folded = F.concat(F.array_join(shown, "\n"), F.lit("\n[+"), (F.size(units) - most).cast("string"), F.lit(" lines folded]"))
    return rows.withColumn(out, F.when(F.size(units) <= most, F.array_join(units, "\n")).otherwise(folded)).drop("__plain", "__units", "__scored")


def with_folded_turn(df: DataFrame, column: str, out: str, most: int, seen: Column | None = None) -> DataFrame:
    """Fences become references (``seen``: hashes of those that earlier messages had), then the key lines stay."""
    return with_key_lines(df.withColumn("__fenced", fold_fences(F.col(column), seen)), "__fenced", out, most).drop("__fenced")


def with_notes(old: DataFrame) -> DataFrame:
    """Adds to old turns (conv_id, req_no, idx, content, hash, route, summary) what their conversation had noted before them.

    A tool result is noted where it becomes a reference, a fence where the message that holds it is folded. The first
    note of a text counts: ``note`` (req_no, idx, pos, kind) of the turn's whole text, null if none came before the
    turn, and ``seen``, the hashes of the turn's own fences that earlier turns had. Turns that are references
    themselves, or have a summary, note none of their fences; those that repeat a fence come after its note anyway.
    """
    turn = ["conv_id", "req_no", "idx"]
    at = lambda pos, kind: F.struct("req_no", "idx", pos.cast("int").alias("pos"), F.lit(kind).alias("kind")).alias("note")
    before = lambda note: F.col(note).isNotNull() & (F.struct(F.col(f"{note}.req_no"), F.col(f"{note}.idx")) < F.struct("req_no", "idx"))
    tools = old.filter("route = 'tool-ref'").select("conv_id", "hash", at(F.lit(-1), "tool"))
    results = tools.groupBy("conv_id", "hash").agg(F.min("note").alias("result"))
    folds = old.filter("route = 'fold'").select(*turn, "hash", "content", "summary").join(results, ["conv_id", "hash"], "left")
    folds = folds.filter(F.col("summary").isNull() & F.contains("content", F.lit("```")) & ~((F.length("content") >= fixed.LEAST_BLOB) & before("result")))
    # the fences of a text are found once, however often it is sent
    fences = folds.groupBy("hash").agg(F.first("content").alias("content")).select("hash", F.posexplode(found(F.col("content"), fixed.FENCE)).alias("pos", "fence"))
    fences = folds.select(*turn, "hash").join(fences.select("hash", "pos", content_hash(F.col("fence")).alias("fence")), "hash")
    fences = fences.select(*turn, F.col("fence").alias("hash"), at(F.col("pos"), "code"))
    first = tools.union(fences.select("conv_id", "hash", "note")).groupBy("conv_id", "hash").agg(F.min("note").alias("first"))
    seen = fences.join(first, ["conv_id", "hash"]).filter(before("first")).groupBy(*turn).agg(F.array_sort(F.collect_set("hash")).alias("seen"))
    rows = old.join(first, ["conv_id", "hash"], "left").join(seen, turn, "left")
    return rows.withColumns({"note": F.when(before("first"), F.col("first")), "seen": F.coalesce("seen", F.array().cast("array<string>"))}).drop("first")


def to_summarise(old: DataFrame, threshold: int, least_chars: int = 800) -> DataFrame:
    """Old turns (conv_id, req_no, idx, content, tokens) worth a summary: long ones of requests whose history reaches the threshold; conv_id, idx, content, each once."""
    total = old.groupBy("conv_id", "req_no").agg(F.sum("tokens").alias("history")).filter(F.col("history") >= threshold)
    return old.join(total, ["conv_id", "req_no"]).filter(F.length("content") > least_chars).groupBy("conv_id", "idx").agg(F.first("content").alias("content"))


def with_summaries(old: DataFrame, summaries: DataFrame) -> DataFrame:
    """Old turns (conv_id, req_no, idx) with ``summary``: of the summaries (conv_id, start, end, since, summary) that cover a turn and were there before its request, the first by since and start; else null. Summaries only come in addition, so a turn keeps its text."""
    s = summaries.select("conv_id", "since", F.col("start").alias("s_start"), "end", F.col("summary"))
    keys = old.select("conv_id", "req_no", "idx").distinct()
    fit = keys.join(s, "conv_id").filter("idx between s_start and end and since < req_no")
    first = fit.groupBy("conv_id", "req_no", "idx").agg(F.min(F.struct("since", "s_start", "summary"))["summary"].alias("summary"))
    return old.join(first, ["conv_id", "req_no", "idx"], "left")


def to_compact(kept: DataFrame, window: int) -> DataFrame:
    """Digests that outgrew twice the window: conv_id, req_no, lines (all but the newest ``window``, in order) and the union of their turns' hashes."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "pos", "line")))
    old = kept.filter(F.col("newest") > window).groupBy("conv_id", "req_no").agg(F.max("newest").alias("n"), ordered["line"].alias("lines"), F.array_sort(F.collect_set("hash")).alias("hashes"))
    return old.filter(F.col("n") > 2 * window).select("conv_id", "req_no", "lines", "hashes")


def compacted(kept: DataFrame, due: DataFrame, replies: DataFrame, window: int) -> DataFrame:
    """Digest lines conv_id, req_no, place, line, hashes: where a reply (conv_id, req_no, text) came, its first four lines stand for the old ones and keep the union of their hashes; elsewhere all stay."""
    said = F.slice(F.filter(F.transform(lines(F.col("text")), strip), lambda x: x != ""), 1, 4)
    new = due.join(replies.select("conv_id", "req_no", said.alias("said")), ["conv_id", "req_no"]).filter(F.size("said") > 0)
    fresh = new.select("conv_id", "req_no", F.posexplode("said").alias("pos", "line"), "hashes")
    fresh = fresh.select("conv_id", "req_no", F.struct(F.lit(0).alias("ordinal"), F.col("pos").alias("pos")).alias("place"), "line", "hashes")
    stay = kept.join(new.select("conv_id", "req_no", F.lit(True).alias("done")), ["conv_id", "req_no"], "left").filter(F.col("done").isNull() | (F.col("newest") <= window))
    stay = stay.select("conv_id", "req_no", F.struct(F.col("ordinal").cast("int").alias("ordinal"), F.col("pos").cast("int").alias("pos")).alias("place"), "line", F.array("hash").alias("hashes"))
    return stay.unionByName(fresh)


def at_word(c: Column) -> Column:
    """Cut to the line length at the last space, unless that would lose half of it."""
    head = F.substring(c, 1, fixed.LINE_LENGTH - 3)
    space = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last space
    cut = F.when((F.instr(head, " ") > 0) & (space > 120), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(c) > fixed.LINE_LENGTH, F.concat(cut, F.lit("..."))).otherwise(c)

"""Encoded replay by intervals: every request of a conversation, without sending its history again and again.

A message is new from the request that first sends it up to the one that has
``keep`` messages after it, and old from then on. So it has a handful of states,
each over an interval of request numbers, and what requests add up over their
messages is a running sum over a difference array (plus at the start of a state,
minus at its end). Rows are linear in messages, where a join of requests with
their prefixes is quadratic.

- What depends on a text alone (skeleton, codes, lines for the digest, size) is
  computed once per distinct text, in tables that are written before and joined.
- A text is judged once for each set of known entities that touches it: those
  whose name or code it holds. Its intervals are cut where one of them is learnt.
- The digest of a request is a run of the conversation's numbered lines, and
  changes only where a turn is absorbed.
- A code is active from its first to its last mention in a stretch; requests get
  the codes of the stretches over them, which is what their blocks define.

Requests carry the scope and the generation of the dictionary that they are
encoded with, and the profile that counts their tokens. Scope and profile are
those of a conversation, the generation may change with every request. Request
numbers run from 1 without gaps; ``last_idx`` is the place of a message.

A message may carry an ``error`` (what is wrong with it, as its reader found), and a counter may fail on a text, which
gives null. Requests that send such a message fail alone: they ship what they were given, with ``error:`` and the kind
of the first one as their reason. All others go on.

With a ``memo``, what was computed for a text (its skeleton, its lines, its codes, its form for a set of entities) is
kept from call to call, so that a conversation that goes on costs the patterns of its new texts only. A memo belongs to
one dictionary, whose generations don't change, one counter and one set of settings.

Results equal ``encode.encode`` on the replayed prefixes (tested row by row); in mode OFF nothing is rewritten, so there is
no rewritten text to report either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.config import Settings
from palimpsest.functions.strings import content_hash, text
from palimpsest.functions.tokens import estimate
from palimpsest.operators import dictionary, sessions
from palimpsest.operators.automaton import Dictionary
from palimpsest.plans import encode
from palimpsest.streaming.store import Memo, written

#: What a text's rewriting depends on beside the text.
CONTEXT = ["scope", "version", "profile"]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt before costly work on their texts, to more tasks than there are cores: hashed once more, or a grouping by the same keys would lend its few large partitions."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, F.xxhash64(*keys))


def spans(messages: DataFrame, asked: DataFrame, settings: Settings) -> DataFrame:
    """Messages (conv_id, idx, role, content, has_tool_calls) that some request sends, with place, key (of the text), from_req, old_from (null: never old), last_req, and the conversation's scope and profile."""
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("idx")
    sent = asked.select("conv_id", F.col("last_idx").alias("idx"), "req_no").groupBy("conv_id", "idx").agg(F.min("req_no").alias("req_no"))
    whole = asked.groupBy("conv_id").agg(F.max("req_no").alias("last_req"), F.first("scope").alias("scope"), F.first("profile").alias("profile"))
    error = (F.col("error") if "error" in messages.columns else F.lit(None)).cast("string").alias("error")
    rows = messages.select("conv_id", "idx", "role", text("content").alias("content"), F.coalesce("has_tool_calls", F.lit(False)).alias("has_tool_calls"), error).join(sent, ["conv_id", "idx"], "left")
    rows = rows.withColumns({"place": F.row_number().over(order) - 1, "from_req": F.min("req_no").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    old = F.lit(settings.fold_history) & (F.col("place") > 0) & F.col("role").isin("user", "assistant", "tool") & (F.col("content") != "")
    rows = rows.withColumn("old_from", F.when(old, F.lead("from_req", settings.keep).over(order))).drop("req_no").filter("from_req is not null")
    return rows.join(whole, "conv_id").withColumn("key", F.sha2("content", 256))


def old_route() -> Column:
    """The route of an old message, as in ``encode.routed``."""
    return F.when(F.col("has_tool_calls"), "tool-call").when(F.col("role") == "tool", F.when(F.length("content") > fixed.LEAST_TOOL_RESULT, "tool-ref").otherwise("tool")).otherwise("digest")


def learnt(rows: DataFrame) -> DataFrame:
    """Entities (conv_id, number, code, name, since): as ``sessions.entities`` finds them in all prefixes, from each message once.

    The second reading of a name is its second mention, if the same request brings it, or else its first one sent again.
    """
    seen = rows.filter(F.col("role").isin("user", "system")).select("conv_id", "from_req", "last_req", "idx", F.posexplode("names").alias("pos", "name"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "name").orderBy("from_req", "idx", "pos"))
    first = seen.withColumn("nth", nth).filter("nth <= 2").groupBy("conv_id", "name").agg(
        F.min(F.struct("from_req", "idx", "pos")).alias("a"), F.max(F.struct("from_req", "idx", "pos")).alias("b"), F.count(F.lit(1)).alias("n"), F.first("last_req").alias("last_req"),
    )
    at_once = (F.col("n") == 2) & (F.col("a.from_req") == F.col("b.from_req"))
    known = first.select("conv_id", "name", "last_req", F.when(at_once, F.col("b.from_req")).otherwise(F.col("a.from_req") + 1).alias("since"), F.when(at_once, F.col("b")).otherwise(F.col("a")).alias("at"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("since", "at.idx", "at.pos"))
    known = known.filter("since <= last_req").withColumn("number", number)
    return known.select("conv_id", "number", F.concat(F.lit("E"), F.col("number").cast("string")).alias("code"), "name", "since")


def _marks(c: Column) -> Column:
    """Two characters at either side of each blank: a name's first blank is among those of every text that holds it."""
    return F.regexp_extract_all(c, F.lit(r"(?s)(?=(\S\S \S\S))"), F.lit(1))


def touched(rows: DataFrame, entities: DataFrame, said: Column, also: Column) -> DataFrame:
    """Rows (conv_id, from_req, until_req) cut where an entity is learnt that touches them, with ``pairs``: the entities known by then whose name ``said`` holds or whose code it or ``also`` mentions, longest name first.

    Entities and texts meet by marks of names and by codes, not each with each. A name that looks like a code may be
    made by another's replacement, so it counts as touching every text of its conversation.
    """
    rows = rows.withColumn("__id", F.xxhash64(*[F.col(f"`{c}`") for c in ("conv_id", "idx", "from_req")])).withColumns({"__said": said, "__codes": F.array_distinct(F.concat(dictionary.codes(said), dictionary.codes(also)))})
    odd = F.regexp_like("name", F.lit(fixed.CODE))
    signs = entities.select("*", odd.alias("odd"), F.explode(F.array_distinct(F.concat(F.slice(_marks(F.col("name")), 1, 1), F.array("code"), F.when(odd, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))))).alias("mark"))
    state = ["conv_id", "idx", "from_req"]
    # marks meet without their texts; a text is looked into once for all that may touch it
    texts = rows.select(*state, "until_req", F.explode(F.array_distinct(F.concat(_marks(F.col("__said")), "__codes", F.array(F.lit("*"))))).alias("mark"))
    may = texts.join(signs, ["conv_id", "mark"]).filter("since < until_req").select(*state, "number", "name", "code", "since", "odd").distinct()
    near = rows.select(*state, "__said", "__codes").join(may, state).filter(F.contains("__said", F.col("name")) | F.array_contains("__codes", F.col("code")) | F.col("odd"))
    found = near.groupBy("conv_id", "idx", "from_req").agg(F.collect_set(F.struct((-F.length("name")).alias("order"), "number", "name", "code", "since")).alias("__near"))
    rows = rows.drop("__id", "__codes").join(found, ["conv_id", "idx", "from_req"], "left").withColumn("__near", F.array_sort(F.coalesce("__near", F.array().cast("array<struct<order:int,number:int,name:string,code:string,since:int>>"))))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.col("from_req").cast("int")), F.transform("__near", lambda e: F.greatest(e["since"], F.col("from_req")).cast("int")))))
    out = rows.withColumn("__cuts", cuts).select("*", F.posexplode("__cuts").alias("__k", "__cut"))
    pairs = F.transform(F.filter("__near", lambda e: e["since"] <= F.col("__cut")), lambda e: F.struct(e["name"].alias("name"), e["code"].alias("code")))
    until = F.coalesce(F.get("__cuts", F.col("__k") + 1), F.col("until_req"))
    return out.withColumns({"pairs": pairs, "until_req": until, "from_req": F.col("__cut")}).drop("__said", "__near", "__cuts", "__k", "__cut")


def by_version(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Intervals (conv_id, from_req, until_req) cut where the generation changes, with ``version``."""
    order = Window.partitionBy("conv_id").orderBy("req_no")
    changes = asked.select("conv_id", "req_no", "version", F.lag("version").over(order).alias("before")).filter("before is null or before != version")
    spans_ = changes.select("conv_id", "version", F.col("req_no").alias("v_from"), F.coalesce(F.lead("req_no").over(order), F.lit(2**31 - 1)).alias("v_until"))
    cut = rows.join(spans_, "conv_id").filter("from_req < v_until and v_from < until_req")
    return cut.withColumns({"from_req": F.greatest("from_req", "v_from"), "until_req": F.least("until_req", "v_until")}).drop("v_from", "v_until")


def absorbed(rows: DataFrame, said: DataFrame, settings: Settings) -> DataFrame:
    """The digests of a conversation: conv_id, idx (the last line's number), from_req, until_req, last_req, digest, scope, profile. ``said``: key, pos, line of each absorbed text."""
    conv = Window.partitionBy("conv_id")
    first = rows.filter("old_from is not null").filter(old_route() == "digest").groupBy("conv_id", "key").agg(F.min(F.struct("idx", "role", "old_from")).alias("m"), F.first("last_req").alias("last_req"), F.first("scope").alias("scope"), F.first("profile").alias("profile"))
    turns = first.withColumn("ordinal", F.row_number().over(conv.orderBy("m.idx"))).select("conv_id", "key", "ordinal", F.col("m.role").alias("role"), F.col("m.old_from").alias("appears"), "last_req", "scope", "profile")
    parts = turns.join(said, "key")
    again = F.row_number().over(Window.partitionBy("conv_id", "line").orderBy("ordinal", "pos"))
    parts = parts.withColumn("again", again).filter("again = 1")
    label = F.concat(F.substring("role", 1, 1), F.col("ordinal").cast("string"), F.lit(": "), F.col("line"))
    order = conv.orderBy("ordinal", "pos")
    window = min(settings.window, fixed.DIGEST_KEPT)
    numbered = parts.withColumns({"number": F.row_number().over(order), "shown": F.collect_list(label).over(order.rowsBetween(1 - window, 0)), "next": F.lead("appears").over(order)})
    last = numbered.filter("next is null or next > appears")
    return last.select("conv_id", F.col("number").cast("long").alias("idx"), F.col("appears").alias("from_req"), F.coalesce("next", F.col("last_req") + 1).alias("until_req"), "last_req", "scope", "profile", F.concat(F.lit(fixed.HISTORY), F.array_join("shown", " | ")).alias("digest"))


def active_codes(mentions: DataFrame) -> DataFrame:
    """Mentions (conv_id, code, from_req, until_req, at) as stretches without gaps: conv_id, code, from_req, until_req, and first (request and place of the code's first use in the conversation)."""
    order = Window.partitionBy("conv_id", "code").orderBy("from_req", "until_req")
    rows = mentions.withColumns({"reach": F.max("until_req").over(order.rowsBetween(Window.unboundedPreceding, -1)), "first": F.min(F.struct("from_req", "at")).over(Window.partitionBy("conv_id", "code"))})
    rows = rows.withColumn("stretch", F.sum(F.when(F.col("from_req") <= F.col("reach"), 0).otherwise(1)).over(order))
    return rows.groupBy("conv_id", "code", "stretch").agg(F.min("from_req").alias("from_req"), F.max("until_req").alias("until_req"), F.first("first").alias("first")).drop("stretch")


def encoded(messages: DataFrame, asked: DataFrame, settings: Settings, known: Dictionary | None = None, provider: str = "", size: Callable[[Column], Column] = estimate, memo: Memo | None = None) -> tuple[DataFrame, DataFrame]:
    """(states, requests) of all requests (conv_id, req_no, last_idx, and if need be scope, version, profile).

    States: conv_id, idx, place, role, content, tokens, route, plain, aliased, label, from_req, until_req. Requests: as
    ``encode.encode`` gives them. ``size`` counts the tokens of a column; it may use the column ``profile``.
    """
    if settings.history_style != "digest":
        raise ValueError("intervals are for digests; folds depend on what each request sends")
    known = known if known is not None else Dictionary.seeded(messages.sparkSession, settings)
    for column, default in (("scope", "global"), ("version", 1), ("profile", "")):
        asked = asked if column in asked.columns else asked.withColumn(column, F.lit(default))
    rows = written(spans(messages, asked, settings))
    if settings.mode == "OFF":
        return unchanged(rows, asked, settings, provider, size)
    end = F.col("last_req") + 1
    until_new = F.coalesce("old_from", end)
    is_new = (F.col("content") != "") & (F.col("from_req") < until_new)

    # per distinct text: what depends on nothing else; a text that is never new, or never old, is spared the other part
    flags = rows.groupBy("key", "profile").agg(F.first("content").alias("content"), F.max(is_new).alias("new"), F.max(F.coalesce(F.col("old_from").isNotNull() & (old_route() == "digest"), F.lit(False))).alias("old"))
    fill = memo.filled if memo is not None else lambda name, wanted, on, make: written(make(wanted))

    def skeletons(flags: DataFrame) -> DataFrame:
        texts = dealt(flags, "key", "profile").withColumns({"counted": size(F.col("content")), "whole": F.col("content"), "content": F.when(F.col("new"), F.col("content"))})
        return encode.skeletons(texts, []).select("key", "profile", "new", F.col("whole").alias("content"), "counted", F.coalesce("counted", estimate(F.col("whole"))).alias("tokens"), "skeleton", "regions", "terse", sessions.entity_names(F.col("whole")).alias("names"))

    def all_lines(texts: DataFrame) -> DataFrame:
        return encode.turn_lines(dealt(texts, "key"), ["key"]).select("key", "pos", "line")

    made = fill("texts", flags, ["key", "profile", "new"], skeletons).drop("new")
    said = fill("lines", flags.filter("old").select("key", "content").dropDuplicates(["key"]), ["key"], all_lines).filter("line != ''")

    rows = written(rows.join(made.select("key", "profile", "tokens", "counted", "names"), ["key", "profile"]))
    entities = written(learnt(rows))

    # new texts: coded by their scope's generation, then judged for each set of entities that touches them
    fresh = by_version(rows.filter(is_new).withColumn("until_req", until_new).select("conv_id", "idx", "key", "scope", "profile", "from_req", "until_req"), asked)

    def codes(texts: DataFrame) -> DataFrame:
        coded = texts.join(made, ["key", "profile"])
        return known.with_expansions(encode.bundled(known.coded(coded, "terse", "coded")), F.col("content"), F.col("terse"), F.col("coded"))

    def judgements(texts: DataFrame) -> DataFrame:
        out = encode.judged(dealt(texts.join(coded, ["key", *CONTEXT]), "key", "pairs"), F.col("expansions"), settings, size).select("key", *CONTEXT, "pairs", "plain", "aliased", "label")
        out = out.withColumns({f"{track}_size": size(F.col(track)) for track in ("plain", "aliased")}).join(made.select("key", "profile", "content", "tokens"), ["key", "profile"])
        for track in ("plain", "aliased"):  # never longer than the original
            long = F.col(f"{track}_size") >= F.col("tokens")
            out = out.withColumns({track: F.when(long, F.col("content")).otherwise(F.col(track)), f"{track}_size": F.when(long, F.col("tokens")).otherwise(F.col(f"{track}_size"))})
        return out.drop("content", "tokens")

    coded = fill("codes", fresh.select("key", *CONTEXT).distinct(), ["key", *CONTEXT], codes)
    fresh = written(touched(fresh.join(coded.select("key", *CONTEXT, "content", F.col("coded").alias("said")), ["key", *CONTEXT]), entities, F.col("said"), F.col("content")).drop("said", "content"))
    variants = fill("judgements", fresh.select("key", *CONTEXT, "pairs").distinct(), ["key", *CONTEXT, "pairs"], judgements)
    about = rows.select("conv_id", "idx", "place", "role", "content", "tokens", "last_req", "profile")
    new = fresh.join(variants, ["key", *CONTEXT, "pairs"]).drop("key", "profile", "scope", "version", "pairs").join(about, ["conv_id", "idx"]).withColumn("route", F.lit("new"))

    ref = F.concat(F.lit("[ref:"), content_hash(F.col("content")), F.lit(" tool-result; expand on request]"))
    old = rows.filter("old_from is not null").withColumns({"route": old_route(), "from_req": F.col("old_from"), "until_req": end})
    old = old.unionByName(rows.filter("content = ''").withColumns({"route": F.lit("empty"), "until_req": end}))
    sent = F.when(F.col("route") == "tool-ref", ref).when(F.col("route") != "digest", F.col("content"))
    old = old.withColumn("plain", sent).withColumn("aliased", F.col("plain"))
    old = old.withColumns({"plain_size": F.when(F.col("route") == "tool-ref", size(F.col("plain"))).when(F.col("route") == "digest", 0).otherwise(F.col("tokens")), "label": F.when(F.col("route") == "tool-ref", "fold").when(F.col("route").isin("digest", "tool-call"), F.col("route"))})
    columns = ["conv_id", "idx", "place", "role", "content", "tokens", "route", "plain", "aliased", "label", "from_req", "until_req", "plain_size", "aliased_size"]
    states = written(new.select(columns).unionByName(old.withColumn("aliased_size", F.col("plain_size")).select(columns)))

    # sums of requests: running sums over what begins and ends
    steps = rows.select("conv_id", F.col("from_req").alias("req_no"), F.col("tokens").alias("original"), F.lit(0).cast("long").alias("plain"), F.lit(0).cast("long").alias("alias"))
    for at, sign in (("from_req", 1), ("until_req", -1)):
        steps = steps.union(states.select("conv_id", at, F.lit(0).cast("long"), sign * F.col("plain_size"), sign * F.col("aliased_size")))
    steps = steps.groupBy("conv_id", "req_no").agg(*[F.sum(c).alias(c) for c in ("original", "plain", "alias")])
    upto = Window.partitionBy("conv_id").orderBy("req_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = asked.select("conv_id", "req_no", *CONTEXT).join(steps, ["conv_id", "req_no"], "left")
    sums = sums.select("conv_id", "req_no", *CONTEXT, *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_tokens") for c in ("original", "plain", "alias")])

    # digests: coded like fresh texts, names as whole words
    digests = by_version(absorbed(rows, said, settings), asked)
    plain_digests = digests.select(F.col("digest").alias("terse"), *CONTEXT).distinct()
    plain_digests = dealt(plain_digests, "terse")
    coded_digests = known.coded(plain_digests, "terse", "coded").select(F.col("terse").alias("digest"), *CONTEXT, dictionary.bundle(F.col("coded")).alias("digest_coded"))
    digests = touched(digests.join(coded_digests, ["digest", *CONTEXT]), entities, F.col("digest_coded"), F.lit(""))
    digests = written(digests.withColumn("digest_alias", dictionary.alias_entities(F.col("digest_coded"), F.col("pairs"), True)).select("conv_id", "from_req", "until_req", "digest", "digest_alias"))

    # codes: stretches over requests, in the order of their first use
    at = lambda kind, idx, pos: F.struct(F.lit(kind).alias("kind"), idx.cast("long").alias("idx"), pos.cast("int").alias("pos")).alias("at")
    mentions = states.select("conv_id", "from_req", "until_req", "idx", F.posexplode(dictionary.codes(text("aliased"))).alias("pos", "code")).select("conv_id", "code", "from_req", "until_req", at(0, F.col("idx"), F.col("pos")))
    mentions = mentions.union(digests.select("conv_id", "from_req", "until_req", F.posexplode(dictionary.codes(text("digest_alias"))).alias("pos", "code")).select("conv_id", "code", "from_req", "until_req", at(1, F.lit(0), F.col("pos"))))
    bundles = mentions.filter(F.col("code") == fixed.BUNDLE).join(asked.select("conv_id", "scope", "version").distinct(), "conv_id")
    bundles = known.defined(bundles).select("conv_id", "from_req", "until_req").distinct()
    members = bundles.select("conv_id", F.posexplode(F.array(*map(F.lit, fixed.BUNDLE_MEMBERS))).alias("pos", "code"), "from_req", "until_req")
    ours = mentions.join(entities.select("conv_id", "code", "since"), ["conv_id", "code"])
    named = ours.filter("since < until_req").select("conv_id", F.explode(F.sequence(F.greatest("from_req", "since"), F.col("until_req") - 1)).alias("req_no")).distinct().withColumn("named", F.lit(True))
    stretches = active_codes(mentions.union(members.select("conv_id", "code", "from_req", "until_req", at(2, F.lit(0), F.col("pos")))))
    used = stretches.select("conv_id", "code", "first", F.explode(F.sequence("from_req", F.col("until_req") - 1)).alias("req_no"))
    used = known.defined(used.join(asked.select("conv_id", "req_no", "scope", "version"), ["conv_id", "req_no"]))
    used = used.groupBy("conv_id", "req_no").agg(F.array_sort(F.collect_list(F.struct("first", "code", "line"))).alias("x")).select("conv_id", "req_no", F.col("x.code").alias("used"), F.col("x.line").alias("definitions"))
    names = entities.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("number", "since", F.concat_ws("=", "code", "name").alias("line")))).alias("entities"))

    req = sums.join(used, ["conv_id", "req_no"], "left").join(named, ["conv_id", "req_no"], "left").join(names, "conv_id", "left")
    req = over(req, digests)
    head, _, tail = fixed.BOOTSTRAP.partition("{version}")
    defined = F.when(F.size("definitions") > 0, F.concat(F.lit(head), F.col("version").cast("string"), F.lit(tail), F.array_join("definitions", "; "))) if settings.inject_bootstrap else F.lit(None).cast("string")
    lines = F.transform(F.filter("entities", lambda e: e["since"] <= F.col("req_no")), lambda e: e["line"])
    req = req.withColumn("used", F.coalesce("used", F.array().cast("array<string>"))).withColumn("block", F.concat_ws("\n", defined, F.when(F.col("named"), F.concat(F.lit("ENT: "), F.array_join(lines, "; "))))).drop("entities", "named", "definitions")
    return states.drop("plain_size", "aliased_size"), failed(encode.priced(req, settings, provider, size), rows)


def unchanged(rows: DataFrame, asked: DataFrame, settings: Settings, provider: str, size: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """States and requests in mode OFF: messages are counted and go out as they came, no text is rewritten."""
    content = F.col("content")
    rows = rows.withColumn("counted", size(content)).withColumn("tokens", F.coalesce("counted", estimate(content)))
    route = F.when(content == "", "empty").otherwise("new")
    states = rows.select("conv_id", "idx", "place", "role", "content", "tokens", route.alias("route"), content.alias("plain"), content.alias("aliased"), F.when(content != "", "original").alias("label"), "from_req", (F.col("last_req") + 1).alias("until_req"))
    upto = Window.partitionBy("conv_id").orderBy("req_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = asked.select("conv_id", "req_no", *CONTEXT).join(rows.groupBy("conv_id", F.col("from_req").alias("req_no")).agg(F.sum("tokens").alias("n")), ["conv_id", "req_no"], "left")
    req = sums.withColumn("original_tokens", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    req = req.withColumns({"plain_tokens": F.col("original_tokens"), "alias_tokens": F.col("original_tokens"), "used": F.array().cast("array<string>"), "block": F.lit(""), "digest": F.lit(None).cast("string"), "digest_alias": F.lit(None).cast("string")})
    return states, failed(encode.priced(req, settings, provider, size), rows)


def failed(req: DataFrame, rows: DataFrame) -> DataFrame:
    """Requests as they are, but for those that send a message with an error (conv_id, idx, from_req, error, counted): they ship unchanged, and say why."""
    error = F.coalesce("error", F.when(F.col("counted").isNull(), "CountError"))
    # later requests send the message again, so all from the first one on fail
    first = rows.withColumn("error", error).filter("error is not null").groupBy("conv_id").agg(F.min(F.struct("from_req", "idx", "error")).alias("__failed"))
    out = req.join(first, "conv_id", "left")
    fails = F.coalesce(F.col("__failed.from_req") <= F.col("req_no"), F.lit(False))
    reason = F.concat(F.lit("error:"), F.col("__failed.error"))
    plain = {"state": F.lit("error"), "fallback": F.lit(True), "fallback_reason": reason, "encoded_tokens": F.col("original_tokens"), "head": F.lit(""), "aliases_ship": F.lit(False), "pct": F.lit(0.0)}
    plain |= {c: F.lit(0).cast("long") for c in ("dict_overhead", "eff_overhead", "saved", "saved_effective")}
    return out.withColumns({c: F.when(fails, v).otherwise(F.col(c)) for c, v in plain.items()}).drop("__failed")


def over(requests: DataFrame, digests: DataFrame) -> DataFrame:
    """Requests with the digest of the interval they lie in: the last one that began by then."""
    marks = digests.select("conv_id", F.col("from_req").alias("req_no"), F.struct("digest", "digest_alias").alias("d"))
    latest = F.last("d", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("req_no"))
    joined = requests.join(marks, ["conv_id", "req_no"], "left").withColumn("d", latest)  # a digest begins with a request
    return joined.withColumns({"digest": F.col("d.digest"), "digest_alias": F.col("d.digest_alias")}).drop("d")


def at_requests(states: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of some requests (conv_id, req_no), as ``encode.composed`` and ``encode.reports`` take them; as many as what these send."""
    wanted = asked.select("conv_id", "req_no")
    return wanted.join(states, "conv_id").filter("from_req <= req_no and req_no < until_req").drop("from_req", "until_req")

"""Encoding of requests: candidates per message, a digest of old turns, one decision per request.

Input messages: conv_id, req_no, idx, role, content, has_tool_calls. Everything
that a session remembers is a function of the ordered prefix, so windows and
aggregates keyed by (conv_id, req_no) replay it without iteration. Expansions
that a reply asked for, and generations that were minted meanwhile, are inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.config import Settings
from palimpsest.functions.strings import content_hash, lines, strip, text
from palimpsest.functions.tokens import estimate
from palimpsest.operators import dictionary, folding, phrases, regions, sessions, verifier

REQUEST = ["conv_id", "req_no"]
NO_PAIRS = "array<struct<name:string,code:string>>"


def routed(messages: DataFrame, settings: Settings, pending: DataFrame | None = None) -> DataFrame:
    """Adds tokens, hash and route: empty, tool-call, tool-ref, tool, digest, fold, expanded or new. ``pending`` (conv_id, req_no, hash): old turns that a reply asked for, which ship verbatim."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*REQUEST))
    place = F.row_number().over(Window.partitionBy(*REQUEST).orderBy("idx")) - 1
    rows = messages.withColumns({"content": text("content"), "place": place, "n": n})
    rows = rows.withColumns({"tokens": estimate(F.col("content")), "hash": content_hash(F.col("content"))})
    old = F.lit(settings.fold_history) & (F.col("place") < F.col("n") - settings.keep) & (F.col("place") > 0) & F.col("role").isin("user", "assistant", "tool")
    route = (
        F.when(F.col("content") == "", "empty").when(~old, "new").when(F.coalesce("has_tool_calls", F.lit(False)), "tool-call")
        .when(F.col("role") == "tool", F.when(F.length("content") > fixed.LEAST_TOOL_RESULT, "tool-ref").otherwise("tool"))
        .otherwise("digest" if settings.history_style == "digest" else "fold")
    )
    rows = rows.withColumn("route", route)
    if pending is None:
        return rows
    asked = rows.join(pending.select(*REQUEST, "hash", F.lit(True).alias("pending")), [*REQUEST, "hash"], "left")
    return asked.withColumn("route", F.when(F.col("pending") & ~F.col("route").isin("new", "empty"), "expanded").otherwise(F.col("route"))).drop("pending")


def digest_lines(rows: DataFrame) -> DataFrame:
    """Lines of absorbed turns: conv_id, req_no, hash, ordinal, pos, line. A content is absorbed once, a line is kept once, the newest 200 stay."""
    first = rows.filter("route = 'digest'").groupBy(*REQUEST, "hash").agg(F.min(F.struct("idx", "role", "content")).alias("m"))
    ordinal = F.row_number().over(Window.partitionBy(*REQUEST).orderBy("m.idx"))
    turns = first.select(*REQUEST, "hash", ordinal.alias("ordinal"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))
    parts = turn_lines(turns, [*REQUEST, "hash", "ordinal", "role"])
    again = F.row_number().over(Window.partitionBy(*REQUEST, "line").orderBy("ordinal", "pos"))
    newest = F.row_number().over(Window.partitionBy(*REQUEST).orderBy(F.desc("ordinal"), F.desc("pos")))
    # in one condition with the rank: alone, the line would be pushed below all steps that make it, and each step's text written out in full
    kept = parts.withColumn("again", again).filter(F.when(F.col("line") != "", F.col("again")) == 1).withColumn("newest", newest).filter(F.col("newest") <= fixed.DIGEST_KEPT)
    label = F.concat(F.substring("role", 1, 1), F.col("ordinal").cast("string"), F.lit(": "), F.col("line"))
    return kept.select(*REQUEST, "hash", "ordinal", "pos", "newest", label.alias("line"))


def turn_lines(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, line: what is said of a turn (``content``), a line each. It depends on nothing but its text; lines may be empty."""
    folded = folding.with_folded_turn(turns, "content", "folded", 2)
    parts = folded.select(*keys, F.posexplode(lines(F.col("folded"))).alias("pos", "raw")).withColumn("raw", strip(F.col("raw")))
    parts = regions.extract(parts.filter((F.col("raw") != "") & ~F.startswith(F.col("raw"), F.lit("[+"))), "raw")
    parts = parts.withColumn("skeleton", phrases.compress("skeleton")).withColumn("restored", regions.restore(F.col("skeleton"), F.col("regions")))
    return parts.withColumn("full", strip(F.coalesce("restored", "raw"))).withColumn("line", folding.at_word(F.col("full")))


def digests(kept: DataFrame, settings: Settings) -> DataFrame:
    """Per request: the digest text of its newest lines."""
    shown = kept.filter(F.col("newest") <= settings.window)
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "pos", "line")))
    return shown.groupBy(*REQUEST).agg(F.concat(F.lit(fixed.HISTORY), F.array_join(ordered["line"], " | ")).alias("digest"))


def skeletons(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds skeleton, regions, terse (the compressed skeleton) and coded (with codes for known phrases), all functions of ``content`` and the rules."""
    out = regions.extract(rows, "content")
    out = out.withColumn("terse", phrases.compress("skeleton"))
    return bundled(out.withColumn("coded", dictionary.substitute("terse", rules)))


def bundled(rows: DataFrame) -> DataFrame:
    """Runs of the bundle's members become its code where something was coded at all."""
    return rows.withColumn("coded", F.when(F.col("coded") != F.col("terse"), dictionary.bundle(F.col("coded"))).otherwise(F.col("coded")))


def candidates(rows: DataFrame, rules: list[tuple[str, str]], expansions: Column, settings: Settings) -> DataFrame:
    """New messages (with pairs) and their best texts on both tracks: plain, aliased, label, confidence, terse."""
    return judged(skeletons(rows, rules), expansions, settings)


def judged(rows: DataFrame, expansions: Column, settings: Settings, size: Callable[[Column], Column] = estimate) -> DataFrame:
    """Rows of ``skeletons`` with tokens and pairs: each track's text, if it verifies and is worth it. ``size`` counts tokens."""
    out = rows.withColumn("coded", dictionary.alias_entities(F.col("coded"), F.col("pairs"), False))
    whole = F.map_concat(F.map_from_entries(F.transform(F.filter("pairs", lambda p: ~F.map_contains_key(expansions, p["code"])), lambda p: F.struct(p["code"], p["name"]))), expansions)
    out = out.withColumn("expansions", whole)
    for name, skeleton in (("terse", "terse"), ("alias", "coded")):
        out = out.withColumn(f"{name}_text", regions.restore(F.col(skeleton), F.col("regions")))
        out = out.withColumn(f"{name}_tokens", size(F.col(f"{name}_text")))
        saved = F.col("tokens") - F.col(f"{name}_tokens")
        worth = (saved >= settings.min_savings_abs) | (saved / F.greatest(F.lit(1), F.col("tokens")) * 100 >= settings.min_savings_pct)
        # only what would ship is decoded and verified, and a text without codes once
        asked = worth & (F.col(f"{name}_tokens") < F.col("tokens")) & (F.lit(True) if name == "terse" else F.col("coded") != F.col("terse"))
        out = out.withColumn(f"{name}_decoded", F.when(asked, dictionary.expand(F.col(f"{name}_text"), F.col("expansions"))))
    out = out.withColumn("held", F.when(F.col("terse_decoded").isNotNull() | F.col("alias_decoded").isNotNull(), verifier.invariants(F.col("content"))))
    for name in ("terse", "alias"):
        decoded = F.col(f"{name}_decoded")
        out = out.withColumn(f"{name}_verdict", F.when(decoded.isNotNull(), verifier.verify(F.col("content"), decoded, F.col("held"))))
        out = out.withColumn(f"{name}_ok", F.coalesce(F.col(f"{name}_verdict.ok") & (F.col(f"{name}_verdict.confidence") >= settings.min_confidence), F.lit(False)))
    alias_wins = F.col("alias_ok") & (F.col("coded") != F.col("terse")) & (~F.col("terse_ok") | (F.col("alias_tokens") < F.col("terse_tokens")))
    return out.withColumns({
        "plain": F.when(F.col("terse_ok"), F.col("terse_text")).otherwise(F.col("content")),
        "aliased": F.when(alias_wins, F.col("alias_text")).when(F.col("terse_ok"), F.col("terse_text")).otherwise(F.col("content")),
        "label": F.when(alias_wins, "terse+alias").when(F.col("terse_ok"), "terse").otherwise("original"),
    })


def encode(messages: DataFrame, settings: Settings, rules: list[tuple[str, str]] | None = None, expansions: Column | None = None, definitions: Column | None = None, provider: str = "", version: int = 1, pending: DataFrame | None = None, summaries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(message rows, request rows). Rules, expansions and definitions default to the seed dictionary's, or to nothing where the settings leave that out. ``summaries``: see ``folding.with_summaries``."""
    seeded = settings.seed_dictionary
    rules = (dictionary.seed_rules() if seeded else []) if rules is None else rules
    nothing = F.create_map().cast("map<string,string>")
    expansions = (dictionary.seed_expansions() if seeded else nothing) if expansions is None else expansions
    definitions = (dictionary.seed_definitions() if seeded else nothing) if definitions is None else definitions
    asked = messages.select(*REQUEST).distinct()
    known = sessions.entity_pairs(sessions.entities(sessions.sightings(messages)), asked)
    rows = routed(messages, settings, pending).join(known, REQUEST, "left").withColumn("pairs", F.coalesce("pairs", F.array().cast(NO_PAIRS)))

    new = candidates(rows.filter("route = 'new'"), rules, expansions, settings)
    old = rows.filter("route != 'new'")
    if settings.history_style == "folds":
        old = folding.with_summaries(old, summaries) if summaries is not None else old.withColumn("summary", F.lit(None).cast("string"))
        old = folding.with_folded_turn(folding.with_notes(old), "content", "folded", 3 if settings.mode == "MAX" else 6, F.col("seen"))
        repeat = folding.blob_reference(F.col("content"), F.col("note.kind"), F.col("note.req_no"))
        old = old.withColumn("folded", F.when(repeat != F.col("content"), repeat).otherwise(F.coalesce("summary", "folded")))
    else:
        old = old.withColumn("folded", F.col("content"))
    ref = F.concat(F.lit("[ref:"), F.col("hash"), F.lit(" tool-result; expand on request]"))
    plain = F.when(F.col("route") == "digest", F.lit(None).cast("string")).when(F.col("route") == "tool-ref", ref).when(F.col("route") == "fold", F.col("folded")).otherwise(F.col("content"))
    old = old.withColumn("plain", plain)
    old = old.withColumn("aliased", F.when((F.col("route") == "fold") & ~F.startswith(F.col("plain"), F.lit("[ref:")), dictionary.alias_pass("plain", rules, F.col("pairs"))).otherwise(F.col("plain")))
    old = old.withColumn("label", F.when(F.col("route") == "tool-ref", "fold").when(F.col("route").isin("digest", "tool-call", "expanded"), F.col("route")))
    columns = [*REQUEST, "idx", "place", "role", "content", "tokens", "hash", "route", "pairs", "entity_codes", "entity_block", "plain", "aliased", "label"]
    both = new.select(columns).unionByName(old.select(columns))
    for track in ("plain", "aliased"):  # never longer than the original
        shorter = F.when(F.col("route").isin("new", "fold") & (estimate(F.col(track)) >= F.col("tokens")), F.col("content")).otherwise(F.col(track))
        both = both.withColumn(track, shorter)

    digest = digests(digest_lines(rows), settings)
    sums = both.groupBy(*REQUEST).agg(
        F.sum("tokens").alias("original_tokens"), F.sum(estimate(F.col("plain"))).alias("plain_tokens"), F.sum(estimate(F.col("aliased"))).alias("alias_tokens"),
        F.array_sort(F.collect_list(F.struct("idx", dictionary.codes(text("aliased")).alias("codes")))).alias("mentions"),
        F.first("pairs").alias("pairs"), F.first("entity_codes").alias("entity_codes"), F.first("entity_block").alias("entity_block"),
    )
    req = sums.join(digest, REQUEST, "left").withColumn("digest_alias", dictionary.alias_pass("digest", rules, F.col("pairs")))
    return both, decided(req, settings, definitions, provider, version)


def decided(req: DataFrame, settings: Settings, definitions: Column, provider: str, version: int) -> DataFrame:
    """Per request: which set ships, its block, digest and report."""
    mentioned = F.concat(F.flatten("mentions.codes"), dictionary.codes(text("digest_alias")))
    used = F.filter(F.array_distinct(mentioned), lambda c: F.map_contains_key(definitions, c))
    members = F.when(F.array_contains(used, fixed.BUNDLE), F.array(*map(F.lit, fixed.BUNDLE_MEMBERS))).otherwise(F.array().cast("array<string>"))
    req = req.withColumn("mentioned", mentioned).withColumn("used", F.array_distinct(F.concat(used, members)))
    # a code keeps the place of its first use in the conversation
    uses = req.select(*REQUEST, F.posexplode("used").alias("pos", "code"))
    first = uses.groupBy("conv_id", "code").agg(F.min(F.struct("req_no", "pos")).alias("first"))
    placed = uses.join(first, ["conv_id", "code"]).groupBy(*REQUEST).agg(F.array_sort(F.collect_list(F.struct("first", "code")))["code"].alias("in_order"))
    req = req.join(placed, REQUEST, "left").withColumn("used", F.coalesce("in_order", "used")).drop("in_order")
    defined = dictionary.bootstrap_for(F.col("used"), definitions, F.lit(version)) if settings.inject_bootstrap else F.lit("")
    ent = F.when(F.arrays_overlap(F.coalesce("entity_codes", F.array().cast("array<string>")), F.col("mentioned")), F.col("entity_block"))
    return priced(req.withColumn("block", F.concat_ws("\n", F.when(defined != "", defined), ent)), settings, provider)


def priced(req: DataFrame, settings: Settings, provider: str, size: Callable[[Column], Column] = estimate) -> DataFrame:
    """Requests with their block, digest (and its coded form) and the tokens of both tracks: which set ships, and the report."""
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("req_no"))
    previous = F.lag("block").over(Window.partitionBy("conv_id").orderBy("req_no"))
    req = req.withColumns({"turn": turn, "overhead": size(F.col("block")), "previous": previous})
    cached = (F.col("block") != "") & F.lit(provider != "ollama") & ((F.col("turn") >= 2) | F.coalesce(F.col("block") == F.col("previous"), F.lit(False)))
    req = req.withColumn("effective", effective_overhead(F.col("overhead"), cached, settings.cache_discount))
    req = req.withColumns({
        "total_alias": F.coalesce("alias_tokens", F.lit(0)) + size(text("digest_alias")), "total_plain": F.coalesce("plain_tokens", F.lit(0)) + size(text("digest")),
    })
    req = req.withColumn("aliases_ship", F.col("total_plain") > F.col("total_alias") + F.col("effective"))
    ships = F.col("aliases_ship")
    req = req.withColumns({
        "encoded_tokens": F.when(ships, F.col("total_alias")).otherwise(F.col("total_plain")), "dict_overhead": F.when(ships, F.col("overhead")).otherwise(0),
        "eff_overhead": F.when(ships, F.col("effective")).otherwise(0),
    })
    cost = F.col("encoded_tokens") + F.col("eff_overhead")
    small = F.col("original_tokens") < settings.min_encode_tokens
    off = F.lit(settings.mode == "OFF")
    req = req.withColumn("state", F.when(off, "off").when(small, "small").when((cost >= F.col("original_tokens")) & (F.col("original_tokens") > 0), "reverted").otherwise("encoded"))
    kept = F.col("state") == "encoded"
    req = req.withColumn("fallback", (F.col("state") == "reverted") & (cost > F.col("original_tokens")))
    req = req.withColumns({
        "encoded_tokens": F.when(kept, F.col("encoded_tokens")).otherwise(F.col("original_tokens")), "dict_overhead": F.when(kept, F.col("dict_overhead")).otherwise(0),
        "eff_overhead": F.when(kept, F.col("eff_overhead")).otherwise(0), "fallback_reason": F.when(F.col("fallback"), "not-worth-it").otherwise(""),
    })
    alias_kept = kept & ships
    style = F.when(F.lit(settings.inject_terse_style and settings.route_mode == "human") & F.col("state").isin("encoded", "reverted"),
                   F.concat(F.lit(settings.terse_style), F.when(alias_kept & (F.col("block") != ""), fixed.TERSE_STYLE_CODES).otherwise("")))
    shown = F.when(kept, F.when(ships, F.col("digest_alias")).otherwise(F.col("digest")))
    req = req.withColumn("head", F.concat_ws("\n", F.when(alias_kept & (F.col("block") != ""), F.col("block")), style, shown))
    saved = F.col("original_tokens") - F.col("encoded_tokens")
    return req.withColumns({
        "saved": saved - F.col("dict_overhead"), "saved_effective": saved - F.col("eff_overhead"),
        "pct": F.when(F.col("original_tokens") > 0, (saved - F.col("dict_overhead")) * 100.0 / F.col("original_tokens")).otherwise(0.0),
    })


def effective_overhead(overhead: Column, cached: Column, discount: float = fixed.CACHE_DISCOUNT) -> Column:
    """Face value, or what a prefix cache leaves of it."""
    return F.when(cached, F.bround(overhead * (F.lit(1.0) - F.lit(discount))).cast("long")).otherwise(overhead)


def composed(rows: DataFrame, req: DataFrame) -> DataFrame:
    """The messages that go out: conv_id, req_no, idx, role, content. A leading system message takes the request's head; without one, the head is a message of its own at idx -1."""
    ship = rows.join(req.select(*REQUEST, "state", "aliases_ship", "head"), REQUEST)
    sent = F.when(F.col("state") != "encoded", F.col("content")).when(F.col("aliases_ship"), F.col("aliased")).otherwise(F.col("plain"))
    ship = ship.filter(~((F.col("state") == "encoded") & (F.col("route") == "digest"))).withColumn("sent", sent)
    leads = (F.col("place") == 0) & (F.col("role") == "system")
    body = ship.select(*REQUEST, "idx", "role", F.when(leads & (F.col("head") != ""), F.concat_ws("\n\n", "sent", "head")).otherwise(F.col("sent")).alias("content"))
    led = ship.filter(leads).select(*REQUEST)
    alone = F.explode(F.when(F.col("head") != "", F.array("head")).otherwise(F.array().cast("array<string>")))
    head = req.join(led, REQUEST, "left_anti").select(*REQUEST, F.lit(-1).cast("long").alias("idx"), F.lit("system").alias("role"), alone.alias("content"))
    return body.withColumn("idx", F.col("idx").cast("long")).unionByName(head)


def reports(rows: DataFrame, req: DataFrame) -> DataFrame:
    """Per message that has a label: representation, original and encoded tokens as shipped."""
    out = rows.join(req.select(*REQUEST, "state", "aliases_ship"), REQUEST).filter(F.col("route").isin("new", "digest", "tool-ref", "tool-call", "expanded"))
    label = F.when(F.col("state") != "encoded", "original").when((F.col("label") == "terse+alias") & ~F.col("aliases_ship"), "terse").otherwise(F.col("label"))
    sent = F.when(F.col("state") != "encoded", F.col("tokens")).otherwise(estimate(F.when(F.col("aliases_ship"), F.col("aliased")).otherwise(F.col("plain"))))
    return out.select(*REQUEST, "idx", label.alias("representation"), F.col("tokens").alias("original_tokens"), F.coalesce(sent, F.lit(0)).alias("encoded_tokens"))

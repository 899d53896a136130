"""Queries and SQL twins of the conversation operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed, strings, tokens
from palimpsest.functions.config import Settings
from palimpsest.operators import automaton, benchmarks, dictionary, folding, metrics, phrases, regions, replies, sessions, verifier
from palimpsest.plans import derived, encode, intervals, replay, serving
from palimpsest.plans.derived import quoted, re2, replace_sql, tokens_sql
from palimpsest.sources import chat
from palimpsest.streaming import cube
from palimpsest.streaming import replies as stream_replies
from palimpsest.streaming.decoder import shared_folder
from palimpsest.streaming.sessions import Sessions
from palimpsest.streaming.store import Store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
WITH = f"WITH {derived.prompts_sql()}"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def on_prompts(name: str, make, sql: str | None = None) -> None:
    """A query that adds columns (name -> Column of ``content``) to every prompt."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = derived.prompts(spark, sf_dir)
        return p.select("conv_id", "idx", *[c.alias(n) for n, c in make(F.col("content")).items()])

    query(name, f"{WITH} SELECT conv_id, idx, {sql} FROM prompts" if sql else None)(run)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(array) -> F.Column:
    return F.array_join(array, "|")


def joined_by_comma(array) -> F.Column:
    return F.array_join(array, ",")


# --- tokens ------------------------------------------------------------------------------------


@query("t02_token_count", f"SELECT conv_id, turn AS idx, {tokens_sql('text')} AS tokens FROM conversations")
def t02(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), tokens.estimate(F.col("text")).alias("tokens"))


@query("t05_conversation_tokens", f"SELECT conv_id, role, sum({tokens_sql('text')})::BIGINT AS tokens, count(*) AS messages FROM conversations GROUP BY ALL")
def t05(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sum(tokens.estimate(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("messages"))


MODELS = ("gpt-4o-mini", "GPT-4-turbo", "o3", "claude-sonnet", "qwen2.5:0.5b", "Meta-Llama-3", "deepseek-v3", "mixtral-8x7b", "gemma2", "unknown", "text-embedding-3")
_MODEL_SQL = "(CASE conv_id % 11 " + " ".join(f"WHEN {k} THEN {quoted(m)}" for k, m in enumerate(MODELS)) + " END)"


def model_column():
    return F.element_at(F.array(*map(F.lit, MODELS)), (F.col("conv_id") % len(MODELS) + 1).cast("int"))


@query(
    "t01_profile_route",
    "SELECT conv_id, " + _MODEL_SQL + " AS model, CASE " + " ".join(f"WHEN regexp_matches({_MODEL_SQL}, {quoted('(?i)' + p)}) THEN {quoted(n)}" for p, n, _, _ in fixed.PROFILES) + " ELSE 'o200k' END AS profile FROM (SELECT DISTINCT conv_id FROM conversations)",
)
def t01(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.select("conv_id", model_column().alias("model")).withColumn("profile", tokens.profile(F.col("model"))["name"])


_PROFILE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(model, {quoted('(?i)' + p)}) THEN {quoted(n)}" for p, n, _, _ in fixed.PROFILES) + " ELSE 'o200k' END"


@query("t07_model_count", f"WITH m AS (SELECT conv_id, turn, text, {_MODEL_SQL} AS model FROM conversations) SELECT conv_id, turn AS idx, {_PROFILE_SQL} AS profile, CASE WHEN text IS NULL THEN 0 ELSE {tokens_sql('text')} END AS tokens, false AS exact FROM m")
def t07(spark, sf_dir):
    """Without vocabulary files every profile is estimated; tests count with a local vocabulary."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), "text", model_column().alias("model"))
    return tokens.counted(rows, "text", "model").select("conv_id", "idx", "profile", "tokens", "exact")


@query("t06_profiles", "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {quoted(n)}, {quoted(kind)}, {str(exact).lower()})" for k, (_, n, kind, exact) in enumerate(fixed.PROFILES)) + f") t(rank, name, kind, exact)), m AS (SELECT {_PROFILE_SQL} AS name, count(*) AS messages FROM (SELECT {_MODEL_SQL} AS model FROM conversations) GROUP BY 1) SELECT rank, name, kind, exact, coalesce(messages, 0) AS messages FROM p LEFT JOIN m USING (name)")
def t06(spark, sf_dir):
    """All profiles, and how many messages each would count."""
    rows = table(spark, sf_dir, "conversations").select(tokens.profile(model_column())["name"].alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("messages"))
    return tokens.profiles(spark).join(rows, "name", "left").select("rank", "name", "kind", "exact", F.coalesce("messages", F.lit(0)).alias("messages"))


# --- protected regions --------------------------------------------------------------------------

#: Kinds whose patterns look around or back, which the twin's engine can't; tests hold these against goldens.
NO_TWIN = {"json_block", "xml_block", "posix_path", "regex_lit"}
for _number, (_kind, _pattern) in enumerate(fixed.REGIONS, 10):
    on_prompts(
        f"p{_number}_{_kind}",
        lambda c, p=_pattern: {"n": F.size(strings.found(c, p)).cast("long"), "regions": joined(strings.found(c, p))},
        None if _kind in NO_TWIN else f"len(regexp_extract_all(content, {quoted(re2(_pattern))})) AS n, array_to_string(regexp_extract_all(content, {quoted(re2(_pattern))}), '|') AS regions",
    )


@query("p01_skeleton")
def p01(spark, sf_dir):
    out = regions.extract(derived.prompts(spark, sf_dir), "content")
    return out.select("conv_id", "idx", "skeleton", F.size("regions").alias("n_regions"))


@query("p03_roundtrip", "SELECT doc_id, true AS same FROM documents")
def p03(spark, sf_dir):
    out = regions.extract(table(spark, sf_dir, "documents").withColumn("text", strings.text("text")), "text")
    return out.select("doc_id", (regions.restore(F.col("skeleton"), F.col("regions")) == F.col("text")).alias("same"))


# --- phrases and invariants -----------------------------------------------------------------------

_JUST = (r"(?i)\bjust\s+(go|make|do|run|check|take|try|add|use)", "$1")
DELETE_RULES = [_JUST if "(?=" in p else (f"(?i){p}", "") for p in fixed.DELETED]
REWRITE_RULES = [(f"(?i){p}", r) for p, r in fixed.REWRITTEN]
TIGHTEN_RULES = [fixed.TIGHTENED[0], (r",\s*,+", ","), (r";\s*;+", ";"), (r":\s*:+", ":"), *fixed.TIGHTENED[2:]]
TERSE_SQL = replace_sql("content", [*DELETE_RULES, *REWRITE_RULES, *TIGHTEN_RULES])
_NEG_SQL = f"list_transform(regexp_extract_all({{c}}, {quoted(re2(fixed.NEGATION))}), lambda x: replace(lower(x), '''', ''))"
_NUM_SQL = r"list_sort(regexp_extract_all({c}, '\d+(?:\.\d+)?'))"


def _case(x: str, values: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {x} END"


_WORDS = "at least|at most|no more than|no fewer than|up to|exactly"
_CMP_SQL = f"list_transform(list_transform(regexp_extract_all({{c}}, '(?i)<=|>=|<|>|\\b(?:{_WORDS})\\b\\s*\\d'), lambda x: regexp_replace(lower(x), '\\s*\\d$', '')), lambda x: {_case('x', fixed.COMPARATOR_SIGNS)})"
_MOD_SQL = r"list_transform(regexp_extract_all(regexp_replace({c}, '(?i)as always', 'as _', 'g'), '(?i)\b(?:must(?: not)?|shall(?: not)?|should(?: not)?|may(?: not)?|optional(?:ly)?|required|mandatory|always)\b'), lambda x: " + _case("lower(x)", fixed.MODALITY_CLASSES) + ")"
_CLASS_SQL = "list_transform(" + _NEG_SQL + ", lambda x: CASE WHEN x IN (" + ", ".join(map(quoted, fixed.PROHIBITIONS)) + ") THEN 'NEG' ELSE x END)"


def _joined_sql(expr: str, name: str, c: str = "content") -> str:
    return f"array_to_string({expr.replace('{c}', c)}, '|') AS {name}"


on_prompts("h01_delete", lambda c: {"out": phrases.delete(c)}, f"{replace_sql('content', DELETE_RULES)} AS out")
on_prompts("h02_rewrite", lambda c: {"out": phrases.rewrite(c)}, f"{replace_sql('content', REWRITE_RULES)} AS out")
on_prompts("h03_tighten", lambda c: {"out": phrases.tighten(c)}, f"{replace_sql('content', TIGHTEN_RULES)} AS out")
on_prompts("h04_compress", lambda c: {"out": phrases.compress(c), "tokens": tokens.estimate(phrases.compress(c))}, f"{TERSE_SQL} AS out, {tokens_sql(TERSE_SQL)} AS tokens")
on_prompts("h05_negations", lambda c: {"negations": joined(phrases.negations(c))}, _joined_sql(_NEG_SQL, "negations"))
on_prompts("v01_numbers", lambda c: {"numbers": joined(verifier.numbers(c))}, _joined_sql(_NUM_SQL, "numbers"))
on_prompts("v02_comparators", lambda c: {"comparators": joined(verifier.comparators(c))}, _joined_sql(_CMP_SQL, "comparators"))
on_prompts("v03_modality", lambda c: {"modality": joined(verifier.modality(c))}, _joined_sql(_MOD_SQL, "modality"))
on_prompts("v04_negation_classes", lambda c: {"classes": joined(verifier.negation_classes(c))}, _joined_sql(_CLASS_SQL, "classes"))


def _signature(c):
    s = verifier.signature(c)
    return {n: joined(s[n]) for n in ("negations", "numbers", "comparators", "modality")}


on_prompts("v05_signature", _signature, ", ".join(_joined_sql(e, n) for e, n in ((_NEG_SQL, "negations"), (_NUM_SQL, "numbers"), (_CMP_SQL, "comparators"), (_MOD_SQL, "modality"))))


@query(
    "v06_verify",
    f"{WITH}, pairs AS (SELECT conv_id, idx, content AS a, {TERSE_SQL} AS b FROM prompts), x AS (SELECT conv_id, idx, "
    + ", ".join(f"{e.replace('{c}', 'a')} <> {e.replace('{c}', 'b')} AS {n}" for e, n in ((_CLASS_SQL, "negation"), (_NUM_SQL, "numbers"), (_CMP_SQL, "comparators"), (_MOD_SQL, "modality")))
    + " FROM pairs), y AS (SELECT conv_id, idx, list_filter([CASE WHEN negation THEN 'negation' END, CASE WHEN numbers THEN 'numbers' END, CASE WHEN comparators THEN 'comparators' END, CASE WHEN modality THEN 'modality' END], lambda f: f IS NOT NULL) AS failures FROM x) "
    "SELECT conv_id, idx, len(failures) = 0 AS ok, greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.4::DOUBLE * len(failures)) AS confidence, array_to_string(failures, '|') AS failures FROM y",
)
def v06(spark, sf_dir):
    p = derived.prompts(spark, sf_dir).withColumn("terse", phrases.compress(F.col("content")))
    v = p.select("conv_id", "idx", verifier.verify(F.col("content"), F.col("terse")).alias("v"))
    return v.select("conv_id", "idx", "v.ok", "v.confidence", joined(F.col("v.failures")).alias("failures"))


# --- dictionary ------------------------------------------------------------------------------------

SEED_RULES = dictionary.seed_rules()
_BUNDLE_RULE = (fixed.BUNDLE_GAP.join(rf"\b{m}\b" for m in fixed.BUNDLE_MEMBERS), fixed.BUNDLE)
CODED_SQL = replace_sql(TERSE_SQL, SEED_RULES)
_LINES = {code: expansion for code, expansion, _ in fixed.SEEDS}
_LINES[fixed.BUNDLE] = f"{fixed.BUNDLE_LABEL}: " + " + ".join(_LINES[m] for m in fixed.BUNDLE_MEMBERS)
_MAP_SQL = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in _LINES.items()) + "}"


def expand_sql(c: str) -> str:
    """Pieces between codes and the codes' expansions, laid end to end."""
    code = r"\b[KPE]\d+\b"
    pieces, codes = f"string_split_regex({c}, {quoted(code)})", f"regexp_extract_all({c}, {quoted(code)})"
    return f"list_reduce(list_transform({pieces}, lambda p, i: p || coalesce({_MAP_SQL}[{codes}[i]], {codes}[i], '')), lambda a, b: a || b)"


on_prompts("a03_substitute", lambda c: {"out": dictionary.substitute(phrases.compress(c), SEED_RULES)}, f"{CODED_SQL} AS out")
on_prompts("a04_bundle", lambda c: {"out": dictionary.bundle(dictionary.substitute(phrases.compress(c), SEED_RULES))}, f"{replace_sql(CODED_SQL, [_BUNDLE_RULE])} AS out")
on_prompts("a08_find_codes", lambda c: {"codes": joined(dictionary.codes(c))}, r"array_to_string(regexp_extract_all(content, '\b[KPE]\d+\b'), '|') AS codes")
on_prompts("a09_expand", lambda c: {"out": dictionary.expand(c, dictionary.seed_expansions())}, f"{expand_sql('content')} AS out")


_PHRASES = 20
_ALIASES_SQL = rf"""raw AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g') AS text FROM conversations),
    al AS (SELECT conv_id % 2 AS scope, turn % 3 + 1 AS since, conv_id * 10000 + turn * 100 + k AS number, lower(substr(text, CAST(1 + k * 9 AS BIGINT), 14)) AS phrase FROM raw, range(0, {_PHRASES}) r(k)),
    ok AS (SELECT * FROM al WHERE regexp_full_match(phrase, '[a-z]+( [a-z]+)*') AND length(phrase) >= 12)"""
_SCOPED_SQL = f"""{WITH}, {_ALIASES_SQL},
    hit AS (SELECT p.conv_id, p.idx, list(phrase || '|K' || number ORDER BY length(phrase) DESC, number, phrase) AS forms FROM prompts p JOIN ok ON ok.scope = p.conv_id % 2 AND ok.since <= p.idx % 3 + 1 AND contains(lower(p.content), phrase) GROUP BY ALL)
    SELECT conv_id, idx, CASE WHEN forms IS NULL THEN content ELSE list_reduce(list_prepend(content, forms), lambda t, f: regexp_replace(t, '(?i)' || split_part(f, '|', 1), split_part(f, '|', 2), 'g')) END AS out FROM prompts LEFT JOIN hit USING (conv_id, idx)"""


def cut_aliases(spark, sf_dir) -> DataFrame:
    """Aliases of two scopes: phrases cut from the conversations; ``since`` is the first of three generations that knows them."""
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(strings.text("text"), r"[^\x00-\x7F]", "x").alias("text"), F.explode(F.sequence(F.lit(0), F.lit(_PHRASES - 1))).alias("k"))
    code = F.concat(F.lit("K"), (F.col("conv_id") * 10000 + F.col("turn") * 100 + F.col("k")).cast("string"))
    cut = raw.select((F.col("conv_id") % 2).cast("string").alias("scope"), code.alias("code"), F.lower(F.expr("substr(text, 1 + k * 9, 14)")).alias("expansion"), (F.col("turn") % 3 + 1).alias("since"))
    cut = cut.filter(F.col("expansion").rlike("^[a-z]+( [a-z]+)*$") & (F.length("expansion") >= 12))
    return cut.select("scope", "code", "expansion", F.array("expansion").alias("surface_forms"), F.lit(None).cast("array<string>").alias("members"), "since")


def scoped_aliases(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Those aliases and their generations, each of which knows more, written to a dictionary store and read from it."""
    cut = cut_aliases(spark, sf_dir)
    generations = cut.select("scope", "code", F.explode(F.sequence(F.col("since"), F.lit(3))).alias("version")).groupBy("scope", "version").agg(F.collect_list("code").alias("codes"))
    folder = shared_folder(spark)
    chat.write_dictionary(cut.drop("since"), generations, folder)
    return chat.read_dictionary(spark, folder)


@query("a01_established", f"WITH {_ALIASES_SQL} SELECT scope::VARCHAR AS scope, 3 AS version, count(*) AS n, md5(string_agg('K' || number, '|' ORDER BY number)) AS codes FROM ok GROUP BY scope")
def a01(spark, sf_dir):
    live = dictionary.active(dictionary.generation(scoped_aliases(spark, sf_dir)[0], 3))
    return live.select("scope", "version", F.size("codes").cast("long").alias("n"), F.md5(joined(F.col("codes")).cast("binary")).alias("codes"))


@query("a02_substitutable", f"WITH {_ALIASES_SQL} SELECT scope::VARCHAR AS scope, row_number() OVER (PARTITION BY scope ORDER BY length(phrase) DESC, number, phrase) AS rank, 'K' || number AS code, phrase AS form FROM ok")
def a02(spark, sf_dir):
    aliases = scoped_aliases(spark, sf_dir)[0]
    return dictionary.substitutable(aliases, dictionary.generation(aliases)).select("scope", F.col("rank").cast("long").alias("rank"), "code", "form")


@query("a07_expansions", f"WITH {_ALIASES_SQL} SELECT scope::VARCHAR AS scope, 'K' || number AS code, phrase AS expansion FROM ok")
def a07(spark, sf_dir):
    return dictionary.expansions(scoped_aliases(spark, sf_dir)[0]).select("scope", F.explode("expansions").alias("code", "expansion"))


@query("a16_manual", f"WITH {_ALIASES_SQL}, now AS (SELECT *, CASE WHEN number % 5 = 0 THEN 'manual ' || phrase ELSE phrase END AS e FROM ok WHERE number % 7 != 0) SELECT scope::VARCHAR AS scope, 'K' || number AS code, e AS expansion FROM now")
def a16(spark, sf_dir):
    """Aliases put in by hand replace those of their codes; others are taken out."""
    aliases = scoped_aliases(spark, sf_dir)[0]
    number = F.substring("code", 2, 20).cast("long")
    new = aliases.filter(number % 5 == 0).withColumn("expansion", F.concat(F.lit("manual "), F.col("expansion")))
    return dictionary.removed(dictionary.upserted(aliases, new), aliases.filter(number % 7 == 0).select("scope", "code")).select("scope", "code", "expansion")


def document_clauses(spark, sf_dir) -> DataFrame:
    """Clauses of compressed documents, as a nursery reads them; scope is the language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("scope"), strings.text("text").alias("text"))
    return docs.select("scope", "doc_id", F.posexplode(dictionary.clauses(F.col("text"))).alias("pos", "clause"))


_CLAUSES = r"""clauses AS (SELECT scope, doc_id, clause, pos - 1 AS pos FROM (
    SELECT scope, doc_id, unnest(cs) AS clause, generate_subscripts(cs, 1) AS pos FROM (
        SELECT coalesce(lang, 'none') AS scope, doc_id, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), '[;\x01]'),
            lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 15 AND NOT contains(x, '⟦')) AS cs FROM documents)))"""
_NURSERY = f"""{_CLAUSES}, sized AS (SELECT scope, lower(clause) AS phrase, (doc_id * 100000 + pos) AS seq, {tokens_sql("clause")} AS t FROM clauses),
    nursery AS (SELECT scope, phrase, count(*) AS count, arg_max(t, seq) AS tokens, min(seq) AS first_seen FROM sized WHERE length(phrase) >= 12 GROUP BY scope, phrase),
    promotable AS (SELECT *, (tokens - 2) * least(count * 2, 20) - (tokens + 6) AS net FROM nursery WHERE (tokens - 2) * least(count * 2, 20) - (tokens + 6) >= 20 AND count >= 2)"""


def document_nursery(spark, sf_dir) -> DataFrame:
    return dictionary.nursery(document_clauses(spark, sf_dir).withColumn("seq", F.col("doc_id") * 100000 + F.col("pos")))


@query("a10_clauses", f"WITH {_CLAUSES} SELECT scope, doc_id, pos, clause FROM clauses")
def a10(spark, sf_dir):
    return document_clauses(spark, sf_dir).select("scope", "doc_id", F.col("pos").cast("long").alias("pos"), "clause")


@query("a11_nursery", f"WITH {_NURSERY} SELECT scope, phrase, count, tokens, first_seen FROM nursery")
def a11(spark, sf_dir):
    return document_nursery(spark, sf_dir)


@query("a12_promotable", f"WITH {_NURSERY} SELECT scope, phrase, count, tokens, first_seen, net FROM promotable")
def a12(spark, sf_dir):
    return dictionary.promotable(document_nursery(spark, sf_dir))


@query(
    "a13_mint",
    f"WITH {_NURSERY}, paid AS (SELECT scope FROM promotable GROUP BY scope HAVING sum(net) > 40) SELECT scope, 'K' || (coalesce(CASE WHEN scope = 'en' THEN 15 END, 0) + row_number() OVER (PARTITION BY scope ORDER BY net DESC, first_seen, phrase)) AS code, phrase AS expansion, net FROM promotable SEMI JOIN paid USING (scope)",
)
def a13(spark, sf_dir):
    minted = dictionary.mint(document_nursery(spark, sf_dir), dictionary.seeds(spark, "en"))
    return minted.select("scope", "code", "expansion", "net")


_BOOT = "DICT v1 (shorthand; expand mentally): " + "; ".join([*(f"{c}={e}" for c, e, _ in fixed.SEEDS), f"{fixed.BUNDLE}={'+'.join(fixed.BUNDLE_MEMBERS)}"])


_BOOT_SQL = "'DICT v3 (shorthand; expand mentally): ' || string_agg('K' || number || '=' || phrase, '; ' ORDER BY number)"


@query("a14_bootstrap", f"WITH {_ALIASES_SQL}, b AS (SELECT scope, {_BOOT_SQL} AS bootstrap FROM ok GROUP BY scope) SELECT scope::VARCHAR AS scope, 3 AS version, md5(bootstrap) AS bootstrap, {tokens_sql('bootstrap')} AS tokens FROM b")
def a14(spark, sf_dir):
    g = dictionary.generation(scoped_aliases(spark, sf_dir)[0], 3)
    return g.select("scope", "version", F.md5(F.col("bootstrap").cast("binary")).alias("bootstrap"), tokens.estimate(F.col("bootstrap")).alias("tokens"))


_DEFS_SQL = "MAP {" + ", ".join(f"{quoted(c)}: {quoted(c + '=' + e)}" for c, e, _ in fixed.SEEDS) + f", 'P1': {quoted('P1=' + '+'.join(fixed.BUNDLE_MEMBERS))}" + "}"
on_prompts(
    "a15_subset_bootstrap",
    lambda c: {"block": dictionary.bootstrap_for(F.array_distinct(dictionary.codes(c)), dictionary.seed_definitions(), F.lit(1))},
    f"coalesce('DICT v1 (shorthand; expand mentally): ' || nullif(array_to_string(list_filter(list_transform(list_filter(regexp_extract_all(content, '\\b[KPE]\\d+\\b'), lambda x, i: list_position(regexp_extract_all(content, '\\b[KPE]\\d+\\b'), x) = i), lambda x: {_DEFS_SQL}[x]), lambda x: x IS NOT NULL), '; '), ''), '') AS block",
)


@query("s12_import", f"WITH {_ALIASES_SQL} SELECT scope::VARCHAR AS scope, 'K' || number AS code, CASE WHEN since = 3 THEN 'new ' ELSE '' END || phrase AS expansion FROM ok")
def s12(spark, sf_dir):
    """A pack written as JSON and read again: its codes that are known already keep their aliases."""
    cut = cut_aliases(spark, sf_dir)
    pack = cut.filter("since >= 2").drop("since").withColumn("expansion", F.concat(F.lit("new "), F.col("expansion")))
    return dictionary.imported(cut.filter("since <= 2").drop("since"), chat.pack_aliases(chat.exported(pack))).select("scope", "code", "expansion")


@query("s13_events_sink", "SELECT ts::DATE::VARCHAR AS day, count(*) AS events, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def s13(spark, sf_dir):
    """Events appended in two batches, read from the sink by day."""
    rows, path = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("micros"), "event_id").select((F.col("micros") / 1e6).alias("ts"), "event_id"), f"{shared_folder(spark)}/events"
    for part in (rows.filter("event_id % 3 = 0"), rows.filter("event_id % 3 != 0")):
        chat.append_events(part, path)
    return spark.read.schema("ts double, event_id long, day date").parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids"))


@query("r09_supplement", f"""{WITH}, h AS (SELECT conv_id, substr(sha256(content), 1, 16) AS hash, min(idx) AS first, any_value(content) AS content FROM prompts GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS n FROM h)
    SELECT conv_id, string_agg('[' || hash || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY n) AS supplement FROM r WHERE n <= 3 GROUP BY conv_id""".replace("GROUP BY ALL)", "GROUP BY conv_id, 2)"))
def r09(spark, sf_dir):
    """A reply asks for every message of its conversation; the retry brings the first three."""
    p = derived.prompts(spark, sf_dir).withColumn("hash", strings.content_hash(F.col("content")))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "hash")))
    said = p.groupBy("conv_id").agg(F.concat(F.lit("I would need more.\nPlease expand "), F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("[ref: "), x["hash"], F.lit("]"))), " and ")).alias("reply")).withColumn("seq", F.lit(1))
    originals = p.select("conv_id", "hash", F.col("content").alias("text")).dropDuplicates(["conv_id", "hash"])
    return replies.supplement(replies.expansion_requests(said, originals)).select("conv_id", "supplement")


# --- sessions -----------------------------------------------------------------------------------------


@query("e01_content_hash", "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS hash FROM documents")
def e01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.content_hash(strings.text("text")).alias("hash"))


@query("e02_session_id", f"{WITH} SELECT conv_id, substr(sha256(substr(coalesce(arg_min(content, idx) FILTER (role = 'system'), ''), 1, 400) || substr(coalesce(arg_min(content, idx) FILTER (role = 'user'), ''), 1, 400)), 1, 16) AS session FROM prompts GROUP BY conv_id")
def e02(spark, sf_dir):
    return sessions.session_ids(derived.prompts(spark, sf_dir))


_STOPS = "(?:(?:" + "|".join(fixed.ENTITY_STOPS) + r")\s+)+"
_NAMES = rf"""names AS (SELECT conv_id, idx, name, pos FROM (SELECT conv_id, idx, unnest(ns) AS name, generate_subscripts(ns, 1) - 1 AS pos FROM (SELECT conv_id, idx,
    list_filter(list_transform(regexp_extract_all(content, '\b[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+){{1,3}}\b'), lambda n: regexp_replace(regexp_replace(n, '\s+', ' ', 'g'), '^{_STOPS}', '')), lambda n: contains(n, ' ') AND length(n) >= 8) AS ns
    FROM prompts WHERE role IN ('user', 'system'))))"""


@query("e03_entities", f"{WITH}, {_NAMES} SELECT conv_id, idx, pos, name FROM names")
def e03(spark, sf_dir):
    p = derived.prompts(spark, sf_dir).withColumn("req_no", F.lit(1))
    return sessions.sightings(p).select("conv_id", "idx", F.col("pos").cast("long").alias("pos"), "name")


@query(
    "e04_entity_codes",
    f"{WITH}, {_NAMES}, nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id, name ORDER BY idx, pos) AS n FROM names) SELECT conv_id, 'E' || row_number() OVER (PARTITION BY conv_id ORDER BY idx, pos) AS code, name FROM nth WHERE n = 2",
)
def e04(spark, sf_dir):
    p = derived.prompts(spark, sf_dir).withColumn("req_no", F.lit(1))
    return sessions.entities(sessions.sightings(p)).select("conv_id", "code", "name")


@query("e07_repeat_blobs", "SELECT conv_id, idx, hash, row_number() OVER (PARTITION BY conv_id, hash ORDER BY idx) > 1 AS seen, min(idx) OVER (PARTITION BY conv_id, hash) AS first_idx FROM (SELECT lang AS conv_id, doc_id AS idx, substr(sha256(coalesce(text, '')), 1, 16) AS hash FROM documents)")
def e07(spark, sf_dir):
    blobs = table(spark, sf_dir, "documents").select(F.col("lang").alias("conv_id"), F.col("doc_id").alias("idx"), F.col("text").alias("content"))
    return sessions.repeated(blobs).select("conv_id", "idx", "hash", "seen", "first_idx")


@query("e09_used_codes", rf"{WITH}, m AS (SELECT conv_id, idx, unnest(cs) AS code, generate_subscripts(cs, 1) AS pos FROM (SELECT conv_id, idx, regexp_extract_all(content, '\b[KPE]\d+\b') AS cs FROM prompts)), f AS (SELECT conv_id, code, min((idx, pos)) AS first FROM m GROUP BY ALL) SELECT conv_id, string_agg(code, '|' ORDER BY first, code) AS codes FROM f GROUP BY conv_id")
def e09(spark, sf_dir):
    m = derived.prompts(spark, sf_dir).select("conv_id", F.col("idx").alias("req_no"), F.posexplode(dictionary.codes(F.col("content"))).alias("pos", "code"))
    return sessions.used_codes(m).select("conv_id", joined(F.col("codes")).alias("codes"))


# --- folding --------------------------------------------------------------------------------------------

_KEY_SQL = rf"""lined AS (SELECT conv_id, idx, content, list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: regexp_matches(x, '\S')) AS plain FROM prompts),
    united AS (SELECT conv_id, idx, CASE WHEN len(plain) <= {{k}} AND length(content) > 200 THEN list_filter(flatten(list_transform(plain, lambda x: list_transform(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')))), lambda y: y <> '') ELSE plain END AS units FROM lined),
    one AS (SELECT conv_id, idx, len(units) AS n, unnest(units) AS line, generate_subscripts(units, 1) AS i FROM united),
    scored AS (SELECT *, (CASE WHEN i = 1 OR i = n THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(line, {quoted(re2(fixed.KEY_LINE))}) THEN 3 ELSE 0 END) + (CASE WHEN regexp_matches(line, {quoted(re2(fixed.HEADER))}) THEN 1 ELSE 0 END) - (CASE WHEN length(line) > 200 THEN 1 ELSE 0 END) AS score FROM one),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, idx ORDER BY score DESC, i) AS r FROM scored),
    best AS (SELECT conv_id, idx, any_value(n) AS n, string_agg(CASE WHEN n > {{k}} AND length(line) > 240 THEN substr(line, 1, 237) || '...' ELSE line END, chr(10) ORDER BY i) AS out FROM ranked WHERE r <= {{k}} GROUP BY conv_id, idx)
    SELECT p.conv_id, p.idx, coalesce(out || CASE WHEN n > {{k}} THEN chr(10) || '[+' || (n - {{k}}) || ' lines folded]' ELSE '' END, '') AS out FROM prompts p LEFT JOIN best b ON p.conv_id = b.conv_id AND p.idx = b.idx"""
for _k in (2, 3, 6):
    query(f"f03_key_lines_{_k}", f"{WITH}, {_KEY_SQL.replace('{k}', str(_k))}")(
        lambda spark, sf_dir, k=_k: folding.with_key_lines(derived.prompts(spark, sf_dir), "content", "out", k).select("conv_id", "idx", "out")
    )


@query("f01_fold_fences", "SELECT conv_id, turn AS idx, '[code:' || substr(sha256('```py' || chr(10) || coalesce(text, '') || chr(10) || '```'), 1, 16) || ' ' || (2 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) || 'L] and [code:' || substr(sha256('```py' || chr(10) || coalesce(text, '') || chr(10) || '```'), 1, 16) || ' ' || (2 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) || 'L seen]' AS out FROM conversations")
def f01(spark, sf_dir):
    body = F.concat(F.lit("```py\n"), strings.text("text"), F.lit("\n```"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), folding.fold_fences(F.concat(body, F.lit(" and "), body)).alias("out"))


@query("c09_fence_repeats", """WITH m AS (SELECT conv_id, turn AS idx, role, '```py' || chr(10) || coalesce(text, '') || chr(10) || '```' AS own, '```py' || chr(10) || coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || chr(10) || '```' AS prev FROM conversations),
    q AS (SELECT conv_id, idx AS last_idx, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS req_no FROM m WHERE role = 'user'),
    r AS (SELECT m.conv_id, q.req_no, m.idx, substr(sha256(own), 1, 16) AS own, substr(sha256(prev), 1, 16) AS prev FROM m JOIN q ON m.conv_id = q.conv_id AND m.idx < q.last_idx),
    f AS (SELECT conv_id, req_no, idx, prev AS hash, 1 AS pos FROM r UNION ALL SELECT conv_id, req_no, idx, own, 0 FROM r WHERE idx % 2 = 0),
    o AS (SELECT conv_id, hash, min((req_no, idx)) AS at FROM f GROUP BY ALL),
    s AS (SELECT f.conv_id, f.req_no, f.idx, string_agg(DISTINCT f.hash, '|' ORDER BY f.hash) AS seen FROM f JOIN o USING (conv_id, hash) WHERE o.at < (f.req_no, f.idx) GROUP BY ALL)
    SELECT r.conv_id, r.req_no, r.idx, coalesce(seen, '') AS seen, CASE WHEN r.idx % 2 = 1 AND o.at < (r.req_no, r.idx) THEN 'code ' || o.at[1] ELSE '' END AS note FROM r LEFT JOIN s USING (conv_id, req_no, idx) LEFT JOIN o ON o.conv_id = r.conv_id AND o.hash = r.prev""")
def c09_fences(spark, sf_dir):
    """Every message is a fence: those of even places hold their own and repeat the one before inside a text, the others are the one before, sent again as a whole."""
    fence = lambda c: F.concat(F.lit("```py\n"), strings.text(c), F.lit("\n```"))
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    content = F.when(F.col("turn") % 2 == 0, F.concat(fence("text"), F.lit(" as "), fence("before"))).otherwise(fence("before"))
    said = rows.select("conv_id", F.col("turn").alias("idx"), "role", content.alias("content"), strings.content_hash(content).alias("hash"), F.lit("fold").alias("route"), F.lit(None).cast("string").alias("summary"))
    old = replay.replayed(said, replay.requests(said)).filter("idx < last_idx")
    note = F.concat_ws(" ", "note.kind", F.col("note.req_no").cast("string"))
    return folding.with_notes(old).select("conv_id", F.col("req_no").cast("long").alias("req_no"), "idx", joined(F.col("seen")).alias("seen"), note.alias("note"))


@query("f02_dedup", "WITH h AS (SELECT doc_id, coalesce(text, '') AS t, substr(sha256(coalesce(text, '')), 1, 16) AS hash FROM documents), w AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) > 1 AS seen, min(doc_id) OVER (PARTITION BY hash) AS f FROM h) SELECT doc_id, CASE WHEN length(t) >= 400 AND seen THEN '[ref:' || hash || ' doc unchanged from turn ' || f || ']' ELSE t END AS out FROM w")
def f02(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit(0).alias("conv_id"), F.col("doc_id").alias("idx"), strings.text("text").alias("content"))
    seen = sessions.repeated(docs)
    return seen.select(F.col("idx").alias("doc_id"), folding.blob_reference(F.col("content"), F.when(F.col("seen"), "doc"), F.col("first_idx")).alias("out"))


@query("f05_summaries", f"""{WITH}, q AS (SELECT conv_id, idx AS last_idx, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS req_no FROM prompts WHERE role = 'user'),
    r AS (SELECT p.conv_id, q.req_no, p.idx FROM prompts p JOIN q ON p.conv_id = q.conv_id AND p.idx <= q.last_idx),
    s AS (SELECT conv_id, idx AS s_start, idx + 1 AS e, 1 + idx % 2 AS since, substr(content, 1, 20) AS summary FROM prompts WHERE idx % 3 = 1)
    SELECT r.conv_id, r.req_no, r.idx, (SELECT arg_min(summary, (since, s_start)) FROM s WHERE s.conv_id = r.conv_id AND r.idx BETWEEN s_start AND e AND since < r.req_no) AS summary FROM r""")
def f05(spark, sf_dir):
    p = derived.prompts(spark, sf_dir)
    sent = replay.replayed(p, replay.requests(p)).select("conv_id", "req_no", "idx")
    i = F.col("idx")
    made = p.filter(i % 3 == 1).select("conv_id", i.alias("start"), (i + 1).alias("end"), (1 + i % 2).alias("since"), F.substring("content", 1, 20).alias("summary"))
    return folding.with_summaries(sent, made).select("conv_id", F.col("req_no").cast("long").alias("req_no"), "idx", "summary")


@query("f06_compaction", f"""{WITH}, l AS (SELECT conv_id, idx, substr(content, 1, 20) AS line, substr(sha256(content), 1, 16) AS hash, row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) AS newest, count(*) OVER (PARTITION BY conv_id) AS n FROM prompts),
    due AS (SELECT conv_id, list_sort(list(DISTINCT hash)) AS hashes, count(*) AS cut FROM l WHERE newest > 1 AND n > 2 GROUP BY conv_id)
    SELECT l.conv_id, idx AS ordinal, line, hash AS hashes FROM l LEFT JOIN due ON l.conv_id = due.conv_id WHERE due.conv_id IS NULL OR newest <= 1
    UNION ALL SELECT conv_id, 0, unnest(['first of ' || cut, 'second', 'third', '4']), array_to_string(hashes, ',') FROM due""")
def f06(spark, sf_dir):
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("idx")))
    kept = derived.prompts(spark, sf_dir).select(
        "conv_id", F.lit(1).alias("req_no"), F.col("idx").alias("ordinal"), F.lit(0).alias("pos"), F.substring("content", 1, 20).alias("line"), strings.content_hash(F.col("content")).alias("hash"), back.alias("newest"),
    )
    due = folding.to_compact(kept, 1)
    answers = due.select("conv_id", "req_no", F.concat(F.lit("first of "), F.size("lines").cast("string"), F.lit("\n\n second \nthird\n4\nfifth")).alias("text"))
    return folding.compacted(kept, due, answers, 1).select("conv_id", F.col("place.ordinal").cast("long").alias("ordinal"), "line", joined_by_comma("hashes").alias("hashes"))


@query("a18_scoped_codes", _SCOPED_SQL)
def a18_scoped(spark, sf_dir):
    """Every prompt coded by the dictionary of its scope and generation: thousands of forms, found by keys."""
    known = automaton.Dictionary.scoped(*scoped_aliases(spark, sf_dir))
    rows = derived.prompts(spark, sf_dir).withColumns({"scope": (F.col("conv_id") % 2).cast("string"), "version": F.col("idx") % 3 + 1})
    return known.coded(rows, "content", "out").select("conv_id", "idx", "out")


@query("a18_scoped_replay")
def a18_replay(spark, sf_dir):
    """Every request of every conversation, encoded with the dictionary of its scope and of the generation that is current then."""
    p = derived.prompts(spark, sf_dir)
    asked = replay.requests(p).withColumns({"scope": (F.col("conv_id") % 2).cast("string"), "version": F.least(F.lit(3), F.col("req_no"))})
    _, req = intervals.encoded(p, asked, Settings(mode="BALANCED"), automaton.Dictionary.scoped(*scoped_aliases(spark, sf_dir)))
    return req.select("conv_id", "req_no", "scope", "version", "original_tokens", "encoded_tokens", "dict_overhead", "eff_overhead", "aliases_ship", joined(F.col("used")).alias("used"))


# --- requests ----------------------------------------------------------------------------------------------


def final(spark, sf_dir) -> DataFrame:
    p = derived.prompts(spark, sf_dir)
    return replay.replayed(p, replay.final_requests(p)).drop("last_idx")


_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM prompts)"


def _route_sql(keep: int) -> str:
    return f"CASE WHEN content = '' THEN 'empty' WHEN NOT (place < n - {keep} AND place > 0 AND role IN ('user', 'assistant', 'tool')) THEN 'new' WHEN role = 'tool' THEN CASE WHEN length(content) > 200 THEN 'tool-ref' ELSE 'tool' END ELSE 'digest' END"


for _mode, _keep in (("MAX", 1), ("BALANCED", 6)):
    query(f"c03_route_{_mode.lower()}", f"{WITH}, {_PLACED} SELECT conv_id, idx, {_route_sql(_keep)} AS route, {tokens_sql('content')} AS tokens FROM placed")(
        lambda spark, sf_dir, mode=_mode: encode.routed(final(spark, sf_dir), Settings(mode=mode)).select("conv_id", "idx", "route", "tokens")
    )


@query("c04_tool_refs", f"{WITH}, {_PLACED} SELECT conv_id, idx, CASE WHEN place < n - 1 AND place > 0 AND length(content) > 200 THEN '[ref:' || substr(sha256(content), 1, 16) || ' tool-result; expand on request]' ELSE content END AS out FROM placed WHERE role = 'assistant'")
def c04(spark, sf_dir):
    as_tool = final(spark, sf_dir).withColumn("asked", F.col("role")).withColumn("role", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")))
    ref = F.concat(F.lit("[ref:"), F.col("hash"), F.lit(" tool-result; expand on request]"))
    rows = encode.routed(as_tool, Settings())
    return rows.filter("asked = 'assistant'").select("conv_id", "idx", F.when(F.col("route") == "tool-ref", ref).otherwise(F.col("content")).alias("out"))


_OVERHEAD_SQL = "SELECT o_orderkey AS id, (o_orderkey % 400)::BIGINT AS overhead, o_orderkey % 3 > 0 AS cached FROM orders"


@query("c14_effective_overhead", f"SELECT id, overhead, CASE WHEN cached THEN CAST(round_even(overhead * (1.0::DOUBLE - 0.9::DOUBLE), 0) AS BIGINT) ELSE overhead END AS effective FROM ({_OVERHEAD_SQL})")
def c14(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 400).cast("long").alias("overhead"), (F.col("o_orderkey") % 3 > 0).alias("cached"))
    return rows.select("id", "overhead", encode.effective_overhead(F.col("overhead"), F.col("cached")).alias("effective"))


def _encoded(spark, sf_dir, **settings):
    """(message rows, request rows) of one request per conversation that sends everything."""
    p = derived.prompts(spark, sf_dir)
    asked = replay.final_requests(p)
    states, req = intervals.encoded(p, asked, Settings(**settings))
    return intervals.at_requests(states, asked), req


_SUMS_SQL = """s AS (SELECT o_custkey AS conv_id, o_orderkey AS req_no, o_orderkey % 300 AS original, greatest(0, o_orderkey % 300 - o_orderkey % 40) AS plain, greatest(0, o_orderkey % 300 - o_orderkey % 40 - o_custkey % 90) AS alias,
    CASE o_orderkey % 4 WHEN 0 THEN ['K14', 'K3', 'K3'] WHEN 1 THEN ['P1'] WHEN 2 THEN ['E1', 'K99'] ELSE []::VARCHAR[] END AS codes, CASE WHEN o_orderkey % 3 = 0 THEN 'HIST of run the tests' END AS digest,
    CASE WHEN o_orderkey % 3 = 0 THEN 'HIST of K5' END AS digest_alias FROM orders)"""
_DECISION_SQL = f"""WITH {_SUMS_SQL}, m AS (SELECT *, list_concat(codes, CASE WHEN digest IS NULL THEN []::VARCHAR[] ELSE ['K5'] END) AS mentioned FROM s),
    u AS (SELECT conv_id, req_no, unnest(list_concat(list_filter(list_transform(range(1, len(mentioned) + 1), lambda i: CASE WHEN list_position(mentioned, mentioned[i]) = i THEN mentioned[i] END), lambda c: c IS NOT NULL AND c NOT IN ('E1', 'K99')), CASE WHEN list_contains(mentioned, 'P1') THEN {list(fixed.BUNDLE_MEMBERS)} ELSE []::VARCHAR[] END)) AS code,
        generate_subscripts(list_concat(list_filter(list_transform(range(1, len(mentioned) + 1), lambda i: CASE WHEN list_position(mentioned, mentioned[i]) = i THEN mentioned[i] END), lambda c: c IS NOT NULL AND c NOT IN ('E1', 'K99')), CASE WHEN list_contains(mentioned, 'P1') THEN {list(fixed.BUNDLE_MEMBERS)} ELSE []::VARCHAR[] END), 1) AS pos FROM m),
    d AS (SELECT conv_id, req_no, code, min(pos) AS pos FROM u GROUP BY ALL), f AS (SELECT conv_id, code, min((req_no, pos)) AS first FROM d GROUP BY ALL),
    b AS (SELECT conv_id, req_no, string_agg({_DEFS_SQL}[code], '; ' ORDER BY first) AS defined FROM d JOIN f USING (conv_id, code) GROUP BY ALL),
    k AS (SELECT m.*, concat_ws(chr(10), 'DICT v1 (shorthand; expand mentally): ' || defined, CASE WHEN list_contains(mentioned, 'E1') THEN 'ENT: E1=Agent Manager' END) AS block FROM m LEFT JOIN b USING (conv_id, req_no)),
    o AS (SELECT *, {tokens_sql('block')} AS overhead, row_number() OVER w AS turn, lag(block) OVER w AS previous FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY req_no)),
    e AS (SELECT *, CASE WHEN block != '' AND (turn >= 2 OR coalesce(block = previous, false)) THEN CAST(round_even(overhead * (1.0::DOUBLE - 0.9::DOUBLE), 0) AS BIGINT) ELSE overhead END AS effective,
        alias + {tokens_sql("coalesce(digest_alias, '')")} AS total_alias, plain + {tokens_sql("coalesce(digest, '')")} AS total_plain FROM o),
    x AS (SELECT *, total_plain > total_alias + effective AS ships FROM e),
    c AS (SELECT *, CASE WHEN ships THEN total_alias ELSE total_plain END AS sent, CASE WHEN ships THEN overhead ELSE 0 END AS own, CASE WHEN ships THEN effective ELSE 0 END AS eff FROM x),
    t AS (SELECT *, CASE WHEN original < 24 THEN 'small' WHEN sent + eff >= original AND original > 0 THEN 'reverted' ELSE 'encoded' END AS state FROM c)
    SELECT conv_id, req_no, block, ships AS aliases_ship, state, CASE WHEN state = 'encoded' THEN sent ELSE original END::BIGINT AS encoded_tokens, CASE WHEN state = 'encoded' THEN own ELSE 0 END::BIGINT AS dict_overhead,
        CASE WHEN state = 'encoded' THEN eff ELSE 0 END::BIGINT AS eff_overhead, CASE WHEN state = 'encoded' THEN original - sent - own ELSE 0 END::BIGINT AS saved, CASE WHEN state = 'encoded' THEN original - sent - eff ELSE 0 END::BIGINT AS saved_effective,
        CASE WHEN state = 'encoded' THEN (original - sent - own) * 100.0::DOUBLE / original ELSE 0.0::DOUBLE END AS pct, CASE WHEN state = 'reverted' AND sent + eff > original THEN 'not-worth-it' ELSE '' END AS fallback_reason,
        concat_ws(chr(10), CASE WHEN state = 'encoded' AND ships AND block != '' THEN block END, CASE WHEN state != 'small' THEN {quoted(Settings.terse_style)} || CASE WHEN state = 'encoded' AND ships AND block != '' THEN {quoted(fixed.TERSE_STYLE_CODES)} ELSE '' END END,
            CASE WHEN state = 'encoded' THEN CASE WHEN ships THEN digest_alias ELSE digest END END) AS head FROM t"""


@query("c15_decision_rule", _DECISION_SQL)
def c15_rule(spark, sf_dir):
    """The decision, block, head and report of requests whose sums are given: numbers of orders."""
    i, three = F.col("o_orderkey"), F.col("o_orderkey") % 3 == 0
    strs = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    codes = F.when(i % 4 == 0, strs("K14", "K3", "K3")).when(i % 4 == 1, strs("P1")).when(i % 4 == 2, strs("E1", "K99")).otherwise(strs())
    plain = F.greatest(F.lit(0), i % 300 - i % 40)
    req = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("conv_id"), i.alias("req_no"), (i % 300).alias("original_tokens"), plain.alias("plain_tokens"), F.greatest(F.lit(0), i % 300 - i % 40 - F.col("o_custkey") % 90).alias("alias_tokens"),
        F.array(F.struct(F.lit(0).alias("idx"), codes.alias("codes"))).alias("mentions"), strs("E1").alias("entity_codes"), F.lit("ENT: E1=Agent Manager").alias("entity_block"),
        F.when(three, "HIST of run the tests").alias("digest"), F.when(three, "HIST of K5").alias("digest_alias"),
    )
    out = encode.decided(req, Settings(), dictionary.seed_definitions(), "", 1)
    whole = [F.col(c).cast("long").alias(c) for c in ("encoded_tokens", "dict_overhead", "eff_overhead", "saved", "saved_effective")]
    return out.select("conv_id", "req_no", "block", "aliases_ship", "state", *whole, "pct", "fallback_reason", "head")


@query("c07_digest_lines")
def c07(spark, sf_dir):
    rows = encode.routed(final(spark, sf_dir), Settings())
    return encode.digest_lines(rows).select("conv_id", "hash", "ordinal", "pos", "line")


@query("c08_digest_render")
def c08(spark, sf_dir):
    rows = encode.routed(final(spark, sf_dir), Settings())
    return encode.digests(encode.digest_lines(rows), Settings()).select("conv_id", "digest")


@query("c10_candidates")
def c10(spark, sf_dir):
    rows, _ = _encoded(spark, sf_dir, mode="BALANCED")
    return rows.filter("route = 'new'").select("conv_id", "idx", "label", "tokens", tokens.estimate(F.col("plain")).alias("plain_tokens"), tokens.estimate(F.col("aliased")).alias("alias_tokens"))


@query("c15_decision")
def c15(spark, sf_dir):
    _, req = _encoded(spark, sf_dir, mode="BALANCED")
    return req.select("conv_id", "total_plain", "total_alias", "effective", "aliases_ship", joined(F.col("used")).alias("used"))


@query("c16_never_larger", f"{WITH} SELECT conv_id, sum({tokens_sql('content')})::BIGINT AS original_tokens, true AS never_larger FROM prompts GROUP BY conv_id")
def c16(spark, sf_dir):
    _, req = _encoded(spark, sf_dir)
    return req.select("conv_id", "original_tokens", (F.col("encoded_tokens") + F.col("eff_overhead") <= F.col("original_tokens")).alias("never_larger"))


@query("c18_compose")
def c18(spark, sf_dir):
    return encode.composed(*_encoded(spark, sf_dir)).select("conv_id", "idx", "role", "content")


@query("c19_report")
def c19(spark, sf_dir):
    _, req = _encoded(spark, sf_dir)
    return req.select("conv_id", "original_tokens", "encoded_tokens", "dict_overhead", "eff_overhead", "saved", "saved_effective", "pct", "fallback", "fallback_reason")


@query("c19_message_reports")
def c19_messages(spark, sf_dir):
    return encode.reports(*_encoded(spark, sf_dir))


@query("c01_off", f"{WITH} SELECT conv_id, sum({tokens_sql('content')})::BIGINT AS original_tokens, sum({tokens_sql('content')})::BIGINT AS encoded_tokens, 'off' AS state FROM prompts GROUP BY conv_id")
def c01(spark, sf_dir):
    _, req = _encoded(spark, sf_dir, mode="OFF")
    return req.select("conv_id", "original_tokens", "encoded_tokens", "state")


# --- replies -------------------------------------------------------------------------------------------------


on_prompts("r01_decode", lambda c: {"out": replies.decode(c, dictionary.seed_expansions())}, f"{expand_sql('content')} AS out")
_STEP = 7


def _frames(spark, sf_dir) -> DataFrame:
    """Each prompt as a reply of short newline-delimited frames; those of odd conversations break off without a last frame."""
    p = derived.prompts(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("idx")).alias("session"), "content", (F.col("conv_id") % 2 == 0).alias("ends"))
    framed = lambda piece: F.to_json(F.struct(F.struct(piece.alias("content")).alias("message"), F.lit(False).alias("done")))
    # built before the explode: a filter on what is parsed from a frame would build it anew
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / _STEP)), lambda k: framed(F.substring("content", (k * _STEP + 1).cast("int"), F.lit(_STEP))))
    frames = p.select("session", F.posexplode(cut).alias("seq", "frame")).withColumn("seq", F.col("seq").cast("long"))
    last = p.filter("ends").select("session", F.lit(1 << 40).alias("seq"), F.lit('{"done": true}').alias("frame"))
    return frames.unionByName(last)


@query("s09_ndjson", f"{WITH} SELECT conv_id * 1000 + idx AS session, 1 + (length(content) - 1) // {_STEP} AS pieces, content, 1::BIGINT AS ends FROM prompts")
def s09(spark, sf_dir):
    deltas = chat.with_end(chat.ndjson_deltas(_frames(spark, sf_dir)))
    ordered = F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("seq", "delta"))))
    return deltas.groupBy("session").agg(F.count("delta").alias("pieces"), F.array_join(ordered["delta"], "").alias("content"), F.sum(F.col("done").cast("long")).alias("ends"))


@query("r05_decode_stream", f"{WITH} SELECT conv_id * 1000 + idx AS session, {expand_sql('content')} AS out FROM prompts")
def r05(spark, sf_dir):
    """A streaming query over stored deltas, run until all are read; its output is a table."""
    folder = shared_folder(spark)
    chat.ndjson_deltas(_frames(spark, sf_dir)).withColumn("session", F.col("session").cast("string")).write.parquet(f"{folder}/deltas")
    schema = "session string, seq long, delta string, done boolean"
    # from the table, so that frames are built and parsed once
    chat.missing_ends(spark.read.schema(schema).parquet(f"{folder}/deltas")).write.mode("append").parquet(f"{folder}/deltas")
    deltas, store, known = spark.readStream.schema(schema).parquet(f"{folder}/deltas"), Store(spark, f"{folder}/replies"), dictionary.seed_expansion_texts()
    step = lambda batch, number: stream_replies.advance(store, number, batch, known)
    deltas.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream_replies.said(store).withColumn("session", F.col("session").cast("long"))


on_prompts(
    "r02_references",
    lambda c: {"out": replies.expand_references(c, F.create_map(F.lit("0123456789abcdef"), F.lit("the original")))},
    r"regexp_replace(content, '\[(?:ref|code):0123456789abcdef[^\]]*\]', 'the original', 'g') AS out",
)
on_prompts(
    "r08_expansion_requests",
    lambda c: {"hashes": joined(replies.asked_hashes(c))},
    r"array_to_string(list_distinct(flatten(list_transform(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '(?i)\bexpand')), lambda x: regexp_extract_all(x, '(?i)(?:code|ref):\s*([0-9a-f]{16})', 1)))), '|') AS hashes",
)


@query("r10_output_accounting", f"{WITH} SELECT conv_id, idx, {tokens_sql(expand_sql('content'))} AS original_tokens, {tokens_sql('content')} AS encoded_tokens, {tokens_sql(expand_sql('content'))} - {tokens_sql('content')} AS saved FROM prompts WHERE role = 'assistant'")
def r10(spark, sf_dir):
    rows = derived.prompts(spark, sf_dir).filter("role = 'assistant'").withColumn("reply", F.col("content"))
    return replies.accounted(rows, dictionary.seed_expansions(), tokens.estimate).select("conv_id", "idx", "original_tokens", "encoded_tokens", "saved")


# --- cache and metrics --------------------------------------------------------------------------------------------


@query("g02_cache_hits", "SELECT sha256(coalesce(text, '')) AS key, count(*) AS asked, count(*) - 1 AS hits FROM documents GROUP BY 1")
def g02(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select(F.sha2(strings.text("text"), 256).alias("key"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("asked"), (F.count(F.lit(1)) - 1).alias("hits"))


_LOG_SQL = "log AS (SELECT doc_id AS seq, text, source AS session, lang AS scope, CASE WHEN doc_id % 5 = 0 THEN 'OFF' ELSE 'MAX' END AS mode, doc_id % 3 = 0 AS fallback, 'm' || doc_id % 2 AS model, 1 + doc_id % 2 AS generations FROM documents)"
_KEY_SQL = "PARTITION BY text, session, scope, model, generations"


def request_log(spark, sf_dir) -> DataFrame:
    """Documents as requests of one message each."""
    i = F.col("doc_id")
    log = table(spark, sf_dir, "documents").select(
        i.alias("seq"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"), F.col("source").alias("session"), F.col("lang").alias("scope"),
        F.when(i % 5 == 0, "OFF").otherwise("MAX").alias("mode"), (i % 3 == 0).alias("fallback"), F.concat(F.lit("m"), (i % 2).cast("string")).alias("model"), (1 + i % 2).alias("generations"),
    )
    return log.withColumn("key", serving.cache_key(F.col("messages"), F.col("model"), F.col("mode"), F.col("session"), F.col("scope"), F.col("generations"))).drop("messages")


@query("g01_cache_keys", f"WITH {_LOG_SQL} SELECT min(seq) AS first, count(*) AS asked FROM log WHERE mode != 'OFF' GROUP BY text, session, scope, model, generations")
def g01(spark, sf_dir):
    return request_log(spark, sf_dir).filter("key is not null").groupBy("key").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("asked")).drop("key")


@query("g03_cache_fill", f"WITH {_LOG_SQL} SELECT seq, coalesce(mode != 'OFF' AND seq > min(CASE WHEN NOT fallback THEN seq END) OVER ({_KEY_SQL}, mode), false) AS cached FROM log")
def g03(spark, sf_dir):
    return serving.with_hits(request_log(spark, sf_dir)).select("seq", "cached")


_EPOCHS_SQL = "t AS (SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 25 AS epoch FROM events)"


@query("a19_mint_epochs", f"WITH {_EPOCHS_SQL} SELECT event_id, event_type, epoch FROM t")
def a19(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("scope"))
    return serving.epochs(log).select(F.col("seq").alias("event_id"), F.col("scope").alias("event_type"), "epoch")


@query("a18_generation_as_of", f"WITH {_EPOCHS_SQL}, m AS (SELECT DISTINCT event_type, epoch FROM t WHERE epoch % 3 != 0) SELECT event_type, epoch, count(*) AS encodes, 1 + (SELECT count(*) FROM m WHERE m.event_type = t.event_type AND m.epoch < t.epoch) AS generation FROM t GROUP BY event_type, epoch")
def a18(spark, sf_dir):
    log = serving.epochs(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("scope")))
    minted = log.filter("epoch % 3 != 0").select("scope", "epoch")
    out = serving.with_generation(log, minted)
    return out.groupBy(F.col("scope").alias("event_type"), "epoch", "generation").agg(F.count(F.lit(1)).alias("encodes"))


@query("s10_session_store", rf"{WITH}, u AS (SELECT conv_id, 'hash' AS kind, substr(sha256(content), 1, 16) AS key, idx FROM prompts UNION ALL SELECT conv_id, 'code', unnest(regexp_extract_all(content, '\b([KPE]\d+)\b', 1)), idx FROM prompts UNION ALL SELECT conv_id, 'turn', idx::VARCHAR, idx FROM prompts) SELECT conv_id, kind, key, min(idx) AS first FROM u GROUP BY ALL")
def s10(spark, sf_dir):
    said = derived.prompts(spark, sf_dir).select(F.col("conv_id").alias("session"), F.col("idx").alias("seq"), "content")
    store = None
    for late in (said.filter("seq % 3 = 1"), said.filter("seq % 3 != 1"), said.filter("seq < 2")):  # out of order, and partly twice
        store = serving.advance(store, late)
    return store.withColumnRenamed("session", "conv_id")


@query("s10_incremental_requests", f"""{WITH}, q AS (SELECT conv_id, idx AS last_idx, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS req_no FROM prompts WHERE role = 'user')
    SELECT q.conv_id, q.req_no, q.last_idx, sum({tokens_sql('content')})::BIGINT AS original_tokens, true AS never_larger FROM q JOIN prompts p ON p.conv_id = q.conv_id AND p.idx <= q.last_idx GROUP BY ALL""")
def s10_requests(spark, sf_dir):
    """Every request of every conversation, encoded as its messages come: in two batches, the second of which is late for much of the first and repeats some of it."""
    p = derived.prompts(spark, sf_dir)
    kept = Sessions(Store(spark, shared_folder(spark)), Settings())
    kept.advance(p.filter("idx % 3 != 1"), 0)
    kept.advance(p.filter("idx % 3 = 1 or idx < 2"), 1)
    return kept.answers().select("conv_id", F.col("req_no").cast("long").alias("req_no"), "last_idx", "original_tokens", (F.col("encoded_tokens") <= F.col("original_tokens")).alias("never_larger"))


@query("c20_fail_soft", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'error:MalformedBody' ELSE '' END AS fallback_reason, CASE WHEN turn % 3 = 0 THEN 'no json ' || coalesce(text, '') END AS content FROM conversations")
def c20(spark, sf_dir):
    good = F.to_json(F.struct(F.lit("m").alias("model"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    raw = table(spark, sf_dir, "conversations").withColumn("body", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("no json "), strings.text("text"))).otherwise(good))
    return serving.failed(chat.bodies(raw)).select("conv_id", "turn", "fallback_reason", "content")


@query("c20_failed_requests", f"""{WITH}, q AS (SELECT conv_id, idx AS last_idx, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS req_no FROM prompts WHERE role = 'user'),
    s AS (SELECT q.conv_id, q.req_no, sum({tokens_sql('content')})::BIGINT AS original_tokens, arg_min(CASE (conv_id + idx) % 23 WHEN 4 THEN 'MalformedBody' WHEN 11 THEN 'UnknownRole' END, idx) FILTER ((conv_id + idx) % 23 IN (4, 11)) AS error FROM q JOIN prompts p USING (conv_id) WHERE p.idx <= q.last_idx GROUP BY ALL)
    SELECT conv_id, req_no, original_tokens, error IS NOT NULL AS failed, CASE WHEN error IS NOT NULL THEN 'error:' || error END AS reason, CASE WHEN error IS NOT NULL THEN original_tokens ELSE 0 END AS unchanged_tokens FROM s""")
def c20_requests(spark, sf_dir):
    """Every request of every conversation; those that send a poisoned message fail alone and ship unchanged."""
    poison = (F.col("conv_id") + F.col("idx")) % 23
    p = derived.prompts(spark, sf_dir).withColumn("error", F.when(poison == 4, "MalformedBody").when(poison == 11, "UnknownRole"))
    _, req = intervals.encoded(p, replay.requests(p), Settings())
    fails = F.col("state") == "error"
    return req.select("conv_id", F.col("req_no").cast("long").alias("req_no"), "original_tokens", fails.alias("failed"), F.when(fails, F.col("fallback_reason")).alias("reason"), F.when(fails, F.col("encoded_tokens")).otherwise(F.lit(0).cast("long")).alias("unchanged_tokens"))


@query("e10_pending", f"""{WITH}, q AS (SELECT conv_id, idx AS last_idx, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS req_no FROM prompts WHERE role = 'user'),
    r AS (SELECT p.conv_id, q.req_no, p.idx, p.role, p.content, substr(sha256(p.content), 1, 16) AS hash, row_number() OVER (PARTITION BY p.conv_id, q.req_no ORDER BY p.idx) - 1 AS place, count(*) OVER (PARTITION BY p.conv_id, q.req_no) AS n FROM prompts p JOIN q ON p.conv_id = q.conv_id AND p.idx <= q.last_idx),
    old AS (SELECT *, place < n - 1 AND place > 0 AND role IN ('user', 'assistant', 'tool') AND content != '' AS is_old FROM r),
    asked AS (SELECT DISTINCT conv_id, substr(sha256(content), 1, 16) AS hash FROM prompts WHERE idx % 2 = 1),
    f AS (SELECT o.conv_id, o.hash, min(req_no) AS req_no FROM old o JOIN asked a ON o.conv_id = a.conv_id AND o.hash = a.hash WHERE is_old AND req_no >= 2 GROUP BY ALL)
    SELECT old.conv_id, old.req_no, old.idx FROM old JOIN f ON old.conv_id = f.conv_id AND old.req_no = f.req_no AND old.hash = f.hash WHERE is_old""")
def e10(spark, sf_dir):
    p = derived.prompts(spark, sf_dir)
    sent = replay.replayed(p, replay.requests(p))
    asked = p.filter("idx % 2 = 1").select("conv_id", strings.content_hash(F.col("content")).alias("hash"), F.lit(2).alias("since")).distinct()
    due = serving.pending(asked, encode.routed(sent, Settings()))
    return encode.routed(sent, Settings(), due).filter("route = 'expanded'").select("conv_id", "req_no", "idx")


_EVENTS_SQL = """facts AS (SELECT epoch(ts)::DOUBLE AS ts, event_type AS model, 100 + user_id % 50 AS original_tokens, 40 + event_id % 90 AS encoded_tokens, event_id % 30 AS dict_overhead,
    event_id % 3 AS eff_overhead, (100 + user_id % 50) - (40 + event_id % 90) - event_id % 30 AS saved, ((event_id % 100) * 0.5::DOUBLE) AS pct, ((event_id % 16) * 0.25::DOUBLE) AS latency_ms,
    CASE WHEN event_id % 7 < 2 THEN 1 ELSE 0 END AS fallback, CASE event_id % 7 WHEN 0 THEN 'error:RuntimeError' WHEN 1 THEN 'not-worth-it' ELSE '' END AS fallback_reason,
    CASE WHEN event_id % 5 = 0 THEN 'out' ELSE 'in' END AS direction, CASE event_id % 4 WHEN 0 THEN 'terse' WHEN 1 THEN 'digest,terse' ELSE 'passthrough' END AS representation FROM events)"""


def facts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    original, encoded, overhead = 100 + F.col("user_id") % 50, 40 + i % 90, i % 30
    return e.select(
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("micros"), F.col("event_type").alias("model"), original.alias("original_tokens"), encoded.alias("encoded_tokens"), overhead.alias("dict_overhead"),
        (i % 3).alias("eff_overhead"), (original - encoded - overhead).alias("saved"), ((i % 100) * F.lit(0.5)).alias("pct"), ((i % 16) * F.lit(0.25)).alias("latency_ms"),
        F.when(i % 7 < 2, 1).otherwise(0).alias("fallback"), F.when(i % 7 == 0, "error:RuntimeError").when(i % 7 == 1, "not-worth-it").otherwise("").alias("fallback_reason"),
        F.when(i % 5 == 0, "out").otherwise("in").alias("direction"), F.when(i % 4 == 0, "terse").when(i % 4 == 1, "digest,terse").otherwise("passthrough").alias("representation"),
    ).withColumn("ts", F.col("micros") / 1e6).drop("micros")


_IN = "count(*) AS requests, coalesce(sum(original_tokens), 0)::BIGINT AS original, coalesce(sum(encoded_tokens), 0)::BIGINT AS encoded, coalesce(sum(dict_overhead), 0)::BIGINT AS overhead, coalesce(sum(eff_overhead), 0)::BIGINT AS eff_overhead, coalesce(sum(saved), 0)::BIGINT AS saved, coalesce(sum(original_tokens - encoded_tokens - eff_overhead), 0)::BIGINT AS saved_effective, avg(latency_ms) AS avg_latency_ms, avg((fallback = 1)::INT) * 100 AS fallback_pct, avg((fallback_reason LIKE 'error:%')::INT) * 100 AS error_pct, avg((fallback_reason = 'not-worth-it')::INT) * 100 AS reverted_pct"


@query("m01_summary", f"WITH {_EVENTS_SQL} SELECT {_IN} FROM facts WHERE direction = 'in'")
def m01(spark, sf_dir):
    return metrics.summary(facts(spark, sf_dir))


@query("m02_output", f"WITH {_EVENTS_SQL} SELECT count(*) AS replies, sum(encoded_tokens)::BIGINT AS generated, sum(original_tokens)::BIGINT AS expanded, sum(saved)::BIGINT AS saved FROM facts WHERE direction = 'out'")
def m02(spark, sf_dir):
    return metrics.output_summary(facts(spark, sf_dir))


@query("m03_by_model", f"WITH {_EVENTS_SQL} SELECT model, count(*) AS requests, sum(saved)::BIGINT AS saved, round(avg(pct), 1) AS avg_pct FROM facts WHERE direction = 'in' GROUP BY model")
def m03(spark, sf_dir):
    return metrics.by_model(facts(spark, sf_dir))


@query("m04_by_representation", f"WITH {_EVENTS_SQL} SELECT representation, count(*) AS requests, sum(saved)::BIGINT AS saved FROM facts WHERE direction = 'in' GROUP BY representation")
def m04(spark, sf_dir):
    return metrics.by_representation(facts(spark, sf_dir))


@query("m05_reductions", f"WITH {_EVENTS_SQL}, s AS (SELECT {_IN} FROM facts WHERE direction = 'in') SELECT original, saved, saved_effective, round_even(saved * 100.0::DOUBLE / original, 2) AS reduction_pct, round_even(saved_effective * 100.0::DOUBLE / original, 2) AS reduction_effective_pct FROM s")
def m05(spark, sf_dir):
    return metrics.reductions(metrics.summary(facts(spark, sf_dir))).select("original", "saved", "saved_effective", "reduction_pct", "reduction_effective_pct")


@query("m03_stored_cube", f"""WITH {_EVENTS_SQL} SELECT CASE grouping(model, representation) WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS level, model, representation, {_IN.partition(", avg(latency_ms)")[0]}, avg(latency_ms) AS avg_latency_ms, round(avg(pct), 1) AS avg_pct,
    count(*) FILTER (fallback = 1) * 100.0::DOUBLE / count(*) AS fallback_pct, count(*) FILTER (fallback_reason LIKE 'error:%') * 100.0::DOUBLE / count(*) AS error_pct, count(*) FILTER (fallback_reason = 'not-worth-it') * 100.0::DOUBLE / count(*) AS reverted_pct
    FROM facts WHERE direction = 'in' GROUP BY ROLLUP (model, representation)""")
def m03_cube(spark, sf_dir):
    """The summary by model and representation, by model, and in total, from a cube that a streaming query built out of events in no order of time."""
    folder = shared_folder(spark)
    events = facts(spark, sf_dir)
    events.repartition(4, "original_tokens").write.parquet(f"{folder}/events")
    store = Store(spark, f"{folder}/cube")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    cube.follow(store, arriving).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return metrics.rolled_up(cube.cube(store), "model", "representation")


@query("m06_since", f"WITH {_EVENTS_SQL}, t AS (SELECT max(ts) AS now FROM facts) SELECT {_IN} FROM facts, t WHERE direction = 'in' AND ts >= now - 24 * 3600")
def m06(spark, sf_dir):
    f = facts(spark, sf_dir)
    return metrics.summary(metrics.since(f, 24, f.agg(F.max("ts")).first()[0]))


@query("s13_event_labels", f"{WITH} SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS representation FROM prompts GROUP BY conv_id")
def s13(spark, sf_dir):
    return derived.prompts(spark, sf_dir).groupBy("conv_id").agg(metrics.representation(F.collect_set("role")).alias("representation"))


@query("s14_migration", f"WITH {_EVENTS_SQL} SELECT CASE WHEN fallback = 1 THEN 'legacy' ELSE '' END AS fallback_reason, dict_overhead AS eff_overhead, count(*) AS n FROM facts GROUP BY ALL")
def s14(spark, sf_dir):
    old = facts(spark, sf_dir).drop("fallback_reason", "eff_overhead")
    return metrics.migrated(old).groupBy("fallback_reason", "eff_overhead").agg(F.count(F.lit(1)).alias("n"))


@query("s15_cache_latest", "SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS encoded FROM events GROUP BY user_id")
def s15(spark, sf_dir):
    puts = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("encoded"))
    return metrics.cached(puts)


# --- sources -----------------------------------------------------------------------------------------------------------


@query("s01_chat_source", f"{WITH} SELECT conv_id, 'openai' AS provider, {_MODEL_SQL} AS model, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS idx, role, content FROM prompts")
def s01(spark, sf_dir):
    p = derived.prompts(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("idx", "role", "content")))
    body = F.to_json(F.struct(model_column().alias("model"), F.transform("ms", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")))
    made = p.groupBy("conv_id").agg(ordered.alias("ms")).select("conv_id", body.alias("body"))
    return chat.chat_messages(chat.bodies(made), "openai").select("conv_id", "provider", "model", F.col("idx").cast("long").alias("idx"), "role", "content")


@query("s03_system_block", f"{WITH} SELECT conv_id, string_agg(content, chr(10) ORDER BY idx) AS system FROM prompts WHERE role = 'system' GROUP BY conv_id")
def s03(spark, sf_dir):
    return chat.system_block(derived.prompts(spark, sf_dir))


@query("s02_system_first", f"{WITH}, s AS (SELECT DISTINCT conv_id FROM prompts WHERE conv_id % 2 = 0) SELECT conv_id, idx + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS idx, role, content FROM prompts UNION ALL SELECT conv_id, 0, 'system', 'be brief' FROM s")
def s02(spark, sf_dir):
    p = derived.prompts(spark, sf_dir).select("conv_id", "idx", "role", "content")
    systems = p.filter("conv_id % 2 = 0").select("conv_id").distinct().withColumn("system", F.lit("be brief"))
    return chat.with_system_first(p, systems).select("conv_id", "idx", "role", "content")


@query("s05_generate", f"{WITH} SELECT conv_id, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY idx) FILTER (role = 'system'), '') AS system, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY idx) FILTER (role <> 'system'), '') AS prompt FROM prompts GROUP BY conv_id")
def s05(spark, sf_dir):
    return chat.generate_request(derived.prompts(spark, sf_dir))


@query("s18_hook", f"{WITH} SELECT conv_id, idx, length(content) >= 200 AND (conv_id % 3 <> 0) AND (idx * 10 >= 20) AS applied FROM prompts")
def s18(spark, sf_dir):
    p = derived.prompts(spark, sf_dir).select("conv_id", "idx", F.col("content").alias("prompt"), (F.col("conv_id") % 3 == 0).alias("fallback"), (F.col("idx") * 10).alias("saved"))
    return chat.hook_filtered(p).select("conv_id", "idx", "applied")


# --- benchmarks ---------------------------------------------------------------------------------------------------------------

_ITEMS = f"items AS (SELECT conv_id * 1000 + idx AS id, role AS category, unnest(['raw', 'terse', 'coded']) AS rep, unnest([content, {TERSE_SQL}, {CODED_SQL}]) AS text FROM prompts), counts AS (SELECT id, category, rep, {tokens_sql('text')} AS tokens FROM items WHERE text <> '')"


def bench_items(spark, sf_dir) -> DataFrame:
    p = derived.prompts(spark, sf_dir).withColumn("terse", phrases.compress(F.col("content")))
    p = p.withColumn("coded", dictionary.substitute(F.col("terse"), SEED_RULES))
    reps = F.explode(F.create_map(F.lit("raw"), F.col("content"), F.lit("terse"), F.col("terse"), F.lit("coded"), F.col("coded"))).alias("rep", "text")
    return p.select((F.col("conv_id") * 1000 + F.col("idx")).alias("id"), F.col("role").alias("category"), reps)


@query("b01_matrix", f"{WITH}, {_ITEMS} SELECT * FROM counts")
def b01(spark, sf_dir):
    return benchmarks.matrix(bench_items(spark, sf_dir))


@query("b02_pct", f"{WITH}, {_ITEMS}, t AS (SELECT rep, sum(tokens)::BIGINT AS tokens FROM counts GROUP BY rep) SELECT rep, tokens, round_even(tokens * 100.0::DOUBLE / (SELECT tokens FROM t WHERE rep = 'raw'), 1) AS pct FROM t")
def b02(spark, sf_dir):
    return benchmarks.share_of_raw(benchmarks.matrix(bench_items(spark, sf_dir)), "raw")


@query("b03_winner", f"{WITH}, {_ITEMS} SELECT id, (min((tokens, rep)))[2] AS rep, min(tokens) AS tokens FROM counts GROUP BY id")
def b03(spark, sf_dir):
    return benchmarks.winners(benchmarks.matrix(bench_items(spark, sf_dir)))


@query("b04_replay", f"{WITH}, c AS (SELECT *, {tokens_sql('content')} AS tokens FROM prompts), w AS (SELECT conv_id, idx, role, sum(tokens) OVER (PARTITION BY conv_id ORDER BY idx)::BIGINT AS upto FROM c) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS req_no, idx AS last_idx, upto AS original_tokens FROM w WHERE role = 'user'")
def b04(spark, sf_dir):
    p = derived.prompts(spark, sf_dir)
    sums = replay.prefix_tokens(p.withColumn("tokens", tokens.estimate(F.col("content"))))
    return replay.requests(p).join(sums.select("conv_id", F.col("idx").alias("last_idx"), F.col("upto").alias("original_tokens")), ["conv_id", "last_idx"]).select("conv_id", F.col("req_no").cast("long").alias("req_no"), "last_idx", "original_tokens")


@query("b04_encoded_replay")
def b04_encoded(spark, sf_dir):
    """Every request of every conversation, encoded: per request original, encoded and effective savings."""
    p = derived.prompts(spark, sf_dir)
    _, req = intervals.encoded(p, replay.requests(p), Settings())
    return req.select("conv_id", "req_no", "original_tokens", "encoded_tokens", "dict_overhead", "eff_overhead", "saved", "saved_effective", "fallback_reason")


@query("b05_quality", f"{WITH} SELECT conv_id * 1000 + idx AS task, (contains(lower(content), 'cache') OR contains(lower(content), 'files')) AND (contains(lower(content), 'bug') OR contains(lower(content), 'log')) AS passed FROM prompts")
def b05(spark, sf_dir):
    groups = F.array(F.array(F.lit("Cache"), F.lit("files")), F.array(F.lit("BUG"), F.lit("log")))
    return benchmarks.quality(derived.prompts(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("idx")).alias("task"), F.col("content").alias("answer"), groups.alias("groups")))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session replay's savings, per request."""
    return b04_encoded(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

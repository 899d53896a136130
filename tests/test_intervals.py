"""Encoding by intervals against encoding every prefix, dictionaries by row against whole chains, and counting by vocabulary."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import fixed, strings, tokens
from palimpsest.functions.config import Settings
from palimpsest.operators import automaton, dictionary
from palimpsest.plans import derived, encode, intervals, replay

REPORT = ["conv_id", "req_no", "original_tokens", "encoded_tokens", "dict_overhead", "eff_overhead", "saved", "saved_effective", "fallback_reason", "block", "head", "state", "aliases_ship", "total_plain", "total_alias", "digest", "digest_alias"]
MESSAGE = ["conv_id", "req_no", "idx", "role", "content", "route", "plain", "aliased", "label", "tokens"]
CODES = "Please run the tests; preserve all public APIs and do not modify unrelated files. "
SAID = [
    (1, 0, "system", "You work for the Acme Corporation. " + CODES, False), (1, 1, "user", "The Agent Manager wrote to Acme Corporation about Agent please Manager and E1 and K14. " + CODES * 2, False),
    (1, 2, "assistant", "Agent Manager says: error in build 12.\n```py\nx = 1\n```\nfixed it. " * 3, False), (1, 3, "tool", "long result " * 40, False), (1, 4, "tool", "short K5 result", False), (1, 5, "assistant", None, True),
    (1, 6, "user", "Big Agent Manager and Agent Managers; never delete 3 files. Could you please identify any bugs in order to fix them, K3; K4, K5 and K6; K7. " + CODES, False), (1, 7, "assistant", "error in build 12.\nfixed it.", False),
    (1, 8, "user", "", False), (1, 9, "user", "K1 Report from Agent Manager about K1 Report and E2 Thing, E2 Thing. " + CODES * 3, False), (1, 10, "assistant", "not sent by any request", False),
    (2, 0, "user", "hi", False), (3, 0, "assistant", "no request here", False), (4, 5, "user", "Please run the tests afterwards, and run the tests again. " * 4, False), (4, 7, "user", "Please run the tests afterwards, and run the tests again. " * 4, False),
]


def said(spark, sf=None):
    odd = spark.createDataFrame([(c + 100_000, *rest) for c, *rest in SAID], "conv_id long, idx long, role string, content string, has_tool_calls boolean")
    return odd if sf is None else derived.prompts(spark, sf).unionByName(odd)


def as_rows(df, columns):
    return sorted(map(str, df.select(columns).collect()))


@pytest.mark.parametrize("mode", ["MAX", "BALANCED"])
def test_intervals_equal_prefixes(spark, mode):
    """Row by row, reports and messages; the states are fewer than the rows of all prefixes."""
    messages = said(spark, "/root/testdata/sf0.001")
    asked, settings = replay.requests(messages), Settings(mode=mode)
    states, req = intervals.encoded(messages, asked, settings)
    rows, want = encode.encode(replay.replayed(messages, asked).drop("last_idx"), settings)
    assert as_rows(req, REPORT) == as_rows(want, REPORT)
    got = as_rows(intervals.at_requests(states, asked), MESSAGE)
    assert got == as_rows(rows, MESSAGE)
    assert states.count() < len(got)


def test_states_are_linear(spark):
    """Two states a message at most, however long the conversation."""
    for n in (8, 80):
        talk = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("idx"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("word "), F.col("id")).alias("content"), F.lit(False).alias("has_tool_calls"))
        rows = intervals.spans(talk, replay.requests(talk).withColumns({"scope": F.lit("global"), "profile": F.lit("")}), Settings())
        new = rows.filter("content != '' and from_req < coalesce(old_from, last_req + 1)").count()
        assert new + rows.filter("old_from is not null").count() <= 2 * n


ALIASES = [("a", "K20", "agent manager wrote", [r"agent manager wrote"]), ("a", "K21", "run the tests", ["run the tests"]), ("b", "K20", "preserve all public apis", ["preserve all public apis"]), ("b", "K30", "never delete", [r"never\ delete"]), ("b", "K31", "see k30 now", [r"\Qand run\E"])]


def test_rules_by_scope_equal_one_chain(spark):
    """Requests of one scope among others, encoded by the dictionary of their rows, as by that scope's own chain."""
    aliases = spark.createDataFrame([(*a, None) for a in ALIASES], dictionary.ALIASES)
    generations = spark.createDataFrame([("a", 1, ["K20"]), ("a", 2, ["K20", "K21"]), ("b", 1, ["K30"]), ("b", 2, ["K20", "K30", "K31"])], "scope string, version int, codes array<string>")
    messages, settings = said(spark), Settings(mode="BALANCED", seed_dictionary=False)
    asked = replay.requests(messages).withColumns({"scope": F.when(F.col("conv_id") == 100_004, "a").otherwise("b"), "version": F.lit(2)})
    _, req = intervals.encoded(messages, asked, settings, automaton.Dictionary.scoped(aliases, generations))
    own = {c: e for s, c, e, _ in ALIASES if s == "b"}
    chain = [(f"(?iU){form}", code) for form, code in sorted(((f, c) for s, c, _, forms in ALIASES if s == "b" for f in forms), key=lambda x: (-len(x[0]), int(x[1][1:]), x[0]))]
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    mine = messages.filter("conv_id != 100004")
    _, want = encode.encode(replay.replayed(mine, replay.requests(mine)).drop("last_idx"), settings, chain, as_map(own), as_map({c: f"{c}={e}" for c, e in own.items()}), version=2)
    assert as_rows(req.filter("conv_id != 100004"), REPORT) == as_rows(want, REPORT)
    other = [r["used"] for r in req.filter("conv_id = 100004").collect()]
    assert other and all(set(u) <= {"K20", "K21"} for u in other)


def test_automaton_equals_chain(spark):
    """Random forms, some of which hold codes or need nothing literal, on random texts."""
    rng = random.Random(7)
    words = ["run", "the", "tests", "K2", "k12", "İx", "straße", "a.b", "(c)", "x+y", "ſee"]
    phrases = list({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)})
    forms = [(r"\Q" + p + r"\E" if rng.random() < 0.5 else dictionary.escaped(p), f"K{i}") for i, p in enumerate(phrases)] + [(r"(?:run|the) \w+", "K900"), (r"analy[sz]e th(?:is|e) run", "K901")]
    aliases = spark.createDataFrame([("s", c, f, [f], None) for f, c in forms], dictionary.ALIASES)
    known = automaton.Dictionary.scoped(aliases, spark.createDataFrame([("s", 1, [c for _, c in forms])], "scope string, version int, codes array<string>"))
    texts = [" ".join(rng.choices([*words, "RUN", "Analyse this", "STRASSE"], k=rng.randint(0, 9))) for _ in range(200)]
    df = spark.createDataFrame([("s" if i % 9 else "other", 1, t) for i, t in enumerate(texts)], "scope string, version int, text string")
    chain = [(f"(?iU){f}", c) for f, c in sorted(forms, key=lambda x: (-len(x[0]), int(x[1][1:]), x[0]))]
    want = df.withColumn("out", F.when(F.col("scope") == "s", strings.chained(F.col("text"), chain)).otherwise(F.col("text")))
    assert as_rows(known.coded(df, "text", "out"), ["scope", "text", "out"]) == as_rows(want, ["scope", "text", "out"])
    finder = automaton.Finder([(0, "(?iU)" + dictionary.escaped("the tests"), "K1"), (1, r"(?iU)\w+", "K2")])
    assert [h[2] for h in finder.of("THE TESTS")] == ["K1", "K2"] and [h[2] for h in finder.of("the")] == ["K2"]


def test_guarded_chains_equal_plain_ones(spark):
    """A chain that is skipped where none of its literals occurs gives what the whole chain gives."""
    from palimpsest.operators import phrases

    rules = [*phrases.DELETIONS, *phrases.REWRITES, *fixed.TIGHTENED]
    texts = ["", None, "PLEASE do  it ,, now", "pleaſe go ahead and run", "nothing to see  here ;", "in order to identify any application", "at least 3", "hey, a", "\n ; x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] == r[1] for r in df.select(phrases.compress("t"), strings.chained(F.col("t"), rules)).fillna("").collect()] == [True] * len(texts)
    assert strings.required(r"(?iU)\bplease\b,?\s*") == "please" and strings.required(r"\w+") == "" and strings.required(r"\QA b\E") == "a b"


def test_decision_counts_by_vocabulary(spark):
    """Sums and decisions under a local vocabulary: each text's size is the library's, each profile its own."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    messages = said(spark).filter("conv_id in (100001, 100004)")
    asked = replay.requests(messages).withColumn("profile", F.when(F.col("conv_id") == 100_001, "qwen2.5").otherwise("claude-est"))
    states, req = intervals.encoded(messages, asked, Settings(), size=tokens.sized({"qwen2.5": (path, "hf")}))
    library = Tokenizer.from_file(path)
    exact = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = {(r["conv_id"], r["req_no"]): r for r in req.collect()}
    for (conv, req_no), r in got.items():
        last = [i for c, i, role, _, _ in SAID if c + 100_000 == conv and role == "user"][req_no - 1]
        sent = [t for c, i, _, t, _ in SAID if c + 100_000 == conv and i <= last]
        if conv == 100_001:
            assert r["original_tokens"] == sum(map(exact, sent)) and r["overhead"] == exact(r["block"])
    estimated = {r["t"]: r["n"] for r in messages.select(F.coalesce("content", F.lit("")).alias("t"), tokens.estimate(F.coalesce("content", F.lit(""))).alias("n")).collect()}
    assert got[100_004, 2]["original_tokens"] == 2 * estimated[SAID[-1][3]]
    shipped = intervals.at_requests(states, asked.filter("req_no = 3")).filter("conv_id = 100001").collect()
    assert got[100_001, 3]["plain_tokens"] == sum(exact(r["plain"]) for r in shipped) and got[100_001, 3]["alias_tokens"] == sum(exact(r["aliased"]) for r in shipped)
    cost = got[100_001, 3]["total_alias"] + got[100_001, 3]["effective"]
    assert got[100_001, 3]["aliases_ship"] == (got[100_001, 3]["total_plain"] > cost)


def test_poisoned_requests_fail_alone(spark, tmp_path):
    """A message with an error, a vocabulary that is missing and one that is broken: three kinds inside one encode, the rest goes on."""
    (tmp_path / "broken.json").write_text("{ no vocabulary")
    talk = [(c, i, "user", f"Please run the tests afterwards {c} {i}. " * 9, False, "MalformedBody" if (c, i) == (1, 2) else None) for c in range(1, 5) for i in range(4)]
    messages = spark.createDataFrame(talk, "conv_id long, idx long, role string, content string, has_tool_calls boolean, error string")
    profile = F.element_at(F.array(*map(F.lit, ("claude-est", "qwen2.5", "llama3", "claude-est"))), F.col("conv_id").cast("int"))
    size = tokens.sized({"qwen2.5": (str(tmp_path / "missing.json"), "hf"), "llama3": (str(tmp_path / "broken.json"), "hf")})
    asked = replay.requests(messages)
    states, req = intervals.encoded(messages, asked.withColumn("profile", profile), Settings(), size=size)
    got = {(r["conv_id"], r["req_no"]): r for r in req.collect()}
    reasons = {k: r["fallback_reason"] for k, r in got.items() if r["state"] == "error"}
    assert reasons == {(1, 3): "error:MalformedBody", (1, 4): "error:MalformedBody"} | {(c, n): "error:CountError" for c in (2, 3) for n in range(1, 5)}
    assert all(got[k]["encoded_tokens"] == got[k]["original_tokens"] > 0 and got[k]["saved"] == 0 and got[k]["fallback"] and got[k]["head"] == "" for k in reasons)
    assert all(got[4, n]["state"] == "encoded" for n in range(1, 5)) and got[1, 2]["state"] == "encoded"
    shipped = encode.composed(intervals.at_requests(states, asked), req).filter("conv_id = 1 and req_no = 3").orderBy("idx").collect()
    assert [r["content"] for r in shipped] == [t for c, i, _, t, *_ in talk if c == 1 and i <= 2]


def test_marks_of_names_meet_without_their_texts(spark):
    """A text is in one row when entities are looked up, not in one for each of its blanks."""
    rows = spark.createDataFrame([(1, 0, 1, 3, "ask the Agent Manager of E1 now")], "conv_id long, idx long, from_req int, until_req int, content string")
    entities = spark.createDataFrame([(1, 1, "E1", "Agent Manager", 2)], "conv_id long, number int, code string, name string, since int")
    out = intervals.touched(rows, entities, F.col("content"), F.lit(""))
    assert {(r.from_req, r.until_req, len(r.pairs)) for r in out.collect()} == {(1, 2, 0), (2, 3, 1)}
    made = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" in line and "mark#" in line]
    assert made and not any("__said#" in line for line in made)

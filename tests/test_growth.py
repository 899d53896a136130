"""Steps whose work must grow no faster than their input: results against brute force, and plans without pairs of a whole scope."""

import random

from pyspark.sql import functions as F

from palimpsest.functions import strings
from palimpsest.functions.config import Settings
from palimpsest.operators import automaton, dictionary
from palimpsest.plans import encode, intervals, replay, serving


def test_generations_are_counted_without_pairs_of_a_scope(spark):
    rng = random.Random(5)
    log = [(s, e) for s in ("a", "b") for e in range(0, 12_000, 3) for _ in range(rng.randrange(1, 3))]
    minted = [(s, e) for s in ("a", "b", "c") for e in range(12_000) if rng.random() < 0.3] + [("a", 7), ("a", 7), ("b", None)]
    out = serving.with_generation(spark.createDataFrame(log, "scope string, epoch long"), spark.createDataFrame(minted, "scope string, epoch long"))
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("epoch" in line or "part" in line for line in joins)  # a join by scope alone is quadratic
    before = {s: 0 for s in "abc"}
    want, known = {}, set(minted)
    for e in range(12_000):
        for s in before:
            want[s, e] = 1 + before[s]
            before[s] += (s, e) in known
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted((s, e, want[s, e]) for s, e in log)


def test_scoped_forms_meet_texts_by_keys(spark):
    """Equal forms count once, long ones share their first characters, numbers pass 2 ** 31; results are those of the chain and of an automaton of all forms."""
    rng = random.Random(3)
    words = ["run", "the", "tests", "before", "anything", "elsé", "back"]
    phrases = ["run the tests", *{" ".join(rng.choices(words, k=k)) for k in (2, 3, 6, 6, 6) for _ in range(30)}]
    forms = [("run the tests", f"K{i}") for i in range(1, 200)] + [(p, f"K{3_000_000_000 + i}") for i, p in enumerate(phrases)]
    aliases = spark.createDataFrame([("s", c, f, [f], None) for f, c in forms], dictionary.ALIASES)
    known = automaton.Dictionary.scoped(aliases, spark.createDataFrame([("s", 1, [c for _, c in forms])], "scope string, version int, codes array<string>"))
    texts = [" ".join(rng.choices([*words, "RUN", "ELSÉ"], k=rng.randint(0, 14))) for _ in range(80)]
    df = spark.createDataFrame([("s", 1, i, t) for i, t in enumerate(texts)], "scope string, version long, id long, text string")
    found = {r["id"]: r["hits"] for r in automaton.hits(df.filter("text != ''"), known.forms).collect()}
    finder = automaton.Finder([(k, "(?iU)" + f, c) for k, (f, c) in enumerate(forms)])
    for i, t in enumerate(texts):
        assert {h["pattern"] for h in found.get(i, [])} >= {h[1] for h in finder.of(t)}
        assert sum(h["pattern"] == "(?iU)run the tests" for h in found.get(i, [])) <= 1
    ordered = sorted(forms, key=lambda x: (-len(x[0]), int(x[1][1:]), x[0]))
    hit = [[(f, c) for f, c in ordered if strings.folded(f) in strings.folded(t)] for t in texts]
    plain = [df.filter(F.col("id") == i).withColumn("want", strings.chained(F.col("text"), [(f"(?iU){f}", c) for f, c in h])) for i, h in enumerate(hit[:12])]
    want = {r["id"]: r["want"] for p in plain for r in p.collect()}
    got = {r["id"]: r["out"] for r in known.coded(df, "text", "out").collect()}
    assert {i: got[i] for i in want} == want


def test_mode_off_rewrites_nothing(spark, monkeypatch):
    """Messages are counted and go out as they came; no pattern of the encoder runs. Shipped requests equal those of ``encode.encode``."""
    talk = [(c, i, "user" if i % 2 == 0 else "assistant", "" if (c, i) == (2, 1) else f"Please run the tests afterwards {c} {i}. " * (i + 1), False) for c in (1, 2) for i in range(6)]
    messages = spark.createDataFrame(talk, "conv_id long, idx long, role string, content string, has_tool_calls boolean")
    asked, settings = replay.requests(messages), Settings(mode="OFF")
    shipped = ["conv_id", "req_no", "original_tokens", "encoded_tokens", "dict_overhead", "eff_overhead", "saved", "saved_effective", "pct", "fallback", "fallback_reason", "state", "head"]
    sent, whole = encode.encode(replay.replayed(messages, asked).drop("last_idx"), settings)
    want, out = sorted(map(tuple, whole.select(shipped).collect())), sorted(map(tuple, encode.composed(sent, whole).collect()))

    def never(*_, **__):
        raise AssertionError("a text is rewritten")

    for name in ("skeletons", "judged", "turn_lines"):
        monkeypatch.setattr(encode, name, never)
    states, req = intervals.encoded(messages, asked, settings)
    assert sorted(map(tuple, req.select(shipped).collect())) == want
    assert sorted(map(tuple, encode.composed(intervals.at_requests(states, asked), req).collect())) == out


def test_costly_texts_are_dealt_to_more_tasks_than_cores(spark):
    """A grouping by the same keys doesn't lend its partitions, which are merged to few."""
    flags = spark.range(500).selectExpr("cast(id % 100 as string) as key", "'' as profile").groupBy("key", "profile").count()
    assert intervals.dealt(flags, "key", "profile").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism

"""Regions, phrases, invariants, folding and tokens on literal cases."""

import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import fixed, strings, tokens
from palimpsest.operators import dictionary, folding, phrases, regions, replies, sessions, verifier
from palimpsest.plans import derived
from palimpsest.streaming.decoder import decoded

CASES = [
    r"open C:\work\a.txt and set API_ROUTE=/v1/x; don't stop", "use `x = 1` at https://e.org/a?b=1", "```py\nprint('a')\n```", '{"a": {"b": 1}} end', "deadbeefdeadbeefdeadbeefdeadbeef 123e4567-e89b-12d3-a456-426614174000",
    "mail a.b@c.org in ~/x/y/z", "v1.2.3 cost 99.9% and 250 ms", "snake_case camelCase a.b.c()", r"2024-05-06T07:08:09Z on D:\x and \\host\share", "sk-abcdefghijkl0123", "already ⟦0⟧ here ⟦1⟧", "", "<a b='c'>x</a> <i>y", "{" * 50 + "x" + "}" * 50,
]


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_regions_come_back(spark):
    df = regions.extract(spark.createDataFrame([(i, c) for i, c in enumerate([*CASES, None])], "i int, t string"), "t")
    rows = df.select("i", "skeleton", "regions", regions.restore(F.col("skeleton"), F.col("regions")).alias("back")).collect()
    for r in rows:
        assert r["back"] == ([*CASES, ""])[r["i"]]
    first = next(r for r in rows if r["i"] == 0)
    assert "C:" not in first["skeleton"] and "API_ROUTE" not in first["skeleton"] and "don't" in first["skeleton"]


def test_lost_placeholder_is_no_text(spark):
    df = regions.extract(spark.createDataFrame([("see https://e.org/a now",)], "t string"), "t")
    assert df.select(regions.restore(F.lit("see now"), F.col("regions")).alias("x")).first()["x"] is None


def test_long_block_survives(spark):
    assert one(spark, "{" + "a" * 50_000 + "}", lambda c: regions.count_of(c, "json_block")) == 1


def test_phrases(spark):
    out = one(spark, "Please make sure that you do not delete the backup files.", phrases.compress)
    assert "please" not in out.lower() and "do not" in out and out.startswith("ensure")
    out = one(spark, "compare at least 3 approaches and at most 10 options", phrases.compress)
    assert ">=3" in out and "<=10" in out


@pytest.mark.parametrize(("a", "b", "ok"), [
    ("do not delete it", "delete it", False), ("keep 10 of it", "keep 100 of it", False), ("this is optional", "this is required", False),
    ("please never touch it, at least 3 times", "do not touch it, >= 3 times", True), ("as always, go", "go", True), ("always go", "go", False), (None, "", True),
])
def test_verifier(spark, a, b, ok):
    row = spark.createDataFrame([(a or "", b)], "a string, b string").select(verifier.verify(F.col("a"), F.col("b")).alias("v")).first()["v"]
    assert row["ok"] is ok and row["confidence"] == pytest.approx(1 - 0.4 * len(row["failures"]))


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a", 1), ("字" * 15, 16), ("x" * 34, 10)])
def test_estimate(spark, text, n):
    assert one(spark, text, tokens.estimate) == n


def test_codes_expand_whole(spark):
    expansions = F.create_map(*[F.lit(x) for x in ("K4", "four", "K40", "forty", "K400", "fourhundred", "E1", "one", "E10", "ten")])
    assert one(spark, "K400 K40 K4 E10 E1 K99 OK4", lambda c: dictionary.expand(c, expansions)) == "fourhundred forty four ten one K99 OK4"


def test_bundle_stops_at_whole_codes(spark):
    assert one(spark, "K3; K4; K5; K6; K7", dictionary.bundle) == "P1"
    assert one(spark, "K3; K4; K5; K6; K78", dictionary.bundle) == "K3; K4; K5; K6; K78"


def test_key_lines(spark):
    text = "\n".join([*[f"line {i} of nothing" for i in range(39)], "error: cache miss was the bug"])
    df = folding.with_key_lines(spark.createDataFrame([(text,), ("",), ("one\ntwo",)], "t string"), "t", "x", 2)
    assert [r["x"] for r in df.collect()] == ["line 0 of nothing\nerror: cache miss was the bug\n[+38 lines folded]", "", "one\ntwo"]


def test_entities(spark):
    assert one(spark, "The Agent Manager talks to the Agent Manager daily. Ab Cd.", sessions.entity_names) == ["Agent Manager", "Agent Manager"]


def test_expansion_requests(spark):
    h = "0123456789abcdef"
    assert one(spark, f"please Expand [ref: {h}]\nsee [ref:fedcba9876543210]\nexpand code:{h}", replies.asked_hashes) == [h]


def test_stream_equals_batch():
    table = {"K1": "analyze the program", "K12": "fix all bugs found"}
    text = "first K12 then Board OK1 done [ref:0123456789abcdef x] and [ a lone bracket K1; K99"
    whole = "".join(decoded([text], table, {"0123456789abcdef": "ORIGINAL"}))
    assert whole == "first fix all bugs found then Board OK1 done ORIGINAL and [ a lone bracket analyze the program; K99"
    for size in range(1, 12):
        assert "".join(decoded([text[i : i + size] for i in range(0, len(text), size)], table, {"0123456789abcdef": "ORIGINAL"})) == whole


def test_streams_say_what_whole_replies_say():
    import random

    from palimpsest.streaming import decoder

    rng = random.Random(5)
    known, texts = {"K1": "one", "K12": "twelve", "E3": "the Board"}, {"0123456789abcdef": "ORIGINAL K1"}
    parts = ["K1", "K12", "E3", "K", "P", "xK1", "K1x", " ", "_", "[", "]", "[ref:", "[code:0123456789abcdef", "[ref:0123456789abcdef 3L]", "[ref:ffffffffffffffff K1]", "[re", "é", "1", "\n", "[[ref:0123456789abcdef]"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        codes = re.sub(r"\b[KPE]\d+\b", lambda m: known.get(m[0], m[0]), text)
        want = decoder.REFERENCE.sub(lambda m: texts.get(m[1], m[0]), codes)
        if max((len(m) for m in re.findall(r"\[[^\]]*", text)), default=0) > decoder.LONGEST:
            continue
        for size in (1, 2, 5, len(text)):
            assert "".join(decoded([text[i : i + size] for i in range(0, len(text), size)], known, texts)) == want, text


GOLDENS = {
    "json_block": ('send {"a": {"b": [1]}} now, not {x nor w{"c": 1}', ['{"a": {"b": [1]}}']),
    "xml_block": ('a <b>x</b> and <c d="1">y\nz</c> but <e>z</f>', ["<b>x</b>", '<c d="1">y\nz</c>']),
    "posix_path": ("see /usr/local/bin and ~/work/x.txt or a/b and /one", ["/usr/local/bin", "~/work/x.txt"]),
    "regex_lit": ("match /ab+c/gi or /a\\/b/ but not 1/2/3", ["/ab+c/gi", "/a\\/b/"]),
}


@pytest.mark.parametrize("kind", GOLDENS)
def test_regions_without_twin(spark, kind):
    """Literal cases of the kinds whose patterns look around or back."""
    text, want = GOLDENS[kind]
    assert one(spark, text, lambda c: strings.found(c, dict(fixed.REGIONS)[kind])) == want


def test_extract_equals_one_kind_after_the_other(spark):
    """The guarded single selection against plain replacements, kind by kind, on prompts and on texts made of all signs."""
    odd = ["", None, "```a\n```", "⟦0⟧ {x} ⟦​", "a@b.co C:\\x \\\\h\\s x_y aB.c() 'q q' \"r r\" /a/b 1.2.3 2024-01-02 5 ms f.py A_B=1", *[t for t, _ in GOLDENS.values()]]
    df = spark.createDataFrame([(t,) for t in odd], "content string").union(derived.prompts(spark, "/root/testdata/sf0.001").select("content"))
    want = df.withColumn("s", F.replace(F.coalesce("content", F.lit("")), F.lit(fixed.OPEN), F.lit(fixed.OPEN + fixed.ESCAPE))).withColumn("r", F.array().cast("array<string>"))
    for _, pattern in fixed.REGIONS:
        number = lambda m, i: F.when(m.isNotNull(), F.concat(F.lit(fixed.OPEN), (F.size("r") + i).cast("string"), F.lit(fixed.CLOSE)))
        want = want.withColumns({"s": strings.replaced_each(F.col("s"), pattern, number), "r": F.concat("r", strings.found(F.col("s"), pattern))})
    got = regions.extract(df, "content").select("content", "skeleton", "regions.text")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("content", F.col("s").alias("skeleton"), F.col("r").alias("text")).collect()))
    assert all(sign in fixed.REGION_SIGNS.values() for sign in ("```", "://")) and set(fixed.REGION_SIGNS) <= {k for k, _ in fixed.REGIONS}


def test_rules_that_are_tried_by_letters_replace_what_a_plain_chain_does(spark):
    """Letters beyond ASCII that match ASCII ones without case, and literals that an earlier rule brings or joins."""
    words = ("plea\u017fe run", "\u212aindly go", "\u0130n order to x", "\u0131dentify any a", "IDENTIFY ANY b", "ma please ke sure", "in could you order to", "Basically, note that at least 3", "\u017fix", "analyse the code", None, "")
    df = spark.createDataFrame([(w,) for w in words], "t string")
    chain = [*phrases.DELETIONS, *phrases.REWRITES, (r"(?iU)behavior", "docs umentation"), (r"(?iU)docs umentation|six", "d"), *dictionary.seed_rules()]
    rows = df.select(strings.chained("t", chain).alias("a"), strings.chained(F.col("t"), chain).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert "(?=" in str(df.select(strings.chained("t", chain))._jdf.queryExecution().analyzed().toString())  # rules don't look at every place


def test_starts_and_shapes_leave_no_match_out(spark):
    """Each pattern with its start and shape finds what it finds alone."""
    said = ["sk-abcdefghijkl0123 BEARER abcdefghijklmnop1234 to\u212aen abcdefghijklmnopqr", "a" * 40 + " " + "0f" * 20, "5 ms 7\u00a0KB \u0665ms", "camelCase x_y 'ab' \"cd\"", "UP TO 3 exactly\u00a04 no more than 5 <6 at lea\u017ft 7", "don't \u017fhouldn't MUST NOT optional as always always unle\u017fs can't", "C:\\x app.main.run() v1.2.3 2024-05-06T07:08Z a.py A=1 ABC=1", "K1 xK2 P\u0661 K", "Agent Manager The Big\u00a0One"]
    c = F.col("t")
    pairs = [(strings.begun(p, fixed.REGION_STARTS[k]) if k in fixed.REGION_STARTS else p, p, 0, fixed.REGION_SHAPES.get(k)) for k, p in fixed.REGIONS]
    pairs += [(strings.begun(fixed.NEGATION, fixed.NEGATION_START), fixed.NEGATION, 0, None), (strings.begun(fixed.MODALITY, fixed.MODALITY_START), fixed.MODALITY, 1, None), (strings.begun(fixed.COMPARATOR, fixed.COMPARATOR_START), fixed.COMPARATOR, 1, fixed.COMPARATOR_SHAPE)]
    pairs += [(strings.begun(fixed.CODE, fixed.CODE_START), fixed.CODE, 1, fixed.CODE_SHAPE), (strings.begun(fixed.ENTITY, "A-Z"), fixed.ENTITY, 1, fixed.ENTITY_SHAPE)]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    for quick, plain, group, shape in pairs:
        assert not df.filter(strings.found(c, quick, group, shape) != strings.found(c, plain, group)).count(), plain

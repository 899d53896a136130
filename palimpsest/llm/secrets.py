"""Operator 9: secret scan with a battery of randomness tests. DataFrame functions only.

Three patterns give the base spans. The method adds random-looking strings:
every maximal run of 20 or more encoding characters gets an inferred encoding
(base16, base32, base36 or base64, by the characters it has); runs of letters
alone have none. Against that alphabet three tests ask whether the run could be
uniform noise:

- chi-squared of the character counts, by a gamma law with its exact mean and
  variance (Wilson and Hilferty's cube root),
- the runs test over characters above and below the alphabet's middle,
- lag-1 serial correlation of the characters' places in the alphabet.

The smallest p-value of the three (times three) says how far a run is from noise.
Its evidence against being text is the number of changes between digits, small
and capital letters: text changes in ``CHANGES`` of all places at most, noise far
more often, and the more places there are, the smaller the p-value. The
hypotheses are the runs of a text that have an encoding, no others, so a key's
fate doesn't hang on the length of the text around it. Benjamini and Hochberg's
procedure over them is made twice: a run is reported if it is among the
discoveries against text at ``FDR``, and not among those of the battery against
noise at ``ALPHA``. Run length enters through the tests.

Null and empty texts have no spans. Overlaps between kinds stay; a method span
inside a base span is left out. Repeated rows give equal rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns (fixed values). A shorter ``assign`` match still uses up its text, so its length is tested afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "random")
ALPHA, CHANGES, FDR = 0.003, 0.15, 0.01
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
DIGITS, SMALL, CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by the characters they allow, the first that fits; a run must hold a digit and a letter.
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + SMALL[:6]), ("^[0-9A-F]+$", DIGITS + CAPITAL[:6]), ("^[A-Z2-7]+$", CAPITAL + "234567"),
    ("^[0-9a-z]+$", DIGITS + SMALL), ("^[0-9A-Z]+$", DIGITS + CAPITAL), ("^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+$", CAPITAL + SMALL + DIGITS + "+/"),
)

#: A fitted polynomial in t = 1 / (1 + x / 2) for log(erfc(x) / t) + x * x, highest power first.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)

SPAN = "struct<start:int,end:int,text:string>"


def spans_of(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """Spans of a pattern's leftmost matches, in code points: matches and the pieces between them are laid end to end.

    With ``group``, only matches whose group has ``least`` characters stay.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.size(found) > 0, _laid(text, pattern, found, group, least)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _laid(text: Column, pattern: str, found: Column, group: int | None, least: int) -> Column:
    tested = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda g: F.length(g) >= least) if group else F.transform(found, lambda _: F.lit(True))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), tested.alias("good"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        low = acc["at"] + F.length(x["gap"])
        high = low + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(low.alias("start"), high.alias("end"), x["match"].alias("text"))
        return F.struct(high.alias("at"), F.when(x["good"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, start, add, lambda acc: acc["out"])


def upper_tail(z: Column) -> Column:
    """1 - Phi(z), right to six places of its own size in both tails."""
    x = F.least(F.lit(37.0), F.abs(z)) / math.sqrt(2)
    t = F.lit(1.0) / (F.lit(1.0) + x / 2)
    tail = F.lit(0.5) * t * F.exp(reduce(lambda acc, c: acc * t + c, map(F.lit, ERFC[1:]), F.lit(ERFC[0])) - x * x)
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def alphabet_of(run: Column) -> Column:
    """The inferred encoding's alphabet; null without one."""
    out = F.lit(None).cast("string")
    for pattern, alphabet in reversed(ENCODINGS):
        out = F.when(run.rlike(pattern), alphabet).otherwise(out)
    return F.when(run.rlike("[0-9]") & run.rlike("[A-Za-z]"), out)


def noise_p(run: Column, alphabet: Column) -> Column:
    """The smallest p-value of the three tests times three: small if the run isn't noise."""
    n, k = F.length(run).cast("double"), F.length(alphabet).cast("double")
    squares = F.aggregate(
        F.sequence(F.lit(1), F.length(alphabet)), F.lit(0.0),
        lambda acc, j: acc + F.pow((F.length(run) - F.length(F.replace(run, F.substring(alphabet, j, F.lit(1)), F.lit("")))).cast("double"), F.lit(2.0)),
    )
    shape = (k - 1) / 2 * n / (n - 1)  # mean k - 1, variance 2 (k - 1) (n - 1) / n
    chi = (F.pow(F.greatest(F.lit(0.0), (k / n * squares - n) / (k - 1)), F.lit(1 / 3)) - 1 + F.lit(1.0) / (F.lit(9.0) * shape)) * 3 * F.sqrt(shape)
    places = F.transform(F.filter(F.split(F.translate(run, "-_", "+/"), ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double"))
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("last", "high", "runs", "sum", "sq", "cross", "i", "first")])

    def step(acc: Column, v: Column) -> Column:
        up, before = v * 2 > k, acc["last"] * 2 > k
        return F.struct(
            v.alias("last"), (acc["high"] + F.when(up, 1.0).otherwise(0.0)).alias("high"), (acc["runs"] + F.when((acc["i"] == 0) | (up != before), 1.0).otherwise(0.0)).alias("runs"),
            (acc["sum"] + v).alias("sum"), (acc["sq"] + v * v).alias("sq"), (acc["cross"] + F.when(acc["i"] == 0, 0.0).otherwise(v * acc["last"])).alias("cross"),
            (acc["i"] + 1).alias("i"), F.when(acc["i"] == 0, v).otherwise(acc["first"]).alias("first"),
        )

    def finish(a: Column) -> Column:
        high, low = a["high"], n - a["high"]
        mean = F.lit(2.0) * high * low / n + 1
        spread = F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1)))
        runs = F.abs(a["runs"] - mean) / spread
        m = a["sum"] / n
        variance = F.greatest(F.lit(1e-9), a["sq"] - n * m * m)
        cross = a["cross"] - m * (a["sum"] - a["last"]) - m * (a["sum"] - a["first"]) + (n - 1) * m * m
        serial = F.abs(cross / variance + F.lit(1.0) / n) * F.sqrt(n)
        return F.least(upper_tail(chi), F.lit(2.0) * upper_tail(runs), F.lit(2.0) * upper_tail(serial))

    return F.least(F.lit(1.0), F.lit(3.0) * F.aggregate(places, zero, step, finish))


def text_p(run: Column) -> Column:
    """How probable so many changes of character class would be in text."""
    n = (F.length(run) - 1).cast("double")
    classes = F.translate(run, DIGITS + SMALL + CAPITAL + "+/_-", "0" * 10 + "a" * 26 + "A" * 26 + "----")
    changes = F.length(run) - F.length(F.regexp_replace(classes, r"(.)(?=\1)", ""))  # places without a change
    z = (n - changes - n * CHANGES - 0.5) / F.sqrt(n * CHANGES * (1 - CHANGES))
    return upper_tail(z)


def scored_runs(runs: Column) -> Column:
    """The runs that have an encoding, with p-values against text (p) and against noise (noise)."""
    known = F.filter(
        F.transform(runs, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), alphabet_of(s["text"]).alias("alphabet"))),
        lambda s: s["alphabet"].isNotNull(),
    )
    return F.transform(known, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), text_p(s["text"]).alias("p"), noise_p(s["text"], s["alphabet"]).alias("noise")))


def limit_of(p: Column, level: float) -> Column:
    """Benjamini and Hochberg's limit for an array of p-values: those up to it are discoveries; null if there are none."""
    m = F.size(p).cast("double")
    return F.array_max(F.filter(F.transform(F.array_sort(p), lambda x, i: F.when(x <= F.lit(level) * (i + 1) / m, x)), lambda x: x.isNotNull()))


def discoveries(scored: Column) -> Column:
    """The runs of one text that are no text and may be noise, false discoveries controlled for both."""
    text = limit_of(F.transform(scored, lambda s: s["p"]), FDR)
    noise = limit_of(F.transform(scored, lambda s: s["noise"]), ALPHA)
    return F.filter(scored, lambda s: F.coalesce(s["p"] <= text, F.lit(False)) & F.coalesce(s["noise"] > noise, F.lit(True)))


def _lines(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    text = F.col("__text")
    rows = df.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).select(
        id_col, "__text", spans_of(text, ASSIGN, 2, 6).alias("assign"), spans_of(text, ACCESS).alias("access"), spans_of(text, HEX).alias("hex"), spans_of(text, RUN).alias("runs"),
    )
    base = F.concat(_tagged(F.col("assign"), 0), _tagged(F.col("access"), 1), _tagged(F.col("hex"), 2))
    rows = rows.select(id_col, "assign", "access", "hex", F.when(F.size("runs") > 0, scored_runs(F.col("runs"))).alias("scored"), base.alias("base"))
    found = F.when(F.size("scored") > 0, discoveries(F.col("scored")))
    rows = rows.select(id_col, "assign", "access", "hex", found.alias("found"), "base")
    new = F.filter(F.coalesce(_tagged(F.col("found"), 3), F.array()), lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    rows = rows.withColumn("new", new)
    return rows.select(
        id_col, F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_lines(F.col("base")), 256).alias("base_sha256"), _lines(F.concat("base", "new")).alias("spans"), F.size("new").cast("long").alias("n_random"),
    )

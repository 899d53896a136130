"""Derived prompts: the conversations' own texts behind sentences that exercise every operator.

The raw tables hold hardly any filler, modality, code or region. Each message
keeps its whole text (letters beyond ASCII as x, so that word boundaries mean
the same to every regex engine) and gets one of these openings by its numbers.
The same text is built in Spark and, for the SQL twins, in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPENINGS = (
    "Please make sure that you preserve the existing functionality and do not break existing functionality. Run the full test suite afterwards; ",
    "Could you please identify any bugs in order to fix them ,, and just run it. You must never delete at least 3 files and at most 10 logs, optionally exactly 2. As always, be brief. ",
    "# Decision: keep the cache.\nerror: cache miss was the bug. The Agent Manager talks to the Agent Manager daily.\n- note: result (a) is fixed\nsomething else here\n",
    "I would like you to update the documentation, run the tests, preserve all public APIs and do not modify unrelated files. K3; K4, K5 and K6; K7. K1; K99 stays. ",
    "See https://example.com/a/b?x=1 or mail ops@example.com about build_id and camelCase in app.main.run() of v1.2.3 on 2024-05-06T07:08:09Z with MAX_RETRY=5 and 250 ms or \"quoted words\" `code` ",
    "Expand [code:0123456789abcdef 3L] and sk-abcdefghijkl0123 or 123e4567-e89b-12d3-a456-426614174000 in C:\\temp\\x.txt or \\\\host\\share\\f with Bearer abcdefghijklmnop1234 0123456789abcdef0123456789abcdef; ",
    "hi; ",
)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, dealt to all of them before costly work on its texts; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, idx, role, content, has_tool_calls."""
    raw = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    number = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(OPENINGS)))
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (number + 1).cast("int"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "x")
    return raw.select("conv_id", F.col("turn").alias("idx"), "role", F.concat(opening, plain, F.lit(" ")).alias("content"), F.lit(False).alias("has_tool_calls"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def prompts_sql() -> str:
    cases = " ".join(f"WHEN {k} THEN {quoted(o)}" for k, o in enumerate(OPENINGS))
    plain = r"regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g')"
    return f"prompts AS (SELECT conv_id, turn AS idx, role, (CASE (conv_id + turn) % {len(OPENINGS)} {cases} END) || {plain} || ' ' AS content FROM conversations)"


def re2(pattern: str) -> str:
    """A Java pattern's flags for RE2, whose classes are ASCII anyway and where U means something else."""
    for java, other in (("(?Uid)", "(?i)"), ("(?iU)", "(?i)"), ("(?Ui)", "(?i)"), ("(?Us)", "(?s)"), ("(?Ud)", ""), ("(?U)", ""), ("(?dm)", "(?m)")):
        if pattern.startswith(java):
            return other + pattern[len(java) :]
    return pattern


def replace_sql(c: str, rules) -> str:
    """Nested replacements (pattern, replacement) in DuckDB."""
    for pattern, to in rules:
        c = f"regexp_replace({c}, {quoted(re2(pattern))}, {quoted(to.replace('$1', chr(92) + '1'))}, 'g')"
    return c


def tokens_sql(c: str) -> str:
    cjk = f"len(regexp_extract_all({c}, '[一-鿿぀-ヿ가-힯]'))"
    return f"(CASE WHEN length({c}) = 0 THEN 0 ELSE greatest(1, CAST(round_even({cjk} * 1.1::DOUBLE + (length({c}) - {cjk}) / 3.4::DOUBLE, 0) AS BIGINT)) END)::BIGINT"

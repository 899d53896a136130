"""Token counts and the routing of models to tokenizer profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import fixed


def estimate(c: Column) -> Column:
    """The ``claude-est`` counter. Half-even rounding; 0 for empty texts, 1 at least otherwise."""
    cjk = F.when(F.octet_length(c) == F.length(c), F.lit(0)).otherwise(F.regexp_count(c, F.lit(fixed.CJK))).cast("double")
    rest = F.length(c).cast("double") - cjk
    n = F.bround(cjk * F.lit(fixed.TOKENS_PER_CJK) + rest / F.lit(fixed.CHARS_PER_TOKEN)).cast("long")
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), n))


def profile(model: Column) -> Column:
    """struct(name, kind, exact) of the first pattern that the model's name contains, whatever its case."""
    as_struct = lambda name, kind, exact: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(exact).alias("exact"))
    out = as_struct(*fixed.PROFILE_OTHERWISE)
    for pattern, name, kind, exact in reversed(fixed.PROFILES):
        out = F.when(F.coalesce(model, F.lit("")).rlike(f"(?i){pattern}"), as_struct(name, kind, exact)).otherwise(out)
    return out


def profiles(spark: SparkSession) -> DataFrame:
    """The dimension of profiles by rank."""
    rows = [(k, pattern, name, kind, exact) for k, (pattern, name, kind, exact) in enumerate(fixed.PROFILES)]
    return spark.createDataFrame(rows, "rank int, pattern string, name string, kind string, exact boolean")


def _loaded(path: str, kind: str):
    """A function from texts to their sizes in a local vocabulary: ``hf`` (JSON) or ``tiktoken:<pattern>`` (rank file)."""
    name, _, pattern = kind.partition(":")
    if name == "hf":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode(t, disallowed_special=())) for t in texts]


def _caught(path: str, kind: str):
    """``_loaded``, with null for texts that can't be counted, or for all where the vocabulary can't be read."""
    try:
        count = _loaded(path, kind)
    except Exception:  # whatever a library raises for a missing or broken file
        return lambda texts: [None] * len(texts)

    def one(text: str) -> int | None:
        try:
            return count([text])[0]
        except Exception:
            return None

    def sizes(texts: list[str]) -> list[int | None]:
        try:
            return count(texts)
        except Exception:  # one text must not fail the others
            return [one(t) for t in texts]

    return sizes


def vocabulary_counter(files: dict[str, tuple[str, str]]):
    """A pandas UDF (profile, text) for several local vocabularies (profile -> path, kind) in one pass; null for profiles without one, and where counting fails. Each is loaded once per task, when first met."""

    @F.pandas_udf("long")
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        loaded = {}
        for names, texts in batches:
            names, texts, sizes = names.tolist(), texts.tolist(), [None] * len(texts)
            for name in files.keys() & set(names):
                if name not in loaded:
                    loaded[name] = _caught(*files[name])
                rows = [i for i, n in enumerate(names) if n == name]
                for i, size in zip(rows, loaded[name]([texts[i] or "" for i in rows]), strict=True):
                    sizes[i] = size
            yield pd.Series(sizes, dtype="Int64")

    return count


def counted(df: DataFrame, column: str, model: str, files: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Adds profile, tokens and exact: each text's size for the model of its row.

    ``files`` names the vocabularies at hand. Rows of other profiles are
    estimated and say so (``exact`` false); without files no Python runs.
    """
    rows = df.withColumn("profile", profile(F.col(model))["name"])
    known = [n for n, (_, _, kind, _) in _by_name().items() if kind != "estimate" and n in (files or {})]
    if not known:
        return rows.withColumns({"tokens": estimate(F.col(column)), "exact": F.lit(False)})
    there = F.col("profile").isin(*known)
    rows = rows.withColumn("__size", vocabulary_counter({n: files[n] for n in known})(F.col("profile"), F.when(there, F.col(column))))
    return rows.withColumns({"tokens": F.when(there, F.col("__size")).otherwise(estimate(F.col(column))), "exact": there}).drop("__size")


def sized(files: dict[str, tuple[str, str]]) -> Callable[[Column], Column]:
    """A counter for whole plans: the size of a text for the ``profile`` of its row, exact where ``files`` has its vocabulary, else the estimate."""
    known = [n for n, (_, _, kind, _) in _by_name().items() if kind != "estimate" and n in files]
    if not known:
        return estimate
    exact = vocabulary_counter({n: files[n] for n in known})
    there = F.col("profile").isin(*known)
    return lambda c: F.when(c.isNull(), F.lit(None).cast("long")).when(there, exact(F.col("profile"), c)).otherwise(estimate(c))


def _by_name() -> dict[str, tuple]:
    return {p[1]: p for p in fixed.PROFILES}

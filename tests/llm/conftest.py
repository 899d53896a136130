import pytest

#: Columns with names that operators use inside.
CLASHING = ("id", "hash", "bin", "size", "component", "bucket", "kept", "fingerprint", "pattern", "__text")
LONG = "wort " * 40_000


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, clashing names."""
    texts = ["The quick brown fox jumps over the lazy dog again and again", "the QUICK brown fox jumps over the lazy dog again and again", "", None, " \n\t", LONG, "one", "one", "ÄÖ ß é", "%%% 123 ###", "password = hunter22x and token: abc"]
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None][i % 3]) for i, t in enumerate(texts)]
    rows.append(rows[6])  # the same row again
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASHING:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("other"))
    return df.cache()

"""Every query against its SQL twin on the smallest tables, and no twin is vacuous."""

import os

import duckdb
import pytest

from palimpsest import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple("null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, twin, name):
    got, want = rows(catalog.queries()[name](spark, SF).toPandas()), rows(twin.execute(catalog.oracle_sql()[name]).df())
    assert got == want and got[1]


def test_openings_change_texts(spark):
    for name, column in (("h04_compress", "out"), ("a03_substitute", "out")):
        plain = {(r["conv_id"], r["idx"]): r["out"] for r in catalog.queries()["h03_tighten"](spark, SF).collect()}
        changed = sum(plain[r["conv_id"], r["idx"]] != r[column] for r in catalog.queries()[name](spark, SF).collect())
        assert changed > 20

"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v) -> str | None:
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):  # a column with nulls may come as either
        return str(int(v)) if v.is_integer() else repr(float(v))
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(text(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=lambda r: tuple(x or "" for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF_DIR).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["rule_id", "severity", "reason", "n"]
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

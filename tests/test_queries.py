"""Every query against its oracle on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from statuta.plans import files_registry, registry  # noqa: F401  (adds its queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def shown(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([shown(x) for x in v])
    if not isinstance(v, str) and pd.isna(v):
        return "null"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    return v if isinstance(v, str) else repr(round(float(v), 6))


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(shown, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.oracle_sql():
        assert rows(got) == rows(duck.sql(registry.oracle_sql()[name]).df())

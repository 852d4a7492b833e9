"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from shapeforge.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    return str(v).replace(" 00:00:00", "")


def rows(df):
    return sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)
    spark.catalog.clearCache()

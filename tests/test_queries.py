import glob
import os

import duckdb
import pytest

from granary.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return connection


def plain(df):
    rows = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted(df.columns), sorted([tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else v if v is None else str(v) for v in r) for r in rows.itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    got, want = plain(registry.queries()[name](spark, DATA).toPandas()), plain(oracle.execute(registry.oracle_sql()[name]).df())
    assert got[0] == want[0] and got[1] == want[1]


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())

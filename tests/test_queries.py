"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from foliospark.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted([repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r] for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toArrow()
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name]).to_arrow_table()
        assert {f.name: str(f.type).removeprefix("large_") for f in got.schema} == {f.name: str(f.type).removeprefix("large_") for f in want.schema}
        assert rows_of(got.to_pandas()) == rows_of(want.to_pandas())
    else:
        assert got.num_rows > 0

"""Every registered query with SQL, side by side on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from concord.plans import load_all
from tools.compare import TABLES, normal

SF = os.environ.get("CONCORD_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    res = con.execute(ORACLES[name])
    want = pd.DataFrame(res.fetchall(), columns=[d[0] for d in res.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

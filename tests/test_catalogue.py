"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from resona.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    assert rows
    if name not in catalogue.ORACLE_SQL:
        return
    oracle.execute(catalogue.ORACLE_SQL[name])
    got = [d[0] for d in oracle.description]
    assert sorted(got) == columns
    at = [got.index(c) for c in columns]
    assert rows == sorted(repr(tuple(_plain(r[i]) for i in at)) for r in oracle.fetchall())

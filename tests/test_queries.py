"""Every query with SQL gives the same rows in DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from lodewell.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(str(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in data])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    df = registry.QUERIES[name](spark, SF)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())

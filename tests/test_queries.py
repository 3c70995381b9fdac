"""Every registered query of the library's own operators against its SQL."""

import os

import duckdb
import pytest

from wardlight.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", list(catalog.queries()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df = catalog.queries()[name](spark, SF)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    assert got == sorted(map(repr, want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())) and got


def test_plans_stay_native(spark):
    for name, query in catalog.queries().items():
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "CartesianProduct", "BroadcastNestedLoop")), name

"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the rest run."""

import math
import os

import pytest

from visiloom.plans import catalog

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(rows):
    def one(v):
        return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(tuple(r[i] for i in order) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 1


def test_no_python_in_scoring(spark):
    """Objective scores stay inside built-in expressions, without a shuffle but for the sources' rows."""
    plan = catalog.QUERIES["objective_scores"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

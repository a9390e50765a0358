"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fieldscan import registry
from fieldscan.plans import folds, rings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    clean = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    ours, theirs = plain(df.collect(), df.columns, columns), plain(rel.fetchall(), list(rel.columns), columns)
    assert len(ours) == len(theirs)
    differing = [(a, b) for a, b in zip(ours, theirs, strict=True) if not same(a, b)]
    assert not differing, differing[:3]


def same(a, b):
    return all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-4 for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans_stay_native(spark):
    """No Python and no product joins in operators without feedback, but for distances along lines of cells and hulls."""
    for name, (query, sql) in registry.ALL.items():
        if sql is None or name in folds.QUERIES or name in rings.QUERIES or name in ("g18_distance", "g19_distance_3d", "a19_convex_hull"):
            continue
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name

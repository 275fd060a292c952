"""Every query that SQL can express, against DuckDB on the same tables."""

import pytest

from ratewatch.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    found = queries()[name](spark, SF)
    wanted = duck.sql(oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    got, want = rows(found.columns, found.collect()), rows(wanted.columns, wanted.fetchall())
    assert len(want) > 0
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0

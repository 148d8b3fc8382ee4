"""Every registered query of the engine against its oracle, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerfold.plans import queries_more, queries_path  # noqa: F401  (register their queries)
from ledgerfold.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, oracle, name):
    got = QUERIES[name](spark, sf_dir)
    want = oracle.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    text = lambda rows: sorted([str(x) for x in r] for r in rows)
    assert text([[r[c] for c in columns] for r in got.collect()]) == text([[r[i] for i in at] for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())

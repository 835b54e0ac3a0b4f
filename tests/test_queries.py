"""Every registered query with an oracle agrees with its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from trialweave import queries

TABLES = "region nation customer supplier part orders lineitem events documents labels embeddings conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in (r[i] for i in order)]) for r in data)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    rel = con.sql(queries.ORACLE[name])
    want = rows(list(rel.columns), rel.fetchall())
    assert got[0] == want[0]
    if got[1] != want[1]:  # a last digit may differ
        assert len(got[1]) == len(want[1])
        import ast

        for a, b in zip(got[1], want[1], strict=True):
            assert ast.literal_eval(a) == pytest.approx(ast.literal_eval(b), abs=2e-6)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "time" in df.columns


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(queries.QUERIES) > 60

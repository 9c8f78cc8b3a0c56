"""Every core query against its SQL at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest

from lamina.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 4)
        return x

    return sorted(tuple(str(plain(r[i])) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    ours = catalog.queries()[name](spark, FOLDER)
    theirs = duck.sql(catalog.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert comparable(ours.columns, [tuple(r) for r in ours.collect()]) == comparable(theirs.columns, theirs.fetchall())

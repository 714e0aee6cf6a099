"""Every query against its SQL on the smallest test tables."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from trisettle.plans import accuracy, registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows_of(rows, names):
    place = [names.index(c) for c in sorted(names)]
    return sorted(repr(tuple(plain(r[i]) for i in place)) for r in rows)


#: Queries without SQL over the corpus are restated in test_accuracy, on one run of the cascade.
TRIED = sorted(set(registry.QUERIES) - (set(accuracy.QUERIES) - set(registry.ORACLE_SQL)))


@pytest.mark.parametrize("name", TRIED)
def test_query_equals_its_sql(spark, duck, name):
    frame = registry.QUERIES[name](spark, DIR)
    got = rows_of([tuple(r) for r in frame.collect()], frame.columns)
    if name in registry.ORACLE_SQL:
        result = duck.execute(registry.ORACLE_SQL[name])
        assert got == rows_of(result.fetchall(), [d[0] for d in result.description])

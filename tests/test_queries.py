"""Each query with an oracle against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, (float, decimal.Decimal)):
            return round(float(x), 6)
        return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "entity", "score", "rank_percentile"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    found = oracle.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == plain(found.fetchall(), columns)

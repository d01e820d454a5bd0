"""Every registered query against its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.test_plans import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def tidy(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    values = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(values, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = tidy(df.columns, df.collect())
    if name in ORACLE:
        cursor = db.execute(ORACLE[name])
        assert got == tidy([d[0] for d in cursor.description], cursor.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    assert entry_points.entry(spark).count() == 25


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)

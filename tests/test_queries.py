"""Every registered query of the profiling library against its SQL in DuckDB; those without SQL give rows."""

import math
from decimal import Decimal

import duckdb
import pytest

from gradus.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return ("number", "nan" if math.isnan(value) else round(float(value), 6) + 0.0)
    if isinstance(value, int) and not isinstance(value, bool):
        return ("number", float(value))
    return (type(value).__name__, str(value))


def canonical(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    found = canonical(df.collect(), df.columns)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert found == canonical(result.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0

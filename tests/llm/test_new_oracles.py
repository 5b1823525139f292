"""Operators whose contracts SQL can express, against their SQL in DuckDB."""

import duckdb
import pytest

from gradus.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op11_merkle", "op12_dialogue_repair", "op13_vector_dedup"])
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    df = QUERIES[name](spark, data)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect()), key=str) == sorted(result.fetchall(), key=str)

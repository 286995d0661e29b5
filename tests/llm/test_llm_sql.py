"""The operators' queries against their DuckDB SQL, over whole tables."""

import duckdb
import pytest

from textloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})")
    want = sorted(cursor.fetchall(), key=repr)
    assert want and sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == want

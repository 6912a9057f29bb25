"""Registered queries with a DuckDB form against it, on the smallest driver data."""

import os

import duckdb
import pytest

from demandlens.llm import registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver data not present")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(llm, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    expected = sorted(map(str, cur.fetchall()))
    df = registry.queries()[name](llm, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"op12_embedding_whitening"}))
def test_one_row_per_input_row(llm, name):
    df = registry.queries()[name](llm, SMALL)
    table, key = ("pages", "page_id") if name.startswith("op9") else ("documents", "doc_id")
    ids = duckdb.sql(f"SELECT {key} FROM '{SMALL}/{table}.parquet'").fetchall()
    assert sorted(r[0] for r in df.select(key).collect()) == sorted(i[0] for i in ids)


def test_components_of_every_vector(llm):
    rows = registry.queries()["op12_embedding_whitening"](llm, SMALL).select("vec_id", "component").collect()
    ids = duckdb.sql(f"SELECT vec_id FROM '{SMALL}/embeddings.parquet'").fetchall()
    assert sorted(map(tuple, rows)) == sorted((i, k) for i, in ids for k in range(1, 33))

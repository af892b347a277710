"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from hourloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    ours = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    assert ours == sorted(map(str, cursor.fetchall()))


def test_every_operator_has_a_query():
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1


def test_op8_contract(spark):
    rows = queries.QUERIES["op8_sharding"](spark, SF).collect()
    size = [0] * 40
    for r in rows:
        size[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert max(size) - min(size) <= 2 * max(r.size for r in rows)


def test_op6_and_op9_cover_every_row(spark):
    for name, table, key in (("op6_embedding_dedup", "embeddings", "vec_id"), ("op9_near_dedup", "documents", "doc_id")):
        ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
        assert sorted(r[key] for r in queries.QUERIES[name](spark, SF).collect()) == ids

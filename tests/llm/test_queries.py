"""Registered corpus queries against their DuckDB SQL on whole tables."""
import duckdb
import pytest

import __spark_entry__ as E
from propcube.llm import queries as Q
from tests.test_oracle import _rows

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator_and_the_pipeline():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries()


@pytest.mark.parametrize("key", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.queries()[key](spark, SF)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(Q.oracle_sql()[key])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert _rows(df.columns, got) == _rows(cols, res.fetchall())

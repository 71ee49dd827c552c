"""Queries against their SQL over the small tables, and that each operator is there."""

import duckdb
import pytest

from gridspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "conversations", "pages", "embeddings")


def test_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want.select(*columns).fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = QUERIES[name](spark, SF).count()
    assert got == n or name == "op10_span_dedup" and 0 < got < n

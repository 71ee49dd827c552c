"""Every query of the workbook view against its SQL, and with one shuffle partition."""

import json
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gridspark.plans import bookview, oddview, queries
from gridspark.sinks.json_files import STAGED
from gridspark.sources.tables import shared_folder

QUERIES, ORACLES = queries.QUERIES | bookview.QUERIES | oddview.QUERIES, queries.ORACLES | bookview.ORACLES | oddview.ORACLES
SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "documents")


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(str(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(ORACLES[name])
    columns, got = rows(QUERIES[name](spark, SF))
    assert columns == sorted(want.columns)
    assert got == sorted(str(r) for r in want.select(*columns).fetchall()) and got


@pytest.mark.parametrize("name", ["graph_nodes", "unsupported_items", "run_index_merge"])
def test_partitioning_does_not_matter(spark, name):
    want = rows(QUERIES[name](spark, SF))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(QUERIES[name](spark, SF)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_content_types_beyond_the_first_workbook(spark, tmp_path):
    """Parts whose keys lie in a second and third workbook of the view have default types too."""
    db = duckdb.connect()
    db.sql(f"copy (select * replace (p_partkey + k * 1000000 as p_partkey) from '{SF}/part.parquet', range(3) r(k)) to '{tmp_path}/part.parquet' (format parquet)")
    db.sql(f"create view part as select * from '{tmp_path}/part.parquet'")
    want = db.sql(ORACLES["content_types"])
    columns, got = rows(QUERIES["content_types"](spark, str(tmp_path)))
    assert got == sorted(str(r) for r in want.select(*columns).fetchall()) and got


def test_artifacts_take_little_disk(spark):
    """The staged files are a small part of their text, and no text of a file is shuffled when they are read back."""
    folders = lambda: set(Path(shared_folder(spark)).glob("artifacts-*"))
    before = folders()
    told = QUERIES["workbook_artifacts"](spark, SF)
    (made,) = folders() - before
    files = json.loads((made / STAGED).read_text())
    assert len(files) == 5 * told.count() and sum(os.path.getsize(f["staged"]) for f in files) * 10 < sum(f["bytes"] for f in files)
    assert "binaryFile" not in told._jdf.queryExecution().toString()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())

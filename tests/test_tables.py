"""Tables written for the length of a job."""

import os
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

from gridspark.plans import pipeline
from gridspark.sources.tables import temporary_tables, written
from tests.workbooks import three_sheets


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_interleaved_jobs_keep_their_tables(spark):
    a, b = temporary_tables(spark), temporary_tables(spark)
    a.__enter__()
    first = written(spark.range(3))
    gone = folder(first)
    b.__enter__()
    second = written(spark.range(5))
    a.__exit__(None, None, None)
    assert not os.path.exists(gone)
    third = written(spark.range(7))
    place = folder(second), folder(third)
    assert (second.count(), third.count()) == (5, 7)
    b.__exit__(None, None, None)
    assert not any(map(os.path.exists, place))
    outside = written(spark.range(2))
    with temporary_tables(spark):
        pass
    assert outside.count() == 2


def test_nested_jobs(spark):
    with temporary_tables(spark):
        outer = written(spark.range(4))
        with temporary_tables(spark):
            inner = folder(written(spark.range(4)))
        assert not os.path.exists(inner) and outer.count() == 4
        place = folder(outer)
    assert not os.path.exists(place)


def test_two_threads(spark):
    together, over = Barrier(2), Barrier(2)

    def job(n):
        with temporary_tables(spark):
            together.wait(60)
            table = written(spark.range(n))
            if n == 10:
                over.wait(60)  # the other job is over and has deleted what it wrote
                return table.count()
        over.wait(60)
        return n

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(job, (10, 20))) == [10, 20]


def test_view_tasks_are_no_larger_for_a_longer_table(spark, tmp_path, monkeypatch):
    """The rows of a table's view are dealt to as many tasks as they need, beyond the cores."""
    from gridspark.plans import tableview

    monkeypatch.setattr(tableview, "TASK_ROWS", 100, raising=False)
    spark.range(4000).selectExpr("id as s_suppkey", "string(id) as s_name", "int(id % 25) as s_nationkey", "double(id) as s_acctbal").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    rows = tableview.sheet_cells(spark, str(tmp_path), 3).where("row > 1").rdd.mapPartitions(lambda p: [len({r.row for r in p})]).collect()
    assert sum(rows) == 4000 and max(rows) <= 250


def test_cells_are_dealt_by_rows_however_few_bytes_they_take(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "FILE_ROWS", 2)
    cells = pipeline.decompose(spark, str(three_sheets(tmp_path / "book.xlsx"))).inventory.cells
    held = [r["count"] for r in cells.groupBy("_metadata.file_path").count().collect()]
    assert sum(held) == cells.count() > 4 and max(held) <= 2

"""The data source of package parts: what is planned, pruned and never unzipped."""

import zipfile

import pytest

from gridspark.sources.ooxml_source import DIRECTORY, register
from tests.test_reader import changed
from tests.workbooks import three_sheets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    register(spark)
    home = tmp_path_factory.mktemp("source")
    good = three_sheets(home / "a.xlsx")
    (home / "deep").mkdir()
    changed(good, home / "deep" / "B.XLSM", add={"xl/media/image1.png": "png"})
    data = bytearray((home / "deep" / "B.XLSM").read_bytes())
    with zipfile.ZipFile(home / "deep" / "B.XLSM") as z:
        for name in ("xl/worksheets/sheet2.xml", "xl/media/image1.png"):
            at = z.getinfo(name)
            data[at.header_offset + 30 + len(name) + 1] ^= 0xFF  # the checksum fails whoever unzips it
    (home / "deep" / "B.XLSM").write_bytes(data)
    (home / "broken.xlsx").write_bytes(b"no zip")
    (home / "note.txt").write_text("not a workbook")
    return str(home)


def test_parts(spark, folder):
    rows = spark.read.format("ooxml").load(folder).collect()
    errors = sorted((r.path.rpartition("/")[2], r.name) for r in rows if r.error)
    assert errors == [("B.XLSM", "xl/worksheets/sheet2.xml"), ("broken.xlsx", None)]
    assert {r.name for r in rows if r.xml is not None and r.path.endswith("a.xlsx")} == {r.name for r in rows if r.path.endswith("a.xlsx")} - {"xl/drawings/legacy1.vml"}


def test_filters_on_names_reach_the_reader(spark, folder):
    df = spark.read.format("ooxml").load(f"file://{folder}")
    for where, names in (
        ("name = 'xl/workbook.xml'", {"xl/workbook.xml"}), ("name in ('xl/workbook.xml', 'none')", {"xl/workbook.xml"}), ("startswith(name, 'xl/tables') and endswith(name, '.xml')", {"xl/tables/table1.xml"}),
        ("contains(name, 'sheet3') and size > 10", {"xl/worksheets/sheet3.xml"}),
    ):
        rows = df.where(where).collect()
        assert {r.name for r in rows} == names and len(rows) == 2 and not any(r.error for r in rows), where
    plan = df.where("name = 'xl/workbook.xml'")._jdf.queryExecution().toString()
    assert "name" in plan.split("PushedFilters")[-1][:200] if "PushedFilters" in plan else "Filter (isnotnull(name" not in plan.split("== Physical Plan ==")[-1]


def test_directories_are_read_without_unzipping(spark, folder):
    rows = spark.read.format("ooxml").schema(DIRECTORY).load(folder).collect()
    assert [r.name for r in rows if r.error] == [None]  # the damaged parts aren't looked into
    assert {r.name: r.size for r in rows if r.path.endswith("B.XLSM")}["xl/media/image1.png"] == 3


def test_large_parts_come_in_pieces_and_bounds_hold(spark, folder):
    one = spark.read.format("ooxml").option("maxPartBytes", 10).load(f"{folder}/a.xlsx")
    assert {r.error for r in one.where("name = 'xl/workbook.xml'").collect()} == {None, "larger than 10 bytes"}
    with pytest.raises(Exception, match="FileNotFound|PYTHON_DATA_SOURCE"):
        spark.read.format("ooxml").load(f"{folder}/missing").collect()

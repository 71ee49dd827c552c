"""The three-sheet workbook, end to end, against counts worked out by hand (FIXTURES.md)."""

import json
import re
from pathlib import Path

import pytest

from gridspark.contracts import FRAMES, schema_of, schemas_json
from gridspark.operators.inventory import inventory_of
from gridspark.plans.pipeline import decompose
from gridspark.sinks.store import frames_of
from gridspark.sources.ooxml import read_workbooks
from tests.workbooks import formula, number, package, sheet, text, three_sheets


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    return decompose(spark, str(three_sheets(tmp_path_factory.mktemp("books") / "book.xlsx")))


def rows(df, *columns, order=None):
    return [tuple(r) for r in df.orderBy(*(order or columns)).select(*columns).collect()]


def test_manifest_and_sheets(done):
    (m,) = done.inventory.manifest.collect()
    assert (m.file_name, m.is_macro_enabled, m.named_ranges_count, m.calc_mode) == ("book.xlsx", False, 1, "auto")
    assert rows(done.inventory.sheets, "sheet_index", "sheet_name", "state", "max_row", "max_column") == [(0, "Inputs", "visible", 8, 5), (1, "Outputs", "visible", 2, 2), (2, "HiddenData", "hidden", 1, 1)]


def test_frames_have_their_contracts(done):
    frames = frames_of(done)
    assert set(frames) == set(FRAMES) == set(json.loads(schemas_json())["frames"])
    for name, frame in frames.items():
        assert [(f.name, f.dataType.simpleString()) for f in frame.schema] == [(f.name, f.dataType.simpleString()) for f in schema_of(name)], name


def test_parts_and_content_types(done):
    kinds = {r.name: (r.content_type, r.opaque) for r in done.inventory.parts.collect()}
    assert kinds["xl/workbook.xml"] == ("application/workbook", False)
    assert kinds["xl/styles.xml"] == ("application/xml", False)
    assert kinds["xl/drawings/legacy1.vml"] == ("", True)


def test_cells(done):
    cells = {r.loc.object_id: r for r in done.inventory.cells.collect()}
    assert len(cells) == 15
    assert (cells["Inputs!A1"].value, cells["Inputs!A1"].data_type) == ("Assumption rate", "s")
    assert (cells["Inputs!B1"].value, cells["Inputs!B1"].value_type, cells["Inputs!B1"].number_format) == ("0.05", "double", "0.00%")
    assert (cells["Inputs!C2"].kind, cells["Inputs!C2"].value, cells["Inputs!C2"].formula) == ("formula", None, "=B1*B2")
    assert (cells["HiddenData!A1"].value_type, cells["HiddenData!A1"].row, cells["HiddenData!A1"].column) == ("long", 1, 1)


def test_ranges(done):
    found = {(r.scope, r.kind, r.address) for r in done.inventory.ranges.collect()}
    assert found == {
        ("sheet_range", "merged_range", "A5:B5"), ("sheet_range", "table", "A7:B8"), ("layout", "row_layout", "3"), ("layout", "column_layout", "D"), ("layout", "freeze_panes", "B2"),
        ("layout", "data_validation", "B1"), ("layout", "conditional_formatting", "B1:B2"), ("layout", "comment", "A3"), ("layout", "hyperlink", "A4"), ("workbook", "defined_name", "$B$2"),
    }
    by_kind = {r.kind: r for r in done.inventory.ranges.collect()}
    assert by_kind["comment"].metadata == {"text": "review me", "author": "tester"}
    assert by_kind["hyperlink"].metadata["target"] == "https://example.com"
    assert by_kind["data_validation"].metadata == {"type": "decimal", "formula1": "0", "formula2": "1"}
    assert (by_kind["defined_name"].sheet_name, by_kind["defined_name"].sheet_index, by_kind["defined_name"].name) == ("Inputs", 0, "PremiumCell")


def test_graph(done):
    edges = sorted((r.source, r.target) for r in done.graph.edges.collect())
    assert edges == sorted([
        ("cell:Inputs!C2", "cell:Inputs!B1"), ("cell:Inputs!C2", "cell:Inputs!B2"), ("cell:Inputs!D2", "cell:Outputs!B2"), ("cell:Inputs!D2", "cell:Inputs!C2"),
        ("cell:Inputs!E2", "range:Inputs!B1:B2"), ("cell:Outputs!B2", "cell:Inputs!C2"),
    ])
    nodes = {r.id: r for r in done.graph.nodes.collect()}
    assert len(nodes) == 7
    assert nodes["cell:Outputs!B2"].loc.sheet_index is None  # seen first as a target
    assert nodes["cell:Inputs!C2"].loc.sheet_index == 0
    assert done.graph.unsupported.count() == 0


def test_classes_questions_coverage(done):
    counts = {r.category: r["count"] for r in done.items.groupBy("category").count().collect()}
    assert counts == {"formula_block": 4, "input": 5, "presentation": 12, "data_table": 1, "other": 3, "unsupported_opaque": 1}
    hinted = {r.id: r.hints for r in done.items.where("size(hints) > 0").collect()}
    assert hinted == {"cell:Inputs!A1": ["assumption", "rate_table"], "cell:Inputs!A2": ["cashflow"], "cell:Inputs!A8": ["cashflow"], "cell:Inputs!D2": ["output"], "cell:Outputs!A1": ["output"]}
    assert done.questions.count() == 21
    assert done.questions.where("question_type = 'unsupported_feature_review'").count() == 1
    assert [tuple(r)[1:] for r in done.coverage.collect()] == [(25, 1, 26)]
    seqs = [tuple(r.seq) for r in done.items.collect()]
    assert len(set(seqs)) == len(seqs)


def test_many_files_in_one_job(spark, tmp_path: Path):
    three_sheets(tmp_path / "a.xlsx")
    (tmp_path / "legacy.xls").write_bytes(b"not a workbook")
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip either")
    package(tmp_path / "empty.xlsx", [("Only", "visible", sheet({}))], calc="")
    got = decompose(spark, [str(tmp_path / n) for n in ("a.xlsx", "legacy.xls", "broken.xlsx", "empty.xlsx")])
    names = {r.sha256: r.file_name for r in got.inventory.manifest.collect()}
    assert {r.file_name: r.calc_mode for r in got.inventory.manifest.collect()} == {"a.xlsx": "auto", "legacy.xls": None, "broken.xlsx": None, "empty.xlsx": "auto"}
    kinds = {(names[r.sha256], r.feature_type, r.severity) for r in got.inventory.unsupported.collect()}
    assert kinds == {("a.xlsx", "drawing", "warning"), ("legacy.xls", "file_type", "error"), ("broken.xlsx", "corrupt_package", "error")}
    items = {names[r.sha256]: r["count"] for r in got.items.groupBy("sha256").count().collect()}
    assert items == {"a.xlsx": 26, "legacy.xls": 1, "broken.xlsx": 1, "empty.xlsx": 1}
    assert [(r.id, r.confidence) for r in got.items.where("id = 'workbook:empty'").collect()] == [("workbook:empty", 0.1)]


def test_equal_files_are_one_workbook(spark, tmp_path: Path):
    first = three_sheets(tmp_path / "b.xlsx")
    for copy in ("a.xls", "c.xlsx", "d.xlsm"):
        (tmp_path / copy).write_bytes(first.read_bytes())
    (tmp_path / "e.txt").write_bytes(b"neither")
    (tmp_path / "f.txt").write_bytes(b"neither")
    got = decompose(spark, str(tmp_path))
    listed = {r.file_name: [p.rpartition("/")[2] for p in r.other_paths] for r in got.inventory.manifest.collect()}
    assert listed == {"b.xlsx": ["a.xls", "c.xlsx", "d.xlsm"], "e.txt": ["f.txt"]}
    assert (got.inventory.cells.count(), got.inventory.sheets.count(), got.graph.edges.count()) == (15, 3, 6)
    assert rows(got.inventory.sheets, "sheet_index", "sheet_name") == [(0, "Inputs"), (1, "Outputs"), (2, "HiddenData")]
    assert got.items.count() == 26 + 1
    assert got.inventory.parts.count() == got.inventory.parts.select("name").distinct().count()


def test_a_folder_that_grows_is_read_anew(spark, tmp_path: Path):
    three_sheets(tmp_path / "a.xlsx")
    assert decompose(spark, str(tmp_path)).inventory.unsupported.count() == 1
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    kinds = sorted(r.feature_type for r in decompose(spark, str(tmp_path)).inventory.unsupported.collect())
    assert kinds == ["corrupt_package", "drawing"]
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0


def test_values_formulas_and_names(spark, tmp_path: Path):
    xml = sheet({
        1: [number("A1", 45292, 2), number("B1", 45292.5, 2), '<c r="C1" t="b"><v>1</v></c>', '<c r="D1" t="e"><v>#DIV/0!</v></c>', text("E1", "=typed"), number("F1", "1.5E3", 3)],
        2: [formula("A2", "B2+$C$1+Other!D5", ' t="shared" ref="A2:A4" si="0"'), '<c r="B2" t="str"><f>TEXT(1,"A1")</f><v>x</v></c>'],
        4: ['<c r="A4"><f t="shared" si="0"/></c>', formula("XFD4", "SUM(A:A)")],
    }, after='<sheetProtection sheet="1"/>')
    names = "<definedName name=\"Two\">S!$A$1:$B$2,'O''x'!C3</definedName><definedName name=\"Const\">42</definedName><definedName name=\"Own\" localSheetId=\"0\">S!$A$1</definedName>"
    got = decompose(spark, str(package(tmp_path / "b.xlsm", [("S", "visible", xml)], names, formats=(0, 10, 14, 164))))
    cells = {r.address: r for r in got.inventory.cells.collect()}
    assert (cells["A1"].value, cells["A1"].data_type) == ("2024-01-01 00:00:00", "d")
    assert cells["B1"].value == "2024-01-01 12:00:00"
    assert (cells["C1"].value, cells["C1"].value_type) == ("true", "boolean")
    assert (cells["D1"].value, cells["D1"].data_type) == ("#DIV/0!", "e")
    assert (cells["E1"].kind, cells["E1"].formula) == ("formula", "=typed")
    assert (cells["F1"].value_type, cells["F1"].number_format) == ("double", '0.000"d"')
    assert cells["A4"].formula == "=B4+$C$1+Other!D7"
    assert (cells["XFD4"].column, cells["XFD4"].formula) == (16384, "=SUM(A:A)")
    assert [(r.description, r.opaque) for r in got.graph.unsupported.orderBy("seq").collect()] == [("No references parsed from formula '=typed'", False), ("No references parsed from formula '=SUM(A:A)'", False)]
    rs = got.inventory.ranges
    assert rows(rs.where("kind = 'defined_name'"), "name", "sheet_name", "sheet_index", "address") == [("Const", None, None, "42"), ("Two", "O'x", None, "C3"), ("Two", "S", 0, "$A$1:$B$2")]
    protection = rs.where("kind = 'sheet_protection'").collect()[0]
    assert (protection.address, protection.loc.address) == ("sheet", None)
    assert got.inventory.manifest.collect()[0].is_macro_enabled


def test_only_cells_that_show_a_string_meet_the_strings_and_formulas_are_read_once(spark, tmp_path):
    """Of the written cells each that isn't of strings stays where it is, and items read the graph's formulas one time."""
    files = read_workbooks(spark, str(three_sheets(tmp_path / "book.xlsx")))
    lines = inventory_of(files).cells._jdf.queryExecution().optimizedPlan().toString().split("\n")
    (at,) = [i for i, line in enumerate(lines) if re.search(r"Join LeftOuter, .*\(v#\d+ = v#\d+\)", line)]
    assert any(re.search(r"Filter .*\(t#\d+ = s\)", line) for line in lines[at + 1 : at + 3])
    items = decompose(spark, str(tmp_path / "book.xlsx")).items
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Generate explode", plan)) == 1

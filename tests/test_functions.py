import json
import re

import pytest

from gridspark.contracts import FRAMES, SCHEMA_VERSION, schemas_json
from gridspark.functions import formula as f
from gridspark.functions.text import column_letters, hints, location, python_repr
from gridspark.operators import package
from gridspark.operators.coverage import bound_problem, confidence_problem, location_problem
from gridspark.operators.inventory import date_text, destinations, is_date_format
from gridspark.functions.lexer import column_of, moved
from gridspark.sources.ooxml import CELL_ADDRESS, column_number
from tests.test_lexer import letters as column_name

#: (formula, references, external), from FIXTURES.md.
FORMULAS = [
    ("=B1*B2", ["S!B1", "S!B2"], False), ("=LOG10(A1)", ["S!LOG10", "S!A1"], False), ("=ATAN2(A1,B1)", ["S!TAN2", "S!A1", "S!B1"], False), ("='My Sheet'!$A$1:$B$9", ["My Sheet!A1:B9"], False),
    ("='It''s'!A1", ["s!A1"], False), ("=[Book.xlsx]Sheet1!A1", ["Sheet1!A1"], True), ("='[Book.xlsx]S 1'!A1", ["[Book.xlsx]S 1!A1"], True), ("=SUM(A:A)", [], False), ("=Table1[Col]", [], True),
    ("=TABLE1[Col]", ["S!BLE1"], True), ("=PremiumCell*2", [], False), ("=1+2", [], False), ("=A1+A1", ["S!A1", "S!A1"], False), ('=IF(A1="Q1",1,2)', ["S!A1", "S!Q1"], False),
    ("=SUM(SHEET1:SHEET3!A1)", ["S!EET1", "SHEET3!A1"], False), ("=A1 Sheet2!B1", ["A1 Sheet2!B1"], False), ("=ABCD12", ["S!BCD12"], False), ("=Blattü1!A1", ["Blattü1!A1"], False),
    ("=Über!A1", ["ber!A1"], False), ("=''!A1", ["S!A1"], False),
]


def test_references(spark):
    table = spark.createDataFrame([(i, x[0]) for i, x in enumerate(FORMULAS)], "i int, formula string")
    refs = f.F.transform(f.references(f.F.col("formula"), f.F.lit("S")), lambda r: f.label(r["sheet"], r["ref"]))
    got = {r.i: (r.refs, r.external) for r in table.select("i", refs.alias("refs"), f.is_external(f.F.col("formula")).alias("external")).collect()}
    assert got == {i: (refs, external) for i, (_, refs, external) in enumerate(FORMULAS)}


def test_column_letters(spark):
    numbers = [1, 26, 27, 52, 53, 702, 703, 704, 728, 729, 16384]
    got = spark.createDataFrame([(n,) for n in numbers], "n int").select("n", column_letters(f.F.col("n")).alias("a")).select("n", "a", column_of(f.F.col("a")).alias("back")).collect()
    assert [(r.a, r.back) for r in got] == [(column_name(n), n) for n in numbers]
    assert column_name(16384) == "XFD"


def test_python_repr(spark):
    texts = ["=A", "=\"x\"", "='x'!a", "='x'&\"y\"", "a\\b\n\t\r"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(python_repr(f.F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == [repr(t) for t in texts]


def test_hints(spark):
    texts = ["Mortality and LAPSE table", "generate", "cash flow", "Cashflow", "duration of result", "none", "", None, "expense output premium projection rate"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(hints(f.F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [["assumption", "rate_table"], ["rate_table"], ["cashflow"], ["cashflow"], ["projection", "output"], [], [], [], ["assumption", "rate_table", "cashflow", "projection", "output"]]


def test_dates(spark):
    formats = {"General": False, "0.00%": False, "yyyy-mm-dd": True, "[h]:mm": True, '0.0"d"': False, "[Red]0.0": False, "mmm-yy": True, "#,##0_);[Red](#,##0)": False, "0.00E+00": False, "@": False}
    got = spark.createDataFrame([(x,) for x in formats], "x string").select("x", is_date_format(f.F.col("x")).alias("d")).collect()
    assert {r.x: r.d for r in got} == formats
    serials = [(1.0, False, "1900-01-01 00:00:00"), (59.0, False, "1900-02-28 00:00:00"), (61.0, False, "1900-03-01 00:00:00"), (45292.25, False, "2024-01-01 06:00:00"), (0.0, True, "1904-01-01 00:00:00")]
    rows = spark.createDataFrame([s[:2] for s in serials], "v double, old boolean").select(date_text(f.F.col("v"), f.F.col("old")).alias("t")).collect()
    assert [r.t for r in rows] == [s[2] for s in serials]


def test_destinations(spark):
    names = {"S!$A$1": [("S", "$A$1")], "'My S'!A1:B2,T!C3": [("My S", "A1:B2"), ("T", "C3")], "42": [], "SUM(S!A1)": [], "S!A1+1": [], "'O''x'!$C$3": [("O'x", "$C$3")], "": []}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", destinations(f.F.col("n")).alias("d")).collect()
    assert {r.n: [tuple(d) for d in r.d] for r in got} == names


@pytest.mark.parametrize(("text", "start", "end", "want"), [
    ("A1+$B2*C$3+$D$4", "A1", "B3", "B3+$B4*D$3+$D$4"), ('IF(A1="A1",S!A1,\'A1 x\'!A1)', "B2", "B3", 'IF(A2="A1",S!A2,\'A1 x\'!A2)'), ("LOG10(A1)", "A1", "A2", "LOG10(A2)"), ("SUM(A1:B2)", "C1", "D1", "SUM(B1:C2)"), ("Z9", "A1", "B1", "AA9"),
])
def test_shared_formulas_move(spark, text, start, end, want):
    a, b = CELL_ADDRESS.match(start), CELL_ADDRESS.match(end)
    by = column_number(b[1]) - column_number(a[1]), int(b[2]) - int(a[2])
    assert spark.createDataFrame([(text,)], "t string").select(moved("t", *map(str, by))).collect()[0][0] == want


def test_package_columns(spark):
    names = ["xl/vbaProject.bin", "xl/pivotTables/a.xml", "xl/charts/_rels/c.rels", "xl/chartsheets/s.xml", "xl/connections.xml", "xl/media/pivot.png", "xl/media/x.png", "xl/Media/x.png", "x/pivot/charts/y"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(package.opaque_marker(f.F.col("n")).alias("m")).collect()
    assert [r.m for r in got] == ["macro project", "pivot table/cache", "chart", None, "connection", "pivot table/cache", "media", None, "pivot table/cache"]
    paths = {"a.xlsx": True, "b/A.XLSM": True, "a.xls": False, "xlsx": False, ".xlsx": False, "a.xlsx.zip": False, "a.b.xlsx": True, "d.xlsx/e": False}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", package.is_workbook(f.F.col("p")).alias("ok")).collect()
    assert {r.p: r.ok for r in rows} == paths


def test_location_problems(spark):
    lit = f.F.lit
    cases = [(location(sheet=lit("S"), address=lit("A1"), object_type="cell"), None), (location(address=lit("A1"), object_type="cell"), "no sheet, part or workbook"), (location(path=lit("b"), address=lit("A1"), object_type="cell"), "address without sheet"), (location(part=lit("p"), object_type="x"), None), (location(sheet=lit("S"), index=lit(-1), object_type="x"), "negative sheet index")]
    got = spark.range(1).select(*[location_problem(c).alias(f"c{i}") for i, (c, _) in enumerate(cases)]).collect()[0]
    assert list(got) == [p for _, p in cases]


def test_contracts(spark):
    found = json.loads(schemas_json())
    assert set(found["frames"]) == set(FRAMES) and found["schema_version"] == SCHEMA_VERSION
    rows = spark.createDataFrame([("input", 0.5), ("input", 1.5), ("new", 0.5), ("other", None)], "category string, confidence double").select(confidence_problem().alias("p"))
    assert [r.p for r in rows.collect()] == [None, "confidence outside 0 to 1", "unknown category", "confidence outside 0 to 1"]
    cells = spark.createDataFrame([(1, 1, 0), (0, 1, 0), (1, 0, 0), (1, 1, -1)], "row long, column long, sheet_index long").select(bound_problem().alias("p"))
    assert [r.p for r in cells.collect()] == [None, "row below 1", "column below 1", "negative sheet index"]


def test_reference_pattern_is_that_of_python(spark):
    python = re.compile(f.REFERENCE.replace(r"[\p{L}\p{N}_ .]", r"[\w .]").replace(r"\p{Nd}", r"\d"))
    for text, refs, _ in FORMULAS:
        assert len(python.findall(text)) == len(refs)

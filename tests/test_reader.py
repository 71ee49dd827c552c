"""The reader's places, pieces and diagnostics: small changes to packages that a reader by names would get wrong."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gridspark.operators.coverage import coverage, holds
from gridspark.operators.inventory import area_sql, inventory
from gridspark.sources import ooxml
from gridspark.sources.tables import temporary_tables
from tests.workbooks import MAIN, REL, formula, number, package, relations, sheet, text, three_sheets


def changed(path, target, change=None, add=None):
    """A copy of a package with parts changed by `change` (name -> function of the text) and added."""
    with zipfile.ZipFile(path) as old, zipfile.ZipFile(target, "w") as new:
        for info in old.infolist():
            data = old.read(info).decode()
            new.writestr(info.filename, (change or {}).get(info.filename, lambda t: t)(data))
        for name, data in (add or {}).items():
            new.writestr(name, data)
    return str(target)


def cells(inv):
    return {(r.sheet_name, r.address): r for r in inv.cells.collect()}


def test_elements_count_at_their_places_only(spark, tmp_path):
    plain = three_sheets(tmp_path / "a.xlsx")
    odd = changed(
        plain, tmp_path / "b.xlsx",
        {
            "xl/styles.xml": lambda t: t.replace("</styleSheet>", '<dxfs><dxf><numFmt numFmtId="10" formatCode="0.0&quot;no&quot;"/></dxf><dxf><numFmt numFmtId="164" formatCode="x"/></dxf></dxfs></styleSheet>'),
            "xl/worksheets/sheet1.xml": lambda t: t.replace(
                "</worksheet>",
                '<conditionalFormatting sqref="B1:B2"><cfRule type="expression"/></conditionalFormatting><customSheetViews><customSheetView><pane topLeftCell="C9" state="frozen"/></customSheetView></customSheetViews>'
                '<extLst><ext><x14:conditionalFormattings xmlns:x14="urn:x14"><x14:conditionalFormatting sqref="Z9"/></x14:conditionalFormattings><x14:dataValidations xmlns:x14="urn:x14"><x14:dataValidation sqref="Z9"/></x14:dataValidations></ext></extLst></worksheet>',
            ),
        },
        {
            "xl/externalLinks/externalLink1.xml": f'<externalLink xmlns="{MAIN}"><externalBook><definedNames><definedName name="Far" refersTo="=S!A1"/></definedNames></externalBook></externalLink>',
            "xl/drawings/drawing1.xml": '<xdr:wsDr xmlns:xdr="urn:xdr"><xdr:from><xdr:col>1</xdr:col><xdr:row>2</xdr:row></xdr:from></xdr:wsDr>',
        },
    )
    with temporary_tables(spark):
        first, second = inventory(spark, str(plain)), inventory(spark, odd)
        strip = lambda inv: sorted(str(r) for r in inv.cells.drop("sha256", "loc").collect())
        assert strip(first) == strip(second) and second.cells.count() == 15
        ranges = lambda inv: sorted(str(r) for r in inv.ranges.drop("sha256", "loc", "seq").collect())
        assert ranges(first) == ranges(second)
        assert [r.named_ranges_count for r in second.manifest.collect()] == [1]


def test_cells_without_addresses_and_values(spark, tmp_path):
    body = '<row><c><v>1</v></c><c t="b"><v></v></c><c r="D1"><v>4</v></c><c><v/></c><c t="inlineStr"><is><t></t></is></c></row><row r="7" ht="20"><c><v>7</v></c></row><row hidden="1"><c t="str"><v></v></c><c><f>A7</f></c></row>'
    xml = f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>'
    with temporary_tables(spark):
        inv = inventory(spark, str(package(tmp_path / "a.xlsx", [("S", "visible", xml)])))
        got = {(a, r.row, r.column, r.value or r.formula) for (_, a), r in cells(inv).items()}
        assert got == {("A1", 1, 1, "1"), ("D1", 1, 4, "4"), ("F1", 1, 6, None), ("A7", 7, 1, "7"), ("B8", 8, 2, "=A7")}
        assert sorted((r.kind, r.address) for r in inv.ranges.collect()) == [("row_layout", "7"), ("row_layout", "8")]
        assert [(r.max_row, r.max_column) for r in inv.sheets.collect()] == [(8, 6)]


def test_links_over_areas(spark, tmp_path):
    xml = sheet(
        {1: [number("A1", 1)], 5: [number("C5", 5)]},
        after='<hyperlinks><hyperlink ref="A1:B2" r:id="rId1"/><hyperlink ref="B2:B3" location="S!A1"/><hyperlink ref="D:D" location="whole"/><hyperlink ref="$F$9" location="held"/><hyperlink ref="not a cell" location="x"/></hyperlinks>',
    )
    extra = {"xl/worksheets/_rels/sheet1.xml.rels": relations([("rId1", "hyperlink", "https://example.com", True)])}
    with temporary_tables(spark):
        rows = inventory(spark, str(package(tmp_path / "a.xlsx", [("S", "visible", xml)], extra=extra))).ranges.where("kind = 'hyperlink'").orderBy("seq").collect()
    got = [(r.address, r.metadata["target"], r.metadata["location"]) for r in rows]
    url, place = "https://example.com", "S!A1"
    assert got == [("A1", url, None), ("B1", url, None), ("D1", None, "whole"), ("A2", url, None), ("B2", None, place), ("D2", None, "whole"), ("B3", None, place), ("D3", None, "whole"), ("D4", None, "whole"), ("D5", None, "whole"), ("F9", None, "held")]


def test_areas(spark):
    want = {"A1": (1, 1, 1, 1), "$B$2:$A$1": (1, 1, 2, 2), "C:D": (1, 3, 1048576, 4), "2:3": (2, 1, 3, 16384), "b7": (7, 2, 7, 2), "A": None, "7": None, "": None, "A1:B2:C3": None, "Sheet!A1": None, None: None}
    got = spark.createDataFrame([(a,) for a in want], "a string").select("a", F.expr(area_sql("a")).alias("box")).collect()
    assert {r.a: None if r.box is None else tuple(r.box) for r in got} == want


def test_parts_by_their_relations(spark, tmp_path):
    """Parts under other names than usual, elements with a prefix, the strict name space, and stray parts."""
    strict, rel = "http://purl.oclc.org/ooxml/spreadsheetml/main", "http://purl.oclc.org/ooxml/officeDocument/relationships"
    rels = lambda rows: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{rel}/{kind}" Target="{t}"/>' for i, kind, t in rows) + "</Relationships>"
    parts = {
        "_rels/.rels": rels([("r1", "officeDocument", "books/main.xml")]),
        "books/main.xml": f'<x:workbook xmlns:x="{strict}" xmlns:r="{rel}"><x:sheets><x:sheet name="Q1" sheetId="1" r:id="s1"/></x:sheets><x:definedNames><x:definedName name="N">Q1!$A$1</x:definedName></x:definedNames></x:workbook>',
        "books/_rels/main.xml.rels": rels([("s1", "worksheet", "deep/../one.xml"), ("s2", "styles", "/looks/own.xml"), ("s3", "sharedStrings", "texts.xml")]),
        "books/one.xml": f'<?xml version="1.0"?><x:worksheet xmlns:x="{strict}"><x:sheetData><x:row r="1"><x:c r="A1" t="s" s="1"><x:v>1</x:v></x:c></x:row></x:sheetData></x:worksheet>',
        "looks/own.xml": f'<styleSheet xmlns="{strict}"><cellXfs><xf numFmtId="0"/><xf numFmtId="2"/></cellXfs></styleSheet>',
        "books/texts.xml": f'<sst xmlns="{strict}"><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{strict}"><cellXfs><xf numFmtId="9"/><xf numFmtId="9"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{strict}"><si><t>wrong</t></si><si><t>wrong</t></si></sst>',
        "xl/workbook.xml": f'<workbook xmlns="{strict}"><definedNames><definedName name="Stray">1</definedName></definedNames></workbook>',
    }
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    with temporary_tables(spark):
        inv = inventory(spark, str(tmp_path / "a.xlsx"))
        assert {k: (r.value, r.number_format) for k, r in cells(inv).items()} == {("Q1", "A1"): ("one", "0.00")}
        assert [(r.name, r.sheet_index) for r in inv.ranges.collect()] == [("N", 0)]
        assert [r.named_ranges_count for r in inv.manifest.collect()] == [1]


# ------------------------------------------------------------------------------------------------ pieces


def whole(xml: bytes, piece_bytes: int):
    """The elements of a part cut into pieces, numbered on."""
    out, count, n = [], {}, 0
    for root, rows_before, piece in ooxml.pieces(io.BytesIO(xml), piece_bytes):
        n += 1
        own = [e for e in ooxml.elements(piece, rows_before) if e["tag"] != "piece"]
        assert all(e["tag"] != "error" for e in own)
        for e in own:
            e["nth"] = count[e["tag"]] = count.get(e["tag"], -1) + 1
            out.append({k: v for k, v in e.items() if v is not None})
    return out, n


@pytest.mark.parametrize("prefix", ["", "x:"])
@pytest.mark.parametrize("numbered", [True, False])
def test_cuts_lose_nothing(prefix, numbered):
    p, ns = prefix, f'xmlns{":x" if prefix else ""}="{MAIN}"'
    rows = "".join(f'<{p}row{f" r={chr(34)}{i}{chr(34)}" if numbered else ""} ht="3"><!-- <{p}row r="9"> --><{p}c><{p}v>{i}</{p}v></{p}c><{p}c t="inlineStr"><{p}is><{p}t><![CDATA[<{p}row r="77"> {i}]]></{p}t></{p}is></{p}c></{p}row>' for i in range(1, 2000))
    xml = f'<?xml version="1.0" encoding="UTF-8"?>\n<{p}worksheet {ns}><{p}cols><{p}col min="1" width="3"/></{p}cols><{p}sheetData>{rows}</{p}sheetData><{p}mergeCells><{p}mergeCell ref="A1:B1"/></{p}mergeCells><{p}rowBreaks count="1"/></{p}worksheet>'.encode()
    key = lambda es: sorted(es, key=lambda e: (e["tag"], e["nth"]))
    at_once, one = whole(xml, 1 << 30)
    assert one == 1 and sum(e["tag"] == "c" for e in at_once) == 3998
    for size in (1000, 5000, 30_000):
        cut, n = whole(xml, size)
        assert n > 5 and key(cut) == key(at_once)
    texts = f'<{p}sst {ns}>{"".join(f"<{p}si><{p}t>s{i}</{p}t></{p}si>" for i in range(9999))}</{p}sst>'.encode()
    assert [e["text"] for e in whole(texts, 5000)[0]] == [f"s{i}" for i in range(9999)]
    for odd in (b"", b"no xml", xml.decode().replace("UTF-8", "UTF-16").encode("utf-16"), b"<worksheet/>", f"<worksheet xmlns='{MAIN}'><sheetData/></worksheet>".encode(), b"<!-- <worksheet> --><other/>"):
        assert len(list(ooxml.pieces(io.BytesIO(odd), 10))) == 1


def test_a_large_sheet_is_the_same_in_pieces(spark, tmp_path, monkeypatch):
    """Strings, rows and shared formulas whose master lies in another piece."""
    n = 3000
    rows = {i: [f'<c r="A{i}" t="s"><v>{i - 1}</v></c>', f'<c r="B{i}"><f t="shared" si="0"{" ref=" + chr(34) + "B1:B3000" + chr(34) if i == 1 else ""}>{"A1+Q1!$A1*SUM(A:A)" if i == 1 else ""}</f></c>', number(f"C{i}", i, i % 3)] for i in range(1, n + 1)}
    strings = [f"text {i} " + "x" * 30 for i in range(n)]
    path = str(package(tmp_path / "a.xlsx", [("Q1", "visible", sheet(rows))], strings=strings))
    real = ooxml.read_parts
    parts = {}

    def small(files):
        parts["df"] = real(files, 2000)
        return parts["df"]

    with temporary_tables(spark):
        normal = cells(inventory(spark, path))
        monkeypatch.setattr("gridspark.operators.inventory.read_parts", small)
        inv = inventory(spark, path)
        in_pieces = cells(inv)
        assert parts["df"].where("piece > 10").count() > 50
        assert in_pieces == normal and len(normal) == 3 * n
        assert normal["Q1", "A3000"].value == strings[-1] and normal["Q1", "B3000"].formula == "=A3000+Q1!$A3000*SUM(A:A)"
        plan = inv.cells._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "SinglePartition" not in plan


def test_diagnostics_of_parts(spark, tmp_path):
    good = three_sheets(tmp_path / "a.xlsx")
    bad = changed(good, tmp_path / "bad.xlsx", {"xl/worksheets/sheet2.xml": lambda t: t[:-20]})
    bomb = tmp_path / "bomb.xlsx"
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z, zipfile.ZipFile(good) as old:
        for info in old.infolist():
            z.writestr(info.filename, old.read(info) if info.filename != "xl/worksheets/sheet3.xml" else b"<worksheet>" + b" " * 3_000_000)
    hurt = bytearray(good.read_bytes())
    with zipfile.ZipFile(good) as z:
        info = z.getinfo("xl/worksheets/sheet1.xml")
        hurt[info.header_offset + 80] ^= 0xFF  # another checksum than is stated
    (tmp_path / "hurt.xlsx").write_bytes(hurt)
    rows = [r for p in (bad, bomb, tmp_path / "hurt.xlsx") for r in ooxml.entries(open(p, "rb").read(), max_part_bytes=1_000_000) if r["error"]]
    assert [(r["name"], r["piece"]) for r in rows] == [("xl/worksheets/sheet3.xml", -1), ("xl/worksheets/sheet1.xml", -1)]
    assert "larger" in rows[0]["error"] and "CRC" in rows[1]["error"]
    with temporary_tables(spark):
        inv = inventory(spark, bad)
        (problem,) = inv.unsupported.where("feature_type = 'corrupt_part'").collect()
        assert (problem.loc.ooxml_part, problem.severity, problem.opaque) == ("xl/worksheets/sheet2.xml", "error", True)
        assert inv.cells.count() == 13 and inv.parts.count() == inv.parts.select("name").distinct().count()


def test_lost_objects_break_the_coverage_equation(spark, tmp_path):
    with temporary_tables(spark):
        inv = inventory(spark, str(three_sheets(tmp_path / "a.xlsx")))
        whole = lambda cells, ranges: [(r.recognized, r.opaque, r.discovered) for r in holds(coverage(inv.workbooks, cells, ranges, inv.unsupported, inv.counted)).collect()]
        assert whole(inv.cells, inv.ranges) == [(25, 1, 26)]
        assert {r.kind: r.counted for r in inv.counted.collect()} == {"cell": 15, "merged_range": 1, "row_layout": 1, "column_layout": 1, "freeze_panes": 1, "data_validation": 1}
        for cells, ranges in ((inv.cells, inv.ranges.where("kind <> 'merged_range'")), (inv.cells.where("address <> 'A1'"), inv.ranges), (inv.cells.unionByName(inv.cells.where("row = 1")), inv.ranges), (inv.cells.limit(0), inv.ranges)):
            with pytest.raises(Exception, match="coverage equation violated"):
                whole(cells, ranges)


def test_odd_cells_are_counted_as_they_are_listed(spark, tmp_path):
    body = (
        '<row r="1" ht="x"><c r="A1" t="s"><v>99</v></c><c r="B1"><f t="shared" si="7"/></c><c r="C1" t="b"><v></v></c><c r="D1" t="n"><is><t>odd</t></is></c><c r="E1" t="inlineStr"><v>plain</v></c>'
        '<c r="F1" t="s"><is><t>i</t></is></c><c r="G1" s="9"/><c r="H1" t="inlineStr"><is/></c></row><row r="2" ht="0" hidden="0"/><row r="3" ht="1e1"/>'
    )
    xml = f'<worksheet xmlns="{MAIN}"><cols><col min="1"/><col min="2" width="0"/><col min="3" width="bad"/></cols><sheetData>{body}</sheetData></worksheet>'
    with temporary_tables(spark):
        inv = inventory(spark, str(package(tmp_path / "a.xlsx", [("S", "visible", xml)])))
        (row,) = holds(coverage(inv.workbooks, inv.cells, inv.ranges, inv.unsupported, inv.counted)).collect()
        got = {a: (r.value, r.formula) for (_, a), r in cells(inv).items()}
    assert got == {"A1": ("", None), "B1": (None, "="), "D1": ("odd", None), "E1": ("plain", None), "F1": ("i", None), "H1": ("", None)}
    assert row.recognized == len(got) + 1 + 2


def test_only_parts_that_are_read_carry_their_text(tmp_path):
    good = three_sheets(tmp_path / "a.xlsx")
    with_more = changed(good, tmp_path / "b.xlsx", add={"xl/pivotCache/pivotCacheRecords1.xml": f'<pivotCacheRecords xmlns="{MAIN}"><r/></pivotCacheRecords>', "xl/media/image1.png": "png"})
    rows = {r["name"]: r for r in ooxml.entries(open(with_more, "rb").read())}
    assert rows["xl/pivotCache/pivotCacheRecords1.xml"]["xml"] is None and rows["xl/media/image1.png"]["xml"] is None
    assert rows["xl/worksheets/sheet1.xml"]["root"] == "worksheet" and rows["xl/worksheets/sheet1.xml"]["xml"]
    assert REL and formula and text

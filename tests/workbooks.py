"""Workbooks written as raw packages, as no spreadsheet library is at hand."""

from __future__ import annotations

import zipfile
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"


def text(ref: str, value: str) -> str:
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'


def shared(ref: str, index: int) -> str:
    return f'<c r="{ref}" t="s"><v>{index}</v></c>'


def number(ref: str, value, style: int = 0) -> str:
    return f'<c r="{ref}" s="{style}"><v>{value}</v></c>'


def formula(ref: str, body: str, extra: str = "") -> str:
    return f'<c r="{ref}"><f{extra}>{escape(body)}</f><v>0</v></c>'


def sheet(rows: dict[int, list[str]], before: str = "", after: str = "", row_attrs: dict[int, str] | None = None) -> str:
    body = "".join(f'<row r="{n}" {(row_attrs or {}).get(n, "")}>{"".join(cells)}</row>' for n, cells in sorted(rows.items()))
    return f'<worksheet xmlns="{MAIN}" xmlns:r="{REL}">{before}<sheetData>{body}</sheetData>{after}</worksheet>'


def relations(rows: list[tuple[str, str, str, bool]]) -> str:
    items = "".join(f'<Relationship Id="{i}" Type="{REL}/{kind}" Target={quoteattr(target)}{" TargetMode=" + quoteattr("External") if external else ""}/>' for i, kind, target, external in rows)
    return f'<Relationships xmlns="{PACKAGE_RELS}">{items}</Relationships>'


def package(path: Path, sheets: list[tuple[str, str, str]], names: str = "", extra: dict[str, str] | None = None, strings: list[str] = (), calc: str = '<calcPr calcMode="auto"/>', formats: tuple[int, ...] = (0, 10, 14)) -> Path:
    """sheets: (name, state, xml). formats: the number format of each cell style."""
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}" state="{state}"/>' for i, (n, state, _) in enumerate(sheets, 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{TYPES}"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/rels"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/workbook"/></Types>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{listed}</sheets><definedNames>{names}</definedNames>{calc}</workbook>',
        "xl/_rels/workbook.xml.rels": relations([(f"rId{i}", "worksheet", f"worksheets/sheet{i}.xml", False) for i in range(1, len(sheets) + 1)]),
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="0.000&quot;d&quot;"/></numFmts><cellStyleXfs><xf numFmtId="0"/></cellStyleXfs><cellXfs>{"".join(f"<xf numFmtId={quoteattr(str(f))}/>" for f in formats)}</cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}">{"".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r><rPh><t>no</t></rPh></si>" for s in strings)}</sst>',
    } | {f"xl/worksheets/sheet{i}.xml": xml for i, (_, _, xml) in enumerate(sheets, 1)} | (extra or {})
    with zipfile.ZipFile(path, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return path


def three_sheets(path: Path) -> Path:
    """Fifteen cells, two ranges, seven layout objects, one name, one drawing part."""
    inputs = sheet(
        {
            1: [shared("A1", 0), number("B1", 0.05, 1)],
            2: [shared("A2", 1), number("B2", 100), formula("C2", "B1*B2"), formula("D2", "Outputs!B2+C2"), formula("E2", "SUM(B1:B2)")],
            3: ['<c r="A3"/>'], 4: [text("A4", "link")], 5: [], 7: [text("A7", "Field"), text("B7", "Value")], 8: [shared("A8", 1), number("B8", 100)],
        },
        before='<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" xSplit="1" topLeftCell="B2" state="frozen"/></sheetView></sheetViews><cols><col min="4" max="4" width="13" hidden="1"/></cols>',
        after='<mergeCells><mergeCell ref="A5:B5"/></mergeCells><conditionalFormatting sqref="B1:B2"><cfRule type="cellIs" operator="greaterThan"><formula>0</formula></cfRule></conditionalFormatting>'
        '<dataValidations><dataValidation type="decimal" operator="between" sqref="B1"><formula1>0</formula1><formula2>1</formula2></dataValidation></dataValidations>'
        '<hyperlinks><hyperlink ref="A4" r:id="rId1"/></hyperlinks><legacyDrawing r:id="rId3"/><tableParts><tablePart r:id="rId4"/></tableParts>',
        row_attrs={3: 'hidden="1"'},
    )
    outputs = sheet({1: [text("A1", "Result")], 2: [formula("B2", "Inputs!C2")]})
    hidden = sheet({1: [number("A1", 42)]})
    extra = {
        "xl/worksheets/_rels/sheet1.xml.rels": relations([("rId1", "hyperlink", "https://example.com", True), ("rId2", "comments", "/xl/comments/comment1.xml", False), ("rId3", "vmlDrawing", "../drawings/legacy1.vml", False), ("rId4", "table", "../tables/table1.xml", False)]),
        "xl/comments/comment1.xml": f'<comments xmlns="{MAIN}"><authors><author>tester</author></authors><commentList><comment ref="A3" authorId="0"><text><t>review me</t></text></comment></commentList></comments>',
        "xl/drawings/legacy1.vml": "<xml/>",
        "xl/tables/table1.xml": f'<table xmlns="{MAIN}" id="1" name="InputTable" displayName="InputTable" ref="A7:B8"/>',
    }
    return package(path, [("Inputs", "visible", inputs), ("Outputs", "visible", outputs), ("HiddenData", "hidden", hidden)], "<definedName name=\"PremiumCell\">'Inputs'!$B$2</definedName>", extra, ["Assumption rate", "Premium"])

"""Real workbooks made of table rows, so that the reader runs over the tables: each thousand customers are one .xlsx
package, put together inside a task, and read back like any other file.

A package has a sheet `Customers` (a header, a row for each customer), a sheet `Nations` and a hidden sheet `Empty`, with
all that the reader tells apart: shared, inline and formula texts, numbers, dates, truth values, errors, plain and shared
formulas, styles, merged cells, a table, hidden rows, column widths, panes, validations, conditional formats, comments,
links, protection, names, opaque parts. Every third package is there a second time under another name.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.coverage import coverage, holds
from gridspark.operators.graph import formula_graph
from gridspark.operators.inventory import Inventory, inventory_of
from gridspark.plans.pipeline import Decomposition, decompose
from gridspark.plugins import registry
from gridspark.sinks.json_files import LAYOUTS, artifact_lines, stage
from gridspark.sources.ooxml import as_workbooks
from gridspark.sources.tables import shared_folder, written

BOOK_CUSTOMERS = 1000
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Number formats by cell style; 164 is the package's own.
STYLES, OWN_FORMAT = (0, 4, 14, 10, 164), '0.000" EUR"'
HEADER = ("key", "name", "cents", "since", "active", "segment", "double", "moved", "typed", "share")


def _text(ref: str, text: str) -> str:
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(text)}</t></is></c>'


def customer_row(row: int, first: int, key: int, nation: int, segment: str | None, cents: int, name_index: int) -> str:
    """The cells of a customer. The formula of column H is shared: the first row has it, the others refer to it."""
    shared = f'<f t="shared" ref="H{first}:H{first + BOOK_CUSTOMERS}" si="0">A{row}+$B$1</f>' if row == first else '<f t="shared" si="0"/>'
    cells = [
        f'<c r="A{row}"><v>{key}</v></c>', f'<c r="B{row}" t="s"><v>{name_index}</v></c>', f'<c r="C{row}" s="1"><v>{cents}</v></c>', f'<c r="D{row}" s="2"><v>{40000 + key % 5000}</v></c>',
        f'<c r="E{row}" t="b"><v>{key % 2}</v></c>', f'<c r="F{row}"/>' if segment is None else _text(f"F{row}", segment), f'<c r="G{row}" s="4"><f>C{row}*2</f><v>0</v></c>', f'<c r="H{row}">{shared}<v>0</v></c>',
    ]
    if key % 5 == 0:
        cells.append(_text(f"I{row}", f"=Nations!A{nation + 1}"))
    elif key % 7 == 0:
        cells.append(f'<c r="I{row}" t="e"><v>#N/A</v></c>')
    if key % 3 == 0:
        cells.append(f'<c r="J{row}" s="3"><f>SUM(C{row}:D{row})/\'Nations\'!$A$1</f><v>0</v></c>')
    return f'<row r="{row}"{" hidden=" + quoteattr("1") if key % 50 == 0 else ""}>{"".join(cells)}</row>'


def sheet(body: str, before: str = "", after: str = "") -> str:
    return f'<worksheet xmlns="{MAIN}" xmlns:r="{OFFICE}">{before}<sheetData>{body}</sheetData>{after}</worksheet>'


def relations(rows: list[tuple[str, str, bool]]) -> str:
    """(kind, target, external) of rId1, rId2, ..."""
    items = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/{kind}" Target={quoteattr(target)}{" TargetMode=" + quoteattr("External") if out else ""}/>' for i, (kind, target, out) in enumerate(rows, 1))
    return f'<Relationships xmlns="{PACKAGE}/relationships">{items}</Relationships>'


def package(book: int, rows: list[tuple[int, str | None, int, int, str | None]]) -> bytes:
    """The package of one book. rows: (key, name, nation, cents, segment), by key."""
    names = sorted({n for _, n, _, _, _ in rows if n is not None})
    index = {n: i for i, n in enumerate(names)}
    first = rows[0][0] % BOOK_CUSTOMERS + 2
    last = rows[-1][0] % BOOK_CUSTOMERS + 2
    header = f'<row r="1">{"".join(_text(f"{chr(65 + i)}1", t) for i, t in enumerate(HEADER))}</row>'
    body = header + "".join(customer_row(k % BOOK_CUSTOMERS + 2, first, k, nation, segment, cents, index.get(name, 0)) for k, name, nation, cents, segment in rows)
    customers = sheet(
        body, '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols><col min="2" max="2" width="30"/><col min="4" max="4" width="0" hidden="1"/></cols>',
        f'<sheetProtection sheet="1"/><mergeCells><mergeCell ref="L1:M1"/></mergeCells><conditionalFormatting sqref="C2:C{last}"/><dataValidations><dataValidation type="list" sqref="F{first}"><formula1>"A,B"</formula1></dataValidation></dataValidations>'
        f'<hyperlinks><hyperlink ref="B{first}" r:id="rId1"/></hyperlinks><tableParts><tablePart r:id="rId3"/></tableParts>',
    )
    counts: dict[int, int] = {}
    for _, _, nation, _, _ in rows:
        counts[nation] = counts.get(nation, 0) + 1
    nations = sheet("".join(f'<row r="{n + 1}"><c r="A{n + 1}"><v>{c}</v></c></row>' for n, c in sorted(counts.items())))
    sheets = [("Customers", "visible", customers), ("Nations", "visible", nations), ("Empty", "hidden", sheet(""))]
    listed = "".join(f'<sheet name="{n}" sheetId="{i}" state="{state}" r:id="rId{i}"/>' for i, (n, state, _) in enumerate(sheets, 1))
    defined = f"<definedName name=\"Keys\">Customers!$A$2:$A${last}</definedName><definedName name=\"Both\">Customers!$A$1,'Nations'!$A$1</definedName><definedName name=\"Rate\">0.{book}</definedName><definedName name=\"Own\" localSheetId=\"0\">Customers!$A$1</definedName>"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/rels"/><Override PartName="/xl/workbook.xml" ContentType="application/workbook"/></Types>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets><definedNames>{defined}</definedNames>{"<calcPr calcMode=" + quoteattr("manual") + "/>" if book % 2 else ""}</workbook>',
        "xl/_rels/workbook.xml.rels": relations([("worksheet", f"worksheets/sheet{i}.xml", False) for i in range(1, len(sheets) + 1)]),
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode={quoteattr(OWN_FORMAT)}/></numFmts><cellXfs>{"".join(f"<xf numFmtId={quoteattr(str(s))}/>" for s in STYLES)}</cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}">{"".join(f"<si><r><t>{escape(n[:3])}</t></r><r><t>{escape(n[3:])}</t></r></si>" for n in names)}</sst>',
        **{f"xl/worksheets/sheet{i}.xml": xml for i, (_, _, xml) in enumerate(sheets, 1)},
        "xl/worksheets/_rels/sheet1.xml.rels": relations([("hyperlink", f"https://example.com/{book}", True), ("comments", "../comments1.xml", False), ("table", "/xl/tables/table1.xml", False)]),
        "xl/comments1.xml": f'<comments xmlns="{MAIN}"><authors><author>book {book}</author></authors><commentList><comment ref="C{first}" authorId="0"><text><r><t>look </t></r><r><t>here</t></r></text></comment></commentList></comments>',
        "xl/tables/table1.xml": f'<table xmlns="{MAIN}" id="1" name="Customers{book}" displayName="Customers {book}" ref="A1:J{last}"/>',
        **({"xl/vbaProject.bin": "macros"} if book % 4 == 1 else {}),
        "xl/media/image1.png": "image",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data)  # a fixed date: the same rows are the same bytes
    return out.getvalue()


def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha256, path, file_name, file_size, content) of the packages, copies included."""
    table = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey is not null")
    rows = table.selectExpr(f"c_custkey div {BOOK_CUSTOMERS} as book", "cast(c_custkey as long) as key", "c_name as name", "cast(c_nationkey as long) as nation", "cast(round(c_acctbal * 100) as long) as cents", "c_mktsegment as segment")

    def put(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("key")
        book = int(ordered["book"].iloc[0])
        text = lambda c: [None if pd.isna(x) else x for x in ordered[c]]
        content = package(book, list(zip(map(int, ordered["key"]), text("name"), map(int, ordered["nation"]), map(int, ordered["cents"]), text("segment"))))
        paths = [f"books/book-{book}.xlsx"] + [f"books/copy-of-{book}.xlsx"] * (book % 3 == 0)
        return pd.DataFrame({"path": paths, "content": [content] * len(paths)})

    dealt = rows.repartition(spark.sparkContext.defaultParallelism, "book")
    return written(as_workbooks(dealt.groupBy("book").applyInPandas(put, "path string, content binary")))


def books(spark: SparkSession, sf_dir: str) -> Inventory:
    return inventory_of(book_files(spark, sf_dir))


# ------------------------------------------------------------------------------------------------ the same in SQL

ROWS = f"""cust as (
  select c_custkey // {BOOK_CUSTOMERS} as book, c_custkey::bigint as key, c_custkey % {BOOK_CUSTOMERS} + 2 as r, c_name as name, c_nationkey as nation, round(c_acctbal * 100)::bigint as cents, c_mktsegment as segment
  from customer where c_custkey is not null
), book as (
  select book, min(r) as first_row, max(r) as last_row, 'book-' || book || '.xlsx' as file from cust group by book
)"""
_CUSTOMER = (
    ("A", "'value'", "key::varchar", "'long'", "'n'", "'General'", "null", "true"),
    ("B", "'value'", "name", "'string'", "'s'", "'General'", "null", "name is not null"),
    ("C", "'value'", "cents::varchar", "'long'", "'n'", "'#,##0.00'", "null", "true"),
    ("D", "'value'", "strftime(date '1899-12-30' + (40000 + key % 5000)::int, '%Y-%m-%d') || ' 00:00:00'", "'string'", "'d'", "'mm-dd-yy'", "null", "true"),
    ("E", "'value'", "case when key % 2 = 1 then 'true' else 'false' end", "'boolean'", "'b'", "'General'", "null", "true"),
    ("F", "'value'", "segment", "'string'", "'s'", "'General'", "null", "segment is not null"),
    ("G", "'formula'", "null", "null", "'f'", f"'{OWN_FORMAT}'", "'=C' || r || '*2'", "true"),
    ("H", "'formula'", "null", "null", "'f'", "'General'", "'=A' || r || '+$B$1'", "true"),
    ("I", "'formula'", "null", "null", "'s'", "'General'", "'=Nations!A' || (nation + 1)", "key % 5 = 0"),
    ("I", "'value'", "'#N/A'", "'string'", "'e'", "'General'", "null", "key % 5 <> 0 and key % 7 = 0"),
    ("J", "'formula'", "null", "null", "'f'", "'0.00%'", "'=SUM(C' || r || ':D' || r || ')/''Nations''!$A$1'", "key % 3 = 0"),
)
CELLS = f"""{ROWS}, cell as (
  {" union all ".join(f"select book, 'Customers' as sheet, 0 as idx, r, {ord(c) - 64} as c, '{c}' || r as address, {kind} as kind, {value} as value, {typ} as value_type, {letter} as data_type, {fmt} as fmt, {formula} as formula from cust where {when}" for c, kind, value, typ, letter, fmt, formula, when in _CUSTOMER)}
  union all select book, 'Nations', 1, nation + 1, 1, 'A' || (nation + 1), 'value', count(*)::varchar, 'long', 'n', 'General', null from cust group by book, nation
  {" ".join(f"union all select book, 'Customers', 0, 1, {i}, '{chr(64 + i)}1', 'value', '{t}', 'string', 's', 'General', null from book" for i, t in enumerate(HEADER, 1))}
)"""


def by_file(df: DataFrame, inv: Inventory) -> DataFrame:
    """df with the file name of its workbook in the place of the hash."""
    return df.join(inv.manifest.select("sha256", "file_name"), "sha256").withColumnRenamed("file_name", "file")


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = books(spark, sf_dir)
    return by_file(inv.cells, inv).select("file", F.col("sheet_name").alias("sheet"), F.col("sheet_index").alias("idx"), F.col("row").alias("row_no"), F.col("column").alias("col_no"), "address", "kind", "value", "value_type", "data_type", F.col("number_format").alias("fmt"), "formula", F.col("loc.object_id").alias("object_id"))


def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = books(spark, sf_dir)
    return by_file(inv.sheets, inv).select("file", F.col("sheet_name").alias("sheet"), F.col("sheet_index").alias("idx"), "state", "max_row", "max_column")


def workbook_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = book_files(spark, sf_dir)
    inv = inventory_of(files)
    size = files.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.max(F.length("content")).alias("size"))
    return inv.manifest.join(size, "sha256", "left").select(F.col("file_name").alias("file"), (F.col("file_size") == F.col("size")).alias("size_ok"), F.size("other_paths").cast("long").alias("n_copies"), "is_macro_enabled", F.col("named_ranges_count").alias("named"), "calc_mode")


def workbook_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = books(spark, sf_dir)
    return by_file(inv.parts, inv).select("file", F.col("part_seq").alias("seq"), "name", "content_type", "opaque")


def workbook_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = books(spark, sf_dir)
    told = F.concat_ws(";", F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return by_file(inv.ranges, inv).select("file", "scope", "kind", F.coalesce("sheet_name", F.lit("")).alias("sheet"), "address", F.coalesce("name", F.lit("")).alias("name"), F.col("loc.object_id").alias("object_id"), told.alias("told"))


def workbook_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = books(spark, sf_dir)
    return by_file(holds(coverage(inv.workbooks, inv.cells, inv.ranges, inv.unsupported, inv.counted)), inv).select("file", "recognized", "opaque", "discovered")


def workbook_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = books(spark, sf_dir)
    return by_file(formula_graph(inv.cells).edges, inv).select("file", "source", "target", "relationship")


def whole(spark: SparkSession, sf_dir: str) -> Decomposition:
    """The decomposition of the packages, by the registered stages."""
    return decompose(spark, sf_dir, {"read": "customers"})


registry.implements("read", "customers", replace=True)(lambda spark, paths: book_files(spark, paths))


def workbook_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whole(spark, sf_dir)
    return by_file(done.items, done.inventory).groupBy("file", "category").agg(F.count(F.lit(1)).alias("n"))


#: Of all artifacts what `workbook_artifacts` tells; of what an array holds one field, so that it can be counted.
TOLD = (
    "schema_version string, artifact_type string, file_name string, sheets array<struct<cells:array<struct<value:string>>>>, package_parts array<struct<name:string>>, "
    "coverage struct<recognized_inventory_objects:bigint>, nodes array<struct<id:string>>, edges array<struct<source:string>>, items array<struct<id:string>>"
)


def workbook_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON artifacts of each workbook hold, written by tasks and read back from their files. The files are
    gzipped; each is parsed once, where it is read, and only what is told of it is shuffled."""
    staging = f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"
    stage(artifact_lines(whole(spark, sf_dir)), staging, "gzip")
    files = spark.read.schema(TOLD).options(multiLine=True, mode="FAILFAST", recursiveFileLookup=True, pathGlobFilter="*.json.gz").json(staging)
    path, first = F.split("_metadata.file_path", "/"), F.get("sheets", F.lit(0))["cells"]
    size = lambda c: F.array_size(c).cast("long")
    told = files.select(
        F.element_at(path, -2).alias("sha256"), F.regexp_replace(F.element_at(path, -1), r"\.gz$", "").alias("name"), "schema_version", "artifact_type", "file_name", size("sheets").alias("n_sheets"), size("package_parts").alias("n_parts"),
        size(first).alias("n_cells"), F.get(first, F.lit(0))["value"].alias("first_value"), "coverage.recognized_inventory_objects", size("nodes").alias("n_nodes"), size("edges").alias("n_edges"), size("items").alias("n_items"),
    )
    of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    return told.groupBy("sha256").agg(
        of("workbook_manifest.json", "file_name").alias("file"), of("inventory.json", "schema_version").alias("version"), F.concat_ws(",", *[of(n, "artifact_type") for n in LAYOUTS]).alias("types"),
        of("workbook_manifest.json", "n_sheets").alias("n_sheets"), of("workbook_manifest.json", "n_parts").alias("n_parts"), of("inventory.json", "n_cells").alias("n_cells"),
        of("inventory.json", "recognized_inventory_objects").alias("recognized"), of("dependency_graph.json", "n_nodes").alias("n_nodes"), of("dependency_graph.json", "n_edges").alias("n_edges"),
        of("module_classification.json", "n_items").alias("n_items"), of("inventory.json", "first_value").alias("first_value"),
    ).drop("sha256")


EDGES = """edge as (
  select book, 'cell:Customers!G' || r as source, 'cell:Customers!C' || r as target from cust union all select book, 'cell:Customers!H' || r, 'cell:Customers!A' || r from cust
  union all select book, 'cell:Customers!H' || r, 'cell:Customers!B1' from cust union all select book, 'cell:Customers!I' || r, 'cell:Nations!A' || (nation + 1) from cust where key % 5 = 0
  union all select book, 'cell:Customers!J' || r, 'range:Customers!C' || r || ':D' || r from cust where key % 3 = 0 union all select book, 'cell:Customers!J' || r, 'cell:Nations!A1' from cust where key % 3 = 0
)"""


def _ranges_sql() -> str:
    row = lambda scope, kind, sheet, address, name, object_id, told, source="book": f"select file, '{scope}' as scope, '{kind}' as kind, '{sheet}' as sheet, {address} as address, {name} as name, {object_id} as object_id, {told} as told from {source}"
    on = lambda kind, address, object_id, told="''", name="''", scope="layout", source="book": row(scope, kind, "Customers", address, name, object_id, told, source)
    return " union all ".join([
        on("merged_range", "'L1:M1'", "'L1:M1'", scope="sheet_range"),
        on("table", "'A1:J' || last_row", "'Customers' || book", "'display_name=Customers ' || book", "'Customers' || book", "sheet_range"),
        on("row_layout", "r::varchar", "'row:' || r", "'height=;hidden=true'", source="(select 'book-' || book || '.xlsx' as file, r from cust where key % 50 = 0)"),
        on("column_layout", "'B'", "'col:B'", "'hidden=false;width=30.0'"), on("column_layout", "'D'", "'col:D'", "'hidden=true;width=0.0'"),
        on("freeze_panes", "'A2'", "'freeze_panes'"), on("data_validation", "'F' || first_row", "'dv:F' || first_row", "'formula1=\"A,B\";formula2=;type=list'"),
        on("conditional_formatting", "'C2:C' || last_row", "'cf:C2:C' || last_row"), on("comment", "'C' || first_row", "'comment:C' || first_row", "'author=book ' || book || ';text=look here'"),
        on("hyperlink", "'B' || first_row", "'hyperlink:B' || first_row", "'location=;target=https://example.com/' || book"), on("sheet_protection", "'sheet'", "'sheet_protection'"),
        row("workbook", "defined_name", "Customers", "'$A$2:$A$' || last_row", "'Keys'", "'Keys'", "'scope=workbook'"), row("workbook", "defined_name", "Customers", "'$A$1'", "'Both'", "'Both'", "'scope=workbook'"),
        row("workbook", "defined_name", "Nations", "'$A$1'", "'Both'", "'Both'", "'scope=workbook'"), row("workbook", "defined_name", "", "'0.' || book", "'Rate'", "'Rate'", "'scope=workbook'"),
    ])


_PARTS = ("[Content_Types].xml", "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/styles.xml", "xl/sharedStrings.xml", "xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml", "xl/worksheets/sheet3.xml", "xl/worksheets/_rels/sheet1.xml.rels", "xl/comments1.xml", "xl/tables/table1.xml")
_PART_LIST = ", ".join(f"'{p}'" for p in _PARTS)

QUERIES = {f.__name__: f for f in (workbook_cells, workbook_sheets, workbook_manifest, workbook_parts, workbook_ranges, workbook_coverage, workbook_edges, workbook_classes, workbook_artifacts)}
ORACLES = {
    "workbook_cells": f"with {CELLS} select 'book-' || book || '.xlsx' as file, sheet, idx::bigint as idx, r::bigint as row_no, c::bigint as col_no, address, kind, value, value_type, data_type, fmt, formula, sheet || '!' || address as object_id from cell",
    "workbook_sheets": f"with {ROWS} select file, 'Customers' as sheet, 0::bigint as idx, 'visible' as state, last_row::bigint as max_row, 10::bigint as max_column from book union all select 'book-' || book || '.xlsx', 'Nations', 1, 'visible', max(nation) + 1, 1 from cust group by book union all select file, 'Empty', 2, 'hidden', 1, 1 from book",
    "workbook_manifest": f"with {ROWS} select file, true as size_ok, (book % 3 = 0)::bigint as n_copies, book % 4 = 1 as is_macro_enabled, 3::bigint as named, case when book % 2 = 1 then 'manual' else 'auto' end as calc_mode from book",
    "workbook_parts": f"with {ROWS}, p as (select book, file, unnest([{_PART_LIST}] || case when book % 4 = 1 then ['xl/vbaProject.bin'] else [] end || ['xl/media/image1.png']) as name, unnest(range(0, {len(_PARTS)} + 1 + (book % 4 = 1)::int)) as seq from book) "
    "select file, seq::bigint as seq, name, case when name = 'xl/workbook.xml' then 'application/workbook' when name like '%.xml' then 'application/xml' when name like '%.rels' then 'application/rels' else '' end as content_type, name like 'xl/media/%' or name like '%vbaProject.bin' as opaque from p",
    "workbook_ranges": f"with {ROWS} {_ranges_sql()}",
    "workbook_edges": f"with {ROWS}, {EDGES} select 'book-' || book || '.xlsx' as file, source, target, 'references' as relationship from edge",
    "workbook_classes": f"with {CELLS}, item as (select book, case when kind = 'formula' then 'formula_block' when fmt <> 'General' or value_type <> 'string' then 'input' else 'presentation' end as category, count(*) as n from cell group by all "
    "union all select book, 'presentation', 5 from book union all select book, 'presentation', count(*) from cust where key % 50 = 0 group by book union all select book, 'input', 1 from book union all select book, 'data_table', 1 from book "
    "union all select book, 'other', 7 from book union all select book, 'unsupported_opaque', 1 + (book % 4 = 1)::int from book) select 'book-' || book || '.xlsx' as file, category, sum(n)::bigint as n from item group by all",
    "workbook_artifacts": f"with {CELLS}, {EDGES}, h as (select book, count(*) as n from cust where key % 50 = 0 group by book), c as (select book, count(*) as n, count(*) filter (where sheet = 'Customers') as own from cell group by book), "
    "e as (select book, count(*) as n from edge group by book), n as (select book, count(distinct id) as n from (select book, source as id from edge union all select book, target from edge) group by book) "
    "select file, 'phase1.v1' as version, 'workbook_manifest,workbook_inventory,formula_graph,module_classification,confirmation_template' as types, 3::bigint as n_sheets, (12 + (b.book % 4 = 1)::int)::bigint as n_parts, c.own::bigint as n_cells, "
    "(c.n + 14 + coalesce(h.n, 0))::bigint as recognized, n.n::bigint as n_nodes, e.n::bigint as n_edges, (c.n + 14 + coalesce(h.n, 0) + 1 + (b.book % 4 = 1)::int)::bigint as n_items, 'key' as first_value "
    "from book b join c using (book) left join h using (book) join e using (book) join n using (book)",
    "workbook_coverage": f"with {CELLS}, n as (select book, count(*) as recognized, 0 as opaque from cell group by book union all select book, 14 + (select count(*) from cust c where c.book = b.book and c.key % 50 = 0), 1 + (book % 4 = 1)::int from book b) select 'book-' || book || '.xlsx' as file, sum(recognized)::bigint as recognized, sum(opaque)::bigint as opaque, sum(recognized + opaque)::bigint as discovered from n group by book",
}

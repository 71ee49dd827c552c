"""Real workbooks of another make than bookview's: all that a reader goes wrong on that knows elements by their names
alone. Each two hundred suppliers are one package, put together inside a task and read back.

Parts have other names than usual and are found by relations only; elements have a prefix; sheets are called Q1 and FY24;
rows and cells have no addresses; there are empty values, shared formulas with sheet names, brackets, whole columns and
rows, a format of a conditional style with the number of a cell format, names of an external link, a custom view, equal
areas of conditional formats, links over areas, and stray styles that no relation names.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.graph import formula_graph
from gridspark.operators.inventory import Inventory, inventory_of
from gridspark.plans.bookview import MAIN, OFFICE, PACKAGE, by_file, relations
from gridspark.plans.pipeline import Decomposition, decompose
from gridspark.plugins import registry
from gridspark.sinks.json_files import file_system
from gridspark.sinks.store import INDEX, ArtifactStore, RunRecord
from gridspark.sources.artifacts import cells_back, read_artifacts
from gridspark.sources.ooxml import as_workbooks
from gridspark.sources.ooxml_source import register
from gridspark.sources.tables import shared_folder, written

BOOK_SUPPLIERS = 200
RUNS = ("first", "second")
KRONA = '0.0" kr"'
SAID = pa.schema([*[(c, pa.string()) for c in ("sha256", "run_id", "name", "path", "said")], ("bytes", pa.int64())])


def _cell(body: str = "", attrs: str = "") -> str:
    return f"<x:c{attrs}>{body}</x:c>"


def _shared(number: int, text: str) -> str:
    """A shared formula: with its text in the first cell, without in the others."""
    return _cell(f'<x:f t="shared" si="{number}">{escape(text)}</x:f><x:v>0</x:v>' if text else f'<x:f t="shared" si="{number}"/><x:v>0</x:v>')


def supplier_row(first: bool, key: int, cents: int, name_index: int) -> str:
    """Key, name, balance, an empty value, and three formulas."""
    cells = [
        _cell(f"<x:v>{key}</x:v>"), _cell(f"<x:v>{name_index}</x:v>", ' t="s"'), _cell(f"<x:v>{cents}</x:v>", ' s="1"'), _cell("<x:v></x:v>"),
        _shared(0, "Q1!A2+FY24!$A$1" if first else ""), _shared(1, 'SUM(A:A)/SUM(1:1)&"B2"' if first else ""), _shared(1, ""), _shared(2, "Tab[Q1]*LOG10($A2)" if first else ""),
    ]
    return f"<x:row>{''.join(cells)}</x:row>"


def _sheet(body: str, before: str = "", after: str = "") -> str:
    return f'<x:worksheet xmlns:x="{MAIN}" xmlns:r="{OFFICE}">{before}<x:sheetData>{body}</x:sheetData>{after}</x:worksheet>'


def package(book: int, rows: list[tuple[int, str, int]]) -> bytes:
    """The package of one book. rows: (key, name, cents), by key."""
    names = sorted({n for _, n, _ in rows})
    index = {n: i for i, n in enumerate(names)}
    header = '<x:row><x:c t="inlineStr"><x:is><x:t>head</x:t></x:is></x:c></x:row>'
    last = len(rows) + 1
    suppliers = _sheet(
        header + "".join(supplier_row(i == 0, k, cents, index[name]) for i, (k, name, cents) in enumerate(rows)),
        '<x:sheetViews><x:sheetView workbookViewId="0"><x:pane ySplit="1" topLeftCell="A2" state="frozen"/></x:sheetView></x:sheetViews>',
        '<x:customSheetViews><x:customSheetView guid="1"><x:pane ySplit="4" topLeftCell="A5" state="frozen"/></x:customSheetView></x:customSheetViews>'
        f'<x:conditionalFormatting sqref="C2:C{last}"><x:cfRule type="top10"/></x:conditionalFormatting><x:conditionalFormatting sqref="C2:C{last}"><x:cfRule type="expression"/></x:conditionalFormatting>'
        '<x:hyperlinks><x:hyperlink ref="A2:B3" r:id="rId1"/><x:hyperlink ref="B3:B4" location="FY24!A1"/></x:hyperlinks>'
        '<x:extLst><x:ext><y:conditionalFormatting xmlns:y="urn:other" sqref="A1"/></x:ext></x:extLst>',
    )
    totals = _sheet(f'<x:row r="1"><x:c r="A1"><x:v>{sum(c for _, _, c in rows)}</x:v></x:c></x:row>')
    workbook = (
        f'<x:workbook xmlns:x="{MAIN}" xmlns:r="{OFFICE}"><x:sheets><x:sheet name="Q1" sheetId="1" r:id="rId1"/><x:sheet name="FY24" sheetId="2" r:id="rId2"/></x:sheets>'
        '<x:definedNames><x:definedName name="Top">Q1!$A$2</x:definedName></x:definedNames></x:workbook>'
    )
    styles = lambda formats, more="": f'<styleSheet xmlns="{MAIN}">{more}<cellXfs>{"".join(f"<xf numFmtId={quoteattr(str(f))}/>" for f in formats)}</cellXfs><dxfs><dxf><numFmt numFmtId="165" formatCode="0.000"/></dxf></dxfs></styleSheet>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>',
        "_rels/.rels": relations([("officeDocument", "own/book.xml", False)]),
        "own/book.xml": workbook,
        "own/_rels/book.xml.rels": relations([("worksheet", "first.xml", False), ("worksheet", "/own/second.xml", False), ("styles", "look.xml", False), ("sharedStrings", "texts.xml", False), ("externalLink", "externalLinks/link.xml", False)]),
        "own/look.xml": styles((0, 165), f'<numFmts><numFmt numFmtId="165" formatCode={quoteattr(KRONA)}/></numFmts>'),
        "own/texts.xml": f'<sst xmlns="{MAIN}">{"".join(f"<si><t>{escape(n)}</t></si>" for n in names)}</sst>',
        "own/first.xml": suppliers,
        "own/_rels/first.xml.rels": relations([("hyperlink", f"https://example.com/{book}", True)]),
        "own/second.xml": totals,
        "own/externalLinks/link.xml": f'<externalLink xmlns="{MAIN}"><externalBook><definedNames><definedName name="Far"/></definedNames></externalBook></externalLink>',
        "xl/styles.xml": styles((9, 9)),
        "xl/drawings/drawing1.xml": '<d:wsDr xmlns:d="urn:d"><d:from><d:col>1</d:col><d:row>1</d:row></d:from></d:wsDr>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha256, path, file_name, file_size, content) of the packages."""
    table = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey is not null")
    rows = table.selectExpr(f"s_suppkey div {BOOK_SUPPLIERS} as book", "cast(s_suppkey as long) as key", "coalesce(s_name, '') as name", "cast(coalesce(round(s_acctbal * 100), 0) as long) as cents")

    def put(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("key")
        book = int(ordered["book"].iloc[0])
        return pd.DataFrame({"path": [f"odd/odd-{book}.xlsx"], "content": [package(book, list(zip(map(int, ordered["key"]), ordered["name"], map(int, ordered["cents"]))))]})

    dealt = rows.repartition(spark.sparkContext.defaultParallelism, "book")
    return written(as_workbooks(dealt.groupBy("book").applyInPandas(put, "path string, content binary")))


registry.implements("read", "suppliers", replace=True)(odd_files)


def odd_books(spark: SparkSession, sf_dir: str) -> Inventory:
    return inventory_of(odd_files(spark, sf_dir))


def odd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = odd_books(spark, sf_dir)
    return by_file(inv.cells, inv).select("file", F.col("sheet_name").alias("sheet"), F.col("row").alias("row_no"), F.col("column").alias("col_no"), "address", "kind", "value", F.col("number_format").alias("fmt"), "formula")


def odd_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = odd_books(spark, sf_dir)
    told = F.concat(F.coalesce(F.col("metadata")["target"], F.lit("")), F.lit("|"), F.coalesce(F.col("metadata")["location"], F.lit("")))
    return by_file(inv.ranges, inv).select("file", "kind", "sheet_name", "address", told.alias("told"))


def odd_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = odd_books(spark, sf_dir)
    sheets = inv.sheets.groupBy("sha256").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_index", "sheet_name", "max_row", "max_column"))), lambda s: F.concat_ws(":", s["sheet_name"], s["max_row"], s["max_column"])), ",").alias("sheets"))
    return inv.manifest.join(sheets, "sha256").select(F.col("file_name").alias("file"), F.col("named_ranges_count").alias("named"), "calc_mode", "sheets")


def odd_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = odd_books(spark, sf_dir)
    return by_file(formula_graph(inv.cells).edges, inv).select("file", "source", "target")


def stored(spark: SparkSession, sf_dir: str) -> tuple[Decomposition, str, list[RunRecord]]:
    """The packages decomposed and stored twice, under a new folder of the shared one."""
    done = decompose(spark, sf_dir, {"read": "suppliers"})
    out = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    return done, out, [record for run in RUNS for record in ArtifactStore(out).write_runs(done, run)]


def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the runs say of their files, against the files: each hashed and measured anew by a task."""
    done, out, runs = stored(spark, sf_dir)
    told = [{"sha256": r.workbook_sha256, "run_id": r.run_id, "name": a.name, "path": a.path, "said": a.sha256, "bytes": a.bytes} for r in runs for a in r.artifacts]
    said = spark.createDataFrame(pa.Table.from_pylist(told, SAID))  # as Arrow: no Python worker has to read it
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{out}/workbooks").select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("own"), F.length("content").alias("size"))
    where = F.endswith("path", F.concat(F.lit("/workbooks/"), F.col("sha256"), F.lit("/"), F.when(F.col("name") == INDEX, "").otherwise(F.concat("run_id", F.lit("/"))), F.col("name")))
    rows = said.join(found, "path", "left").withColumn("placed", where)
    return by_file(rows, done.inventory).select("file", "run_id", "name", F.coalesce(F.col("own") == F.col("said"), F.lit(False)).alias("hash_ok"), F.coalesce(F.col("size") == F.col("bytes"), F.lit(False)).alias("size_ok"), "placed")


def store_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of each workbook's runs, and what of each run is read and verified again."""
    done, out, runs = stored(spark, sf_dir)
    store = ArtifactStore(out)
    verified = spark.createDataFrame([(r.workbook_sha256, len(store.read_run(r.workbook_sha256, r.run_id).artifacts)) for r in runs if r.run_id == RUNS[0]], "sha256 string, verified long")
    found = spark.read.schema("workbook_sha256 string, latest_run_id string, runs array<struct<run_id:string,artifacts:array<struct<name:string>>>>").option("multiLine", "true").json(f"{out}/workbooks/*/{INDEX}")
    listed = found.select(F.col("workbook_sha256").alias("sha256"), F.col("latest_run_id").alias("latest"), F.array_join(F.col("runs.run_id"), ",").alias("runs"), F.size(F.col("runs")[0]["artifacts"]).cast("long").alias("n_artifacts"))
    return by_file(listed.join(verified, "sha256", "left"), done.inventory).select("file", "latest", "runs", "n_artifacts", "verified")


def store_cells_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of all packages from the JSON of their runs."""
    done, out, _ = stored(spark, sf_dir)
    cells = cells_back(read_artifacts(spark, f"{out}/workbooks/*/{RUNS[1]}/inventory.json", "workbook_inventory"))
    return by_file(cells, done.inventory).select("file", F.col("sheet_name").alias("sheet"), F.col("row").alias("row_no"), F.col("column").alias("col_no"), "address", "kind", "value", F.col("number_format").alias("fmt"), "formula")


def source_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the packages below own/, from files in the shared folder, by the data source."""
    folder = f"{shared_folder(spark)}/books-{uuid.uuid4().hex}"
    odd_files(spark, sf_dir).select("file_name", "content").foreachPartition(lambda rows: put_files(folder, rows))
    register(spark)
    parts = spark.read.format("ooxml").load(folder).where("startswith(name, 'own/')")
    return parts.selectExpr("substring_index(path, '/', -1) as file", "part_seq", "name", "root", "xml is not null as has_text")


def put_files(folder: str, rows: Iterable[Row]) -> None:
    system, root = file_system(folder)
    for row in rows:
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{row.file_name}") as out:
            out.write(bytes(row.content))


_ROWS = f"""s as (
  select s_suppkey // {BOOK_SUPPLIERS} as book, s_suppkey as key, coalesce(s_name, '') as name, coalesce(round(s_acctbal * 100), 0)::bigint as cents,
         row_number() over (partition by s_suppkey // {BOOK_SUPPLIERS} order by s_suppkey) + 1 as r from supplier where s_suppkey is not null
), b as (
  select book, max(r) as last, sum(cents)::bigint as total from s group by book
)"""
_FORMULAS = {"E": "'=Q1!A' || r || '+FY24!$A$1'", "F": "'=SUM(A:A)/SUM(' || (r - 1) || ':' || (r - 1) || ')&\"B2\"'", "G": "'=SUM(B:B)/SUM(' || (r - 1) || ':' || (r - 1) || ')&\"B2\"'", "H": "'=Tab[Q1]*LOG10($A' || r || ')'"}
_CELLS = " union all ".join(
    [
        "select book, 'Q1' as sheet, r, 1 as c, 'value' as kind, key::varchar as value, 'General' as fmt, null as formula from s", "select book, 'Q1', r, 2, 'value', name, 'General', null from s", f"select book, 'Q1', r, 3, 'value', cents::varchar, '{KRONA}', null from s",
        "select book, 'Q1', 1, 1, 'value', 'head', 'General', null from b", "select book, 'FY24', 1, 1, 'value', total::varchar, 'General', null from b", *[f"select book, 'Q1', r, {ord(c) - 64}, 'formula', null, 'General', {f} from s" for c, f in _FORMULAS.items()],
    ]
)
_FILE = "'odd-' || book || '.xlsx' as file"
_URL = "'https://example.com/' || book || '|'"

QUERIES = {f.__name__: f for f in (odd_cells, odd_ranges, odd_manifest, odd_edges, store_records, store_index, store_cells_back, source_parts)}
ORACLES = {
    "odd_cells": f"with {_ROWS} select {_FILE}, sheet, r::bigint as row_no, c::bigint as col_no, chr((64 + c)::int) || r as address, kind, value, fmt, formula from ({_CELLS})",
    "odd_ranges": f"with {_ROWS} select {_FILE}, kind, sheet as sheet_name, address, told from (select book, 'freeze_panes' as kind, 'Q1' as sheet, 'A2' as address, '|' as told from b union all select book, 'conditional_formatting', 'Q1', 'C2:C' || last, '|' from b "
    f"union all select book, 'defined_name', 'Q1', '$A$2', '|' from b union all select book, 'hyperlink', 'Q1', unnest(['A2', 'B2', 'A3']), {_URL} from b union all select book, 'hyperlink', 'Q1', unnest(['B3', 'B4']), '|FY24!A1' from b)",
    "odd_manifest": f"with {_ROWS} select {_FILE}, 1::bigint as named, 'auto' as calc_mode, 'Q1:' || last || ':8,FY24:1:1' as sheets from b",
    "odd_edges": f"with {_ROWS} select {_FILE}, 'cell:Q1!' || cell as source, target from (select book, 'E' || r as cell, unnest(['cell:Q1!A' || r, 'cell:FY24!A1']) as target from s union all select book, unnest(['F', 'G']) || r, 'cell:Q1!B2' from s "
    "union all select book, 'H' || r, unnest(['external:=Tab[Q1]*LOG10($A' || r || ')', 'cell:Q1!Q1', 'cell:Q1!A' || r, 'cell:Q1!LOG10']) from s)",
    "store_records": f"with {_ROWS} select {_FILE}, run_id, name, not (name = 'artifact_index.json' and run_id = 'first') as hash_ok, not (name = 'artifact_index.json' and run_id = 'first') as size_ok, true as placed "
    "from b, (select unnest(['first', 'second']) as run_id), (select unnest(['workbook_manifest.json', 'inventory.json', 'dependency_graph.json', 'module_classification.json', 'confirmation_template.json', 'run_metadata.json', 'artifact_index.json']) as name)",
    "store_index": f"with {_ROWS} select {_FILE}, 'second' as latest, 'first,second' as runs, 6::bigint as n_artifacts, 7::bigint as verified from b",
}
ORACLES["store_cells_back"] = ORACLES["odd_cells"]
_OWN = (("book.xml", "workbook"), ("_rels/book.xml.rels", "Relationships"), ("look.xml", "styleSheet"), ("texts.xml", "sst"), ("first.xml", "worksheet"), ("_rels/first.xml.rels", "Relationships"), ("second.xml", "worksheet"), ("externalLinks/link.xml", "externalLink"))
ORACLES["source_parts"] = f"with {_ROWS}, p as ({' union all '.join(f"select {i + 2}::bigint as part_seq, 'own/{n}' as name, '{r}' as root" for i, (n, r) in enumerate(_OWN))}) select {_FILE}, part_seq, name, root, root <> 'externalLink' as has_text from b, p"

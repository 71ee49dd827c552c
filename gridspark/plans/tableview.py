"""Ordinary tables seen as sheets, so that the workbook operators run over tables of any size.

Each table is a sheet, cut into workbooks of a million keys as no sheet holds more rows: row 1 of the first holds the
column names, a row's number is its key within the workbook + 2, a column's letter its position. One more column,
`calc`, holds a formula made of the row's number; its kind follows from the key modulo eight. The view is a projection
and an explode of constant width: no shuffle, no row numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.text import letters_sql, location, location_sql
from gridspark.sources.tables import spread

VIEW, PATH, BOOK_ROWS = "view-0", "view.xlsx", 1_000_000
#: Rows of a table that one task makes cells of: what it sorts or hashes of them stays the same size, however long the table is.
TASK_ROWS = 100_000
#: (table, key, columns): the sheets in their order. Keys are unique and dense from 0.
SHEETS = (
    ("orders", "o_orderkey", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
    ("customer", "c_custkey", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    ("part", "p_partkey", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    ("supplier", "s_suppkey", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")),
)
#: The formula of a row by its key modulo 8; {r} is the row's number.
FORMULAS = (
    "=VLOOKUP(B{r},customer!$A$2:$E$1048576,4,0)*D{r}",
    "=SUM(D{r}:E{r})+A1",
    "='[prices.xlsx]Q 1'!$B${r}+D{r}",
    "=TotalPremium*2",
    "=IF(part!$F{r}>10,A{r},'My Sheet'!C$3)",
    "=1+2",
    "=[rates.xlsx]Sheet1!A1*INDEX(supplier!A{r}:D{r},1)",
    "=Table1[Col]",
)
#: Columns whose values are texts, and those whose number format is not General.
TEXT_COLUMNS = frozenset(c for _, _, cs in SHEETS for c in cs if c.endswith(("status", "priority", "name", "segment", "brand", "type")))
FORMATTED = {"o_totalprice": "#,##0.00", "c_acctbal": "#,##0.00", "p_retailprice": "0.00", "s_acctbal": "#,##0.00", "o_orderdate": "yyyy-mm-dd"}


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def formula_sql(key: str, row: str) -> str:
    """The formula of a row. Wide projections are written as SQL text: built column by column, they take longer to put
    together than a small table takes to read."""

    def pattern(text: str) -> str:
        return "concat(" + ", ".join(x for p in text.split("{r}") for x in (literal(p), f"cast({row} as string)")).rpartition(", ")[0] + ")"

    return f"case {key} % 8 " + " ".join(f"when {k} then {pattern(text)}" for k, text in enumerate(FORMULAS)) + " end"


def value_type(column: str, kind: str) -> str:
    if column in TEXT_COLUMNS or kind.startswith("timestamp"):
        return "string"
    return "double" if kind == "double" else "long"


def value_text(column: str, kind: str) -> str:
    """A value as a cell holds it: amounts with two decimals, dates with a time."""
    if kind == "double":
        return f"cast({column} as decimal(18, 2))"
    return f"date_format({column}, 'yyyy-MM-dd HH:mm:ss')" if kind.startswith(("timestamp", "date")) else column


def sheet_cells(spark: SparkSession, sf_dir: str, index: int) -> DataFrame:
    """The cells of one table, its header in the first workbook included."""
    name, key, columns = SHEETS[index]
    table = spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns), TASK_ROWS)
    kinds = dict(table.dtypes)
    row = f"cast({key} % {BOOK_ROWS} + 2 as long)"

    def cell(number: int, value: str, kind: str | None, shown: str, formula: str = "cast(null as string)", blank: str = "false") -> str:
        typed = "cast(null as string)" if kind is None else literal(kind)
        return f"named_struct('column', {number}L, 'value', cast({value} as string), 'value_type', {typed}, 'number_format', {literal(shown)}, 'formula', {formula}, 'blank', {blank})"

    data = []
    for i, c in enumerate(columns, 1):
        kind = value_type(c, kinds[c])
        data.append(cell(i, value_text(c, kinds[c]), kind, FORMATTED.get(c, "General"), blank=f"{c} is null"))
    data.append(cell(len(columns) + 1, "null", None, "General", formula_sql(key, row)))
    rows = table.where(f"{key} is not null").selectExpr(f"concat('view-', cast({key} div {BOOK_ROWS} as string)) as sha256", f"{row} as row", f"explode(array({', '.join(data)})) as c")
    titles = [cell(i, literal(c), "string", "General") for i, c in enumerate((*columns, "calc"), 1)]
    heads = spark.range(1).selectExpr(f"{literal(VIEW)} as sha256", "1L as row", f"explode(array({', '.join(titles)})) as c")
    cells = rows.unionByName(heads).where("not c.blank").select("sha256", "row", "c.*")
    sheet, path = literal(name), literal(PATH)
    placed = cells.selectExpr("*", f"concat({letters_sql('column')}, cast(row as string)) as address")
    return placed.selectExpr(
        "sha256", f"{sheet} as sheet_name", f"{index}L as sheet_index", "row", "column", "address", "if(formula is not null, 'formula', 'value') as kind", "value", "value_type", "'n' as data_type", "number_format",
        "formula", "0L as style_id", f"{location_sql(literal('cell'), path=path, sheet=sheet, index=str(index), address='address', object_id=f'concat({sheet}, {literal(chr(33))}, address)')} as loc",
    )


def view_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of all sheets."""
    cells = sheet_cells(spark, sf_dir, 0)
    for index in range(1, len(SHEETS)):
        cells = cells.unionByName(sheet_cells(spark, sf_dir, index))
    return cells


def filled_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha256) of the workbooks that hold a cell, from the tables' keys alone."""
    keys = [spark.read.parquet(f"{sf_dir}/{name}.parquet").where(f"{key} is not null").selectExpr(f"concat('view-', cast({key} div {BOOK_ROWS} as string)) as sha256").distinct() for name, key, _ in SHEETS]
    out = spark.range(1).select(F.lit(VIEW).alias("sha256"))
    for more in keys:
        out = out.unionByName(more)
    return out


def view_books(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(VIEW).alias("sha256"), F.lit(PATH).alias("path"))


def view_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation as a range of one of eleven kinds, each region as a defined name of the workbook."""
    kinds = ("merged_range", "table", "row_layout", "column_layout", "freeze_panes", "data_validation", "conditional_formatting", "comment", "hyperlink", "sheet_protection", "merged_range")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("n_nationkey") % 11 + 1).cast("int"))
    address = F.concat(F.lit("A"), (F.col("n_nationkey") + 1).cast("string"))
    empty = F.create_map().cast("map<string,string>")
    placed = nation.select(
        F.lit(VIEW).alias("sha256"), F.when(kind.isin("merged_range", "table"), "sheet_range").otherwise("layout").alias("scope"), F.lit("orders").alias("sheet_name"), F.lit(0).cast("long").alias("sheet_index"),
        F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("name"), address.alias("address"), kind.alias("kind"), empty.alias("metadata"),
        location(path=F.lit(PATH), object_type=kind, sheet=F.lit("orders"), index=F.lit(0), address=address).alias("loc"),
    )
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    name = F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).otherwise("")
    target = F.concat(F.lit("$B$"), (F.col("r_regionkey") + 2).cast("string"))
    named = region.select(
        F.lit(VIEW).alias("sha256"), F.lit("workbook").alias("scope"), F.lit("customer").alias("sheet_name"), F.lit(1).cast("long").alias("sheet_index"), F.col("r_regionkey").cast("long").alias("seq"), name.alias("name"),
        target.alias("address"), F.lit("defined_name").alias("kind"), empty.alias("metadata"), location(path=F.lit(PATH), object_type="defined_name", sheet=F.lit("customer"), index=F.lit(1), address=target).alias("loc"),
    )
    return placed.unionByName(named)


#: Part names by the number of a part's key modulo eleven.
PART_NAMES = (
    "xl/vbaProject.bin", "xl/pivotTables/pivot{k}.xml", "xl/charts/chart{k}.xml", "xl/drawings/drawing{k}.xml", "xl/externalLinks/link{k}.xml", "xl/connections.xml", "xl/embeddings/ole{k}.bin",
    "xl/media/image{k}.png", "xl/worksheets/sheet{k}.xml", "xl/charts/_rels/chart{k}.xml.rels", "docProps/app",
)


def view_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of `part` as a package part of the workbook that holds the row."""
    table = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    name = F.lit(None).cast("string")
    for k, pattern in enumerate(PART_NAMES):
        pieces = pattern.split("{k}")
        name = F.when(key % 11 == k, F.concat(*[x for p in pieces for x in (F.lit(p), key.cast("string"))][:-1])).otherwise(name)
    book = F.expr(f"concat('view-', cast(p_partkey div {BOOK_ROWS} as string))")
    return table.select(book.alias("sha256"), F.lit(PATH).alias("path"), key.cast("long").alias("part_seq"), name.alias("name"), F.col("p_size").cast("long").alias("size"))

"""The inventory of workbooks: manifests, sheets, cells, ranges and diagnostics, by joins over parsed elements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.functions.lexer import COLUMNS as SHEET_COLUMNS
from gridspark.functions.lexer import ROWS as SHEET_ROWS
from gridspark.functions.lexer import column_sql, compiled_sql, placed
from gridspark.functions.text import letters_sql, location_sql, sql_text
from gridspark.operators.package import file_type_problems, is_workbook, opaque_marker, opaque_problems, suffix, with_content_types
from gridspark.sources.ooxml import BULK, distinct_workbooks, read_elements, read_parts, read_workbooks
from gridspark.sources.tables import spread, written

# The number formats that have no text of their own in a workbook.
BUILT_IN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
WORKSHEET, TABLE, COMMENTS = "/worksheet", "/table", "/comments"
#: The parts that a workbook's relations name, and their names where these don't.
ROLES = {"book_part": ("/officeDocument", "xl/workbook.xml"), "styles_part": ("/styles", "xl/styles.xml"), "strings_part": ("/sharedStrings", "xl/sharedStrings.xml")}
#: The order of layout objects in a sheet: kind first, then place.
ROWS, COLUMNS, PANES, VALIDATIONS, FORMATS, CELL_MARKS, PROTECTION = (k << 48 for k in range(7))
#: Bytes of a row group of unzipped pieces: tasks that parse them are dealt row groups.
PARTS_BLOCK = 8 << 20
WHOLE_OR_PART = "if(name is null, 'workbook', 'ooxml_part')"
NOTE_REF = "attrs['ref']"
CELL_ID = "concat_ws('!', sheet_name, address)"
DESTINATION = r"((?:'(?:[^']|'')+'|[^'!,()*+\-/&<>= ]+))!(\$?[A-Z]{1,3}\$?[0-9]+(?::\$?[A-Z]{1,3}\$?[0-9]+)?)"


@dataclass(frozen=True)
class Inventory:
    workbooks: DataFrame
    manifest: DataFrame
    sheets: DataFrame
    parts: DataFrame
    cells: DataFrame
    ranges: DataFrame
    unsupported: DataFrame
    #: (sha256, kind, counted): what the parser counted itself, of cells (kind `cell`) and ranges by kind, where one element is one object.
    counted: DataFrame | None = None


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def truth(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin("1", "true"), F.lit(False))


def relations(facts: DataFrame) -> DataFrame:
    """(sha256, part, rel_id, type, target, external): target is a part's full name unless it is external; the package
    itself is part ''."""
    rows = facts.where("tag = 'Relationship'")
    owner = F.when(F.col("part") == "_rels/.rels", "").otherwise(F.regexp_replace("part", r"_rels/([^/]+)\.rels$", "$1"))
    folder, target = F.regexp_extract(owner, "^(.*/)?[^/]*$", 1), attr("Target")
    full = F.when(target.startswith("/"), F.substring(target, 2, 2**30)).otherwise(F.concat(folder, target))
    for _ in range(3):  # a/b/../c is a/c
        full = F.regexp_replace(full, r"(^|/)[^/.][^/]*/\.\./", "$1")
    external = F.coalesce(attr("TargetMode"), F.lit("")) == "External"
    return rows.select("sha256", owner.alias("part"), attr("Id").alias("rel_id"), attr("Type").alias("type"), F.when(external, target).otherwise(full).alias("target"), external.alias("external"))


def part_roles(books: DataFrame, rels: DataFrame) -> DataFrame:
    """(sha256, book_part, styles_part, strings_part) of each workbook."""
    named = rels.where("not external").groupBy("sha256").agg(*[F.min(F.when(F.col("type").endswith(kind) & ((F.col("part") == "") == (role == "book_part")), F.col("target"))).alias(role) for role, (kind, _) in ROLES.items()])
    return books.select("sha256").join(named, "sha256", "left").select("sha256", *[F.coalesce(role, F.lit(name)).alias(role) for role, (_, name) in ROLES.items()])


def in_role(elements: DataFrame, roles: DataFrame, role: str) -> DataFrame:
    """The elements of the part that has the role in its workbook."""
    return elements.join(roles.select("sha256", F.col(role).alias("part")), ["sha256", "part"], "left_semi")


def number_formats(styles: DataFrame) -> DataFrame:
    """(sha256, style_id, number_format) of every cell style, each once."""
    own = styles.where("tag = 'numFmt'").groupBy("sha256", attr("numFmtId").cast("long").alias("format_id")).agg(F.max_by(attr("formatCode"), "seq").alias("own"))
    cell_styles = styles.where("tag = 'xf'").select("sha256", F.col("nth").alias("style_id"), F.coalesce(attr("numFmtId"), F.lit("0")).cast("long").alias("format_id"))
    fixed = F.create_map(*[F.lit(x) for kv in BUILT_IN_FORMATS.items() for x in (kv[0], kv[1])])
    return cell_styles.join(own, ["sha256", "format_id"], "left").select("sha256", "style_id", F.coalesce("own", fixed[F.col("format_id").cast("int")], F.lit("General")).alias("number_format"))


def shared_strings(strings: DataFrame) -> DataFrame:
    """(sha256, v, shared): each text under its number. A string is numbered within its piece of the part; the strings of
    the pieces before are summed over one row a piece."""
    pieces = strings.where("tag = 'piece'").select("sha256", "piece", "nth")
    before = F.sum("nth").over(Window.partitionBy("sha256").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = pieces.select("sha256", "piece", before.alias("before")).where("before > 0")
    numbered = strings.where("tag = 'si'").join(offsets, ["sha256", "piece"], "left")
    return numbered.select("sha256", (F.col("nth") + F.coalesce("before", F.lit(0))).cast("string").alias("v"), F.col("text").alias("shared"))


def with_shared_formulas(cells: DataFrame) -> DataFrame:
    """cells with f written out where it is shared: the first of a sheet's cells with the same number that has a text is
    read once, and the others are placed from what it read."""
    shared = cells.where("si is not null")
    first = F.min_by(F.struct("f", "row_no", "col_no"), "seq")
    masters = shared.where("f is not null").groupBy("sha256", "part", "si").agg(first.alias("m"))
    masters = masters.selectExpr("sha256", "part", "si", f"{compiled_sql('m.f')} as template", "m.row_no as at_row", "m.col_no as at_col")
    text = placed("template", "(col_no - at_col)", "(row_no - at_row)")
    out = shared.join(masters, ["sha256", "part", "si"], "left").withColumn("f", text)
    return cells.where("si is null").unionByName(out.select(*cells.columns))


def is_date_format(number_format: Column) -> Column:
    bare = F.regexp_replace(number_format, r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "")
    return F.lower(bare).rlike("[dmhys]") & (number_format != "General")


def date_text(serial: Column, from_1904: Column) -> Column:
    """A date serial number as text, with microseconds where there are any."""
    days = serial + F.when(from_1904, 1462).otherwise(F.when(serial < 60, 1).otherwise(0))
    at = F.timestamp_micros(F.round((days - 25569) * 86400000000).cast("long"))
    micros = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))


def worksheets(book: DataFrame, rels: DataFrame) -> DataFrame:
    """(sha256, path, part, sheet_name, sheet_index, state) of worksheets, in the workbook's order. book: the elements of
    the workbooks' own parts."""
    listed = book.where("tag = 'sheet'").select("sha256", "path", "part", "seq", attr("name").alias("sheet_name"), F.coalesce(attr("state"), F.lit("visible")).alias("state"), attr("r:id").alias("rel_id"))
    found = listed.join(rels.where(F.col("type").endswith(WORKSHEET)).select("sha256", "part", "rel_id", F.col("target").alias("sheet_part")), ["sha256", "part", "rel_id"])
    order = Window.partitionBy("sha256").orderBy("seq")
    return found.select("sha256", "path", F.col("sheet_part").alias("part"), "sheet_name", (F.row_number().over(order) - 1).cast("long").alias("sheet_index"), "state")


def cells_of(content: DataFrame, sheets: DataFrame, strings: DataFrame, formats: DataFrame, book: DataFrame) -> DataFrame:
    """The cells that hold something: (sheets' and strings' elements, worksheets, shared_strings, number_formats, the
    workbooks' elements). No join is one to many, so there are as many cells as the sheets have. Only the cells that show a
    shared string meet the strings, so only these are shuffled where the strings are many; what is known of a whole sheet
    or format (its epoch, whether it is a date) is worked out there and not cell by cell."""
    raw = content.where("tag = 'c' and (v is not null or f is not null or si is not null or inline is not null)").select("sha256", "part", "seq", "row_no", "col_no", "t", "style_id", "v", "f", "si", "inline")
    dated = book.where("tag = 'workbookPr'").groupBy("sha256").agg(F.max(truth(attr("date1904"))).alias("from_1904"))
    epochs = sheets.select("sha256", "part", "path", "sheet_name", "sheet_index").join(dated, "sha256", "left")
    kinds = formats.withColumn("shows_date", is_date_format(F.col("number_format")))
    is_text = "t = 's' and f is null and si is null"  # a formula's value isn't kept
    texts = raw.where(is_text).join(strings, ["sha256", "v"], "left")
    others = with_shared_formulas(raw.where(f"not ({is_text})")).withColumn("shared", F.lit(None).cast("string"))
    joined = (
        texts.unionByName(others).selectExpr("*", f"concat({letters_sql('col_no')}, cast(row_no as string)) as address")
        .join(epochs, ["sha256", "part"]).join(kinds, ["sha256", "style_id"], "left")
    )
    shown, number = F.coalesce("number_format", F.lit("General")), F.expr("try_cast(v as double)")
    read = joined.withColumns({"shown": shown, "is_date": (F.col("t") == "n") & F.coalesce("shows_date", F.lit(False)) & number.isNotNull(), "date": date_text(number, F.coalesce("from_1904", F.lit(False)))})
    truth_text = "case when lower(v) in ('1', 'true') then 'true' else 'false' end"
    valued = read.selectExpr(
        "*", f"coalesce(case when t = 's' then coalesce(shared, if(v is null, null, '')) when t = 'inlineStr' then inline when t = 'b' and v is not null then {truth_text} when is_date then date end, v, inline) as value",
        r"case when t = 'b' then 'boolean' when t <> 'n' or is_date then 'string' when v rlike r'^[+-]?[0-9]{1,18}$' then 'long' else 'double' end as value_type",
    )
    # a text that begins with = counts as a formula; a shared one without a first cell is =
    says = "coalesce(concat('=', f), if(si is null, null, '='), case when value_type = 'string' and startswith(value, '=') then value end)"
    filled = valued.selectExpr("*", f"{says} as formula").where("formula is not null or value is not null")
    return filled.selectExpr(
        "sha256", "sheet_name", "sheet_index", "row_no as row", "col_no as column", "address", "if(formula is null, 'value', 'formula') as kind",
        "if(formula is null, value, null) as value", "if(formula is null, value_type, null) as value_type",
        "case when f is not null then 'f' when is_date or t = 'd' then 'd' when t in ('inlineStr', 's', 'str') then 's' else t end as data_type", "shown as number_format", "formula", "style_id",
        f"{location_sql(sql_text('cell'), sheet='sheet_name', index='sheet_index', address='address', object_id=CELL_ID)} as loc",
    )


RANGE = ("sha256", "path", "scope", "sheet_name", "sheet_index", "seq", "name", "address", "kind", "metadata", "object_id", "placed")


def _ranges(rows: DataFrame, scope: str, kind: str, seq: str, address: str, object_id: str, metadata: str = "map()", name: str = "null", placed: str = "true") -> DataFrame:
    """Rows of ranges by SQL text; `located` gives them their provenance."""
    text = {"scope": scope, "kind": kind, "seq": f"cast({seq} as bigint)", "name": f"cast({name} as string)", "address": address, "metadata": f"cast({metadata} as map<string,string>)", "object_id": object_id, "placed": placed}
    return rows.selectExpr(*[f"{text[c]} as {c}" if c in text else c for c in RANGE])


def located(ranges: DataFrame) -> DataFrame:
    loc = location_sql("kind", sheet="sheet_name", index="sheet_index", address="if(placed, address, null)", object_id="object_id")
    return ranges.selectExpr("sha256", "scope", "sheet_name", "sheet_index", "seq", "name", "address", "kind", "metadata", f"{loc} as loc")


#: A sheet's own elements: (tag, when it counts, scope, kind, seq, address, object id, metadata).
HIDDEN = "coalesce(lower(attrs['hidden']) in ('1', 'true'), false)"
HEIGHT, WIDTH = "try_cast(attrs['ht'] as double)", "coalesce(try_cast(attrs['width'] as double), 13.0D)"
COLUMN = letters_sql("try_cast(attrs['min'] as bigint)")
SHEET_OBJECTS = (
    ("mergeCell", "true", "sheet_range", "merged_range", "seq", "attrs['ref']", "attrs['ref']", "map()"),
    ("row", f"({HIDDEN} or {HEIGHT} <> 0)", "layout", "row_layout", f"{ROWS} + row_no", "cast(row_no as string)", "concat('row:', row_no)", f"map('hidden', cast({HIDDEN} as string), 'height', cast({HEIGHT} as string))"),
    ("col", f"({HIDDEN} or {WIDTH} <> 0)", "layout", "column_layout", f"{COLUMNS} + try_cast(attrs['min'] as bigint)", COLUMN, f"concat('col:', {COLUMN})", f"map('hidden', cast({HIDDEN} as string), 'width', cast({WIDTH} as string))"),
    ("pane", "nth = 0 and attrs['state'] in ('frozen', 'frozenSplit') and attrs['topLeftCell'] is not null", "layout", "freeze_panes", f"{PANES}", "attrs['topLeftCell']", "'freeze_panes'", "map()"),
    ("dataValidation", "true", "layout", "data_validation", f"{VALIDATIONS} + seq", "attrs['sqref']", "concat('dv:', attrs['sqref'])", "map('type', attrs['type'], 'formula1', attrs['formula1'], 'formula2', attrs['formula2'])"),
    ("sheetProtection", "coalesce(lower(attrs['sheet']) in ('1', 'true'), false)", "layout", "sheet_protection", f"{PROTECTION}", "'sheet'", "'sheet_protection'", "map()"),
)


def area_sql(ref: str) -> str:
    """struct<top, left, bottom, right> of an area like A1, A1:B2, A:B or 1:2 as SQL text; null for any other text."""
    pattern = sql_text(r"^\$?([A-Za-z]{0,3})\$?([0-9]{0,7})(?::\$?([A-Za-z]{0,3})\$?([0-9]{0,7}))?$")
    part = lambda k: f"nullif(regexp_extract({ref}, {pattern}, {k}), '')"
    row, column = lambda k: f"cast({part(k)} as bigint)", lambda k: f"if({part(k)} is null, null, {column_sql(part(k))})"
    two = f"contains({ref}, ':')"
    top, bottom = f"coalesce({row(2)}, if({two}, 1L, null))", f"coalesce({row(4)}, if({two}, {SHEET_ROWS}L, {row(2)}))"
    left, right = f"coalesce({column(1)}, if({two}, 1L, null))", f"coalesce({column(3)}, if({two}, {SHEET_COLUMNS}L, {column(1)}))"
    box = f"named_struct('top', least({top}, {bottom}), 'left', least({left}, {right}), 'bottom', greatest({top}, {bottom}), 'right', greatest({left}, {right}))"
    return f"case when {ref} rlike {pattern} and {top} is not null and {bottom} is not null and {left} is not null and {right} is not null then {box} end"


def cells_under(areas: DataFrame, used: DataFrame) -> DataFrame:
    """areas (with sha256, part and ref) with row_no, col_no and cell, a row for each cell of the area. Whole columns and
    rows reach as far as the sheet is used (max_row, max_column of `used`)."""
    boxed = areas.selectExpr("*", f"{area_sql('ref')} as box").where("box is not null").join(used, ["sha256", "part"], "left")
    clipped = lambda end, start, whole, most: f"if(box.{end} = {whole}, least(box.{end}, greatest(box.{start}, coalesce({most}, 1L))), box.{end})"
    rows = boxed.selectExpr("*", f"explode(sequence(box.top, {clipped('bottom', 'top', SHEET_ROWS, 'max_row')})) as row_no")
    cells = rows.selectExpr("*", f"explode(sequence(box.left, {clipped('right', 'left', SHEET_COLUMNS, 'max_column')})) as col_no")
    return cells.selectExpr("*", f"concat({letters_sql('col_no')}, cast(row_no as string)) as cell").drop("box", "max_row", "max_column")


def ranges_of(content: DataFrame, facts: DataFrame, book: DataFrame, sheets: DataFrame, rels: DataFrame, used: DataFrame) -> DataFrame:
    """Merged cells and tables (scope sheet_range), layout objects (layout) and defined names (workbook)."""
    sheet = ["sha256", "part", "path", "sheet_name", "sheet_index"]
    placed_sheets = sheets.select(*sheet)
    on_sheet = written(content.where("tag not in ('c', 'si', 'piece', 'error') and (tag <> 'row' or attrs['hidden'] is not null or attrs['ht'] is not null)").select("sha256", "part", "seq", "nth", "tag", "attrs", "row_no")).join(placed_sheets, ["sha256", "part"])
    of = lambda tag: on_sheet.where(f"tag = '{tag}'")
    linked = lambda kind: placed_sheets.join(rels.where(f"endswith(type, '{kind}') and not external").select("sha256", "part", "rel_id", "target"), ["sha256", "part"])
    choose = lambda k: "case tag " + " ".join(f"when '{o[0]}' then {o[k]}" for o in SHEET_OBJECTS) + " end"
    named = lambda k: "case tag " + " ".join(f"when '{o[0]}' then '{o[k]}'" for o in SHEET_OBJECTS) + " end"
    objects = on_sheet.where(" or ".join(f"tag = '{o[0]}' and {o[1]}" for o in SHEET_OBJECTS))

    formats = of("conditionalFormatting").selectExpr("*", "attrs['sqref'] as sqref").where("sqref is not null").groupBy(*sheet, "sqref").agg(F.min("seq").alias("seq"))  # equal areas count once
    tables = facts.where("tag = 'table'").select("sha256", F.col("part").alias("target"), "attrs")
    table_rows = linked(TABLE).join(tables, ["sha256", "target"]).join(of("tablePart").selectExpr("sha256", "part", "attrs['r:id'] as rel_id", "seq"), ["sha256", "part", "rel_id"])
    authors = facts.where("tag = 'author'").selectExpr("sha256", "part as target", "cast(nth as string) as author_id", "coalesce(text, '') as author")
    noted = facts.where("tag = 'comment'").selectExpr("sha256", "part as target", "attrs['ref'] as cell", "attrs['authorId'] as author_id", "text as said", f"{area_sql(NOTE_REF)} as box")
    comments = linked(COMMENTS).join(noted, ["sha256", "target"]).join(authors, ["sha256", "target", "author_id"], "left").selectExpr("*", "box.top as row_no", "box.left as col_no")
    marked = of("hyperlink").drop("row_no").selectExpr("*", "attrs['ref'] as ref", "attrs['r:id'] as rel_id", "attrs['location'] as place")
    last = cells_under(marked, used).groupBy(*sheet, "cell", "row_no", "col_no").agg(F.max_by(F.struct("rel_id", "place"), "seq").alias("link"))  # a later link takes a cell over
    links = last.selectExpr(*sheet, "cell", "row_no", "col_no", "link.rel_id", "link.place").join(rels.select("sha256", "part", "rel_id", "target"), ["sha256", "part", "rel_id"], "left")
    mark = lambda k: f"{CELL_MARKS} + row_no * 65536 + col_no * 2 + {k}"

    out = [
        _ranges(objects, named(2), named(3), choose(4), choose(5), choose(6), choose(7), placed="tag <> 'sheetProtection'"),
        _ranges(table_rows, "'sheet_range'", "'table'", f"seq + {2**40}", "attrs['ref']", "attrs['name']", "map('display_name', attrs['displayName'])", "attrs['name']"),
        _ranges(formats, "'layout'", "'conditional_formatting'", f"{FORMATS} + seq", "sqref", "concat('cf:', sqref)"),
        _ranges(comments, "'layout'", "'comment'", mark(0), "cell", "concat('comment:', cell)", "map('text', said, 'author', author)"),
        _ranges(links, "'layout'", "'hyperlink'", mark(1), "cell", "concat('hyperlink:', cell)", "map('target', target, 'location', place)"),
        names_of(book, sheets),
    ]
    ranges = out[0]
    for more in out[1:]:
        ranges = ranges.unionByName(more)
    return located(ranges)


def destinations(text: Column) -> Column:
    """array<struct<sheet, address>> of a defined name that lists ranges; empty for any other."""
    item = r"\s*" + DESTINATION.replace("((?:", "(?:(?:", 1).replace("!(", "!(?:") + r"\s*"
    sheets = F.transform(F.regexp_extract_all(text, F.lit(DESTINATION), F.lit(1)), lambda s: F.replace(F.btrim(s, F.lit("'")), F.lit("''"), F.lit("'")))
    pairs = F.arrays_zip(sheets.alias("sheet"), F.regexp_extract_all(text, F.lit(DESTINATION), F.lit(2)).alias("address"))
    return F.when(text.rlike(f"^{item}(?:,{item})*$"), pairs).otherwise(F.array().cast("array<struct<sheet:string,address:string>>"))


def names_of(book: DataFrame, sheets: DataFrame) -> DataFrame:
    """Names of workbook scope, one row for each destination; a name without any has one row and no sheet."""
    names = book.where("tag = 'definedName' and attrs['localSheetId'] is null").selectExpr("sha256", "path", "seq", "attrs['name'] as name", "coalesce(text, '') as says")
    rows = names.select("*", F.posexplode_outer(destinations(F.col("says"))).alias("k", "d")).selectExpr("*", "d.sheet as sheet_name", "d.address as address")
    known = rows.join(sheets.groupBy("sha256", "sheet_name").agg(F.min("sheet_index").alias("sheet_index")), ["sha256", "sheet_name"], "left")
    return _ranges(known, "'workbook'", "'defined_name'", "seq * 65536 + coalesce(k, 0)", "coalesce(address, says)", "name", "map('scope', 'workbook')", "name", "sheet_name is not null")


def inventory(spark: SparkSession, paths: str | list[str]) -> Inventory:
    """All frames of the workbooks under `paths`."""
    return inventory_of(read_workbooks(spark, paths))


def inventory_of(files: DataFrame) -> Inventory:
    """All frames of the workbooks in `files` (read_workbooks). Packages are unzipped and parsed once, here: pieces and
    elements are tables in the shared folder, so that nothing of an earlier call is used again, and a lost executor costs
    nothing. The few facts of a workbook (relations, sheets, styles, names) are a table apart from the content of its
    sheets, so that the planner knows how small they are: it broadcasts them, or else joins by shuffle and splits what is
    skewed. `temporary_tables` deletes the tables when the frames have been used."""
    books = written(distinct_workbooks(files))
    raw = written(read_parts(files.join(books.select("sha256", "path"), ["sha256", "path"], "left_semi")), block_bytes=PARTS_BLOCK)
    bulk = F.coalesce(F.col("root").isin(*BULK), F.lit(False))
    facts = written(read_elements(spread(raw.where(~bulk))))
    content = written(read_elements(spread(raw.where(bulk))))  # the sheets of a few small files, and the pieces of a large one, are parsed by all cores
    rels = relations(facts)
    roles = written(part_roles(books, rels))
    book = in_role(facts, roles, "book_part")
    sheets = written(worksheets(book, rels))
    types = lambda tag, key: facts.where(F.col("tag") == tag).select("sha256", attr(key).alias("name" if tag == "Override" else "extension"), attr("ContentType").alias("content_type"))
    entries = raw.where("error is null and piece = 0").select("sha256", "path", "part_seq", "name", "size")
    readable = facts.where("part = '[Content_Types].xml' and tag <> 'error'").select("sha256").distinct().withColumn("typed", F.lit(True))
    parts = (
        with_content_types(entries, types("Override", "PartName"), types("Default", "Extension")).join(readable, "sha256", "left")
        .withColumns({"content_type": F.when(F.col("typed"), F.col("content_type")), "relationship_type": F.lit(None).cast("string"), "opaque": opaque_marker(F.col("name")).isNotNull(),
                      "loc": F.expr(location_sql(sql_text("ooxml_part"), object_id="name", part="name"))}).drop("typed")
    )
    unsupported = file_type_problems(books).unionByName(opaque_problems(entries)).unionByName(corrupt_problems(raw, facts, content))
    used = content.where("tag = 'c'").groupBy("sha256", "part").agg(F.max("row_no").alias("max_row"), F.max("col_no").alias("max_column"))
    sized = sheets.join(used, ["sha256", "part"], "left").withColumns({"max_row": F.coalesce("max_row", F.lit(1).cast("long")), "max_column": F.coalesce("max_column", F.lit(1).cast("long"))})
    macro = raw.groupBy("sha256").agg(F.bool_or(F.col("name").contains("vbaProject.bin")).alias("vba"), F.bool_or(F.col("root") == "workbook").alias("whole"))
    global_names = book.where((F.col("tag") == "definedName") & attr("localSheetId").isNull()).groupBy("sha256").agg(F.countDistinct(attr("name")).alias("named"))
    calc = book.where("tag = 'calcPr'").groupBy("sha256").agg(F.max(F.coalesce(attr("calcMode"), F.lit("auto"))).alias("calc_mode"))
    counted = books.join(macro, "sha256", "left").join(global_names, "sha256", "left").join(calc, "sha256", "left")
    manifest = counted.select(
        "sha256", F.col("path").alias("workbook_path"), "other_paths", "file_name", "file_size",
        (is_workbook(F.col("path")) & ((F.lower(suffix(F.col("path"))) == "xlsm") | F.coalesce("vba", F.lit(False)))).alias("is_macro_enabled"),
        F.coalesce("named", F.lit(0)).cast("long").alias("named_ranges_count"),
        F.coalesce("calc_mode", F.when(F.col("whole"), "auto")).alias("calc_mode"),  # automatic where a workbook doesn't say
    )
    cells = cells_of(content, sheets, shared_strings(in_role(content.where("tag in ('si', 'piece')"), roles, "strings_part")), number_formats(in_role(facts, roles, "styles_part")), book)
    return Inventory(books, manifest, sized, parts, cells, ranges_of(content, facts, book, sheets, rels, used), unsupported, counted_objects(content, sheets))


def counted_objects(content: DataFrame, sheets: DataFrame) -> DataFrame:
    """(sha256, kind, counted): the parser's counts of the sheets' pieces, summed."""
    kinds = ", ".join(f"'{tag}', '{kind}'" for tag, kind in (("c", "cell"), *((o[0], o[3]) for o in SHEET_OBJECTS)))
    told = content.where("tag = 'piece'").select("sha256", "part", "attrs").join(sheets.select("sha256", "part"), ["sha256", "part"])
    return told.select("sha256", F.explode("attrs").alias("tag", "n")).selectExpr("sha256", f"map({kinds})[tag] as kind", "cast(n as bigint) as n").groupBy("sha256", "kind").agg(F.sum("n").alias("counted"))


def corrupt_problems(raw: DataFrame, facts: DataFrame, content: DataFrame) -> DataFrame:
    """A diagnostic for each package that is no zip, and each part that can't be unzipped, is too large, or is no XML."""
    packages = raw.where("error is not null").select("sha256", "path", F.when(F.col("piece") == 0, F.lit(-1).cast("long")).otherwise(F.col("part_seq")).alias("at"), "name", F.col("error").alias("says"))
    parsed = [df.where("tag = 'error'").select("sha256", "path", attr("part_seq").cast("long").alias("at"), F.col("part").alias("name"), F.col("text").alias("says")) for df in (facts, content)]
    broken = parsed[0].unionByName(parsed[1]).groupBy("sha256", "path", "at", "name").agg(F.min("says").alias("says"))
    rows = packages.unionByName(broken)
    return rows.selectExpr(
        "sha256", "'inventory' as origin", "array(at) as seq", "if(name is null, 'corrupt_package', 'corrupt_part') as feature_type",
        "concat(if(name is null, 'Package cannot be read: ', concat('Part cannot be read: ', name, ': ')), says) as description", "'error' as severity", "true as opaque",
        "cast(map() as map<string,string>) as metadata", f"{location_sql(WHOLE_OR_PART, object_id='name', part='name')} as loc",
    )

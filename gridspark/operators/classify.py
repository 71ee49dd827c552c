"""Module classes by ordered rules, each a CASE expression that stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.formula import label, uses_lookup
from gridspark.functions.text import hints, location

# Category, confidence and reason of each rule.
LOOKUP = ("lookup_block", 0.8, "formula uses lookup function")
FORMULA = ("formula_block", 0.75, "cell contains formula; dependencies parsed separately")
FORMATTED = ("input", 0.55, "literal cell with explicit number format")
LABEL = ("presentation", 0.6, "text label or presentation content")
LITERAL = ("input", 0.5, "literal value cell")
TABLE = ("data_table", 0.85, "Excel table object")
LAYOUT = ("presentation", 0.6, "layout/presentation object: ")
VALIDATION = ("input", 0.65, "data validation constrains input")
CATCH_ALL = ("other", 0.4, "catch-all classification for ")
LAYOUT_KINDS = ("merged_range", "row_layout", "column_layout", "freeze_panes", "conditional_formatting")
EMPTY = ("other", 0.1, "empty workbook catch-all")
#: The order of items in a workbook: by sheet its cells, ranges and layout, then names, then diagnostics.
CELL_STEP, RANGE_STEP, LAYOUT_STEP, AFTER_SHEETS = 0, 1, 2, 2**40


def verdict(rule: tuple[str, float, str], suffix: Column | None = None) -> Column:
    category, confidence, reason = rule
    said = F.lit(reason) if suffix is None else F.concat(F.lit(reason), suffix)
    return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.array(said).alias("reasons"))


def cell_rule() -> Column:
    formula = F.coalesce(F.col("formula"), F.lit("")) != ""
    return (
        F.when(formula & uses_lookup(F.col("formula")), verdict(LOOKUP)).when(formula, verdict(FORMULA))
        .when((F.coalesce(F.col("number_format"), F.lit("")) != "") & (F.col("number_format") != "General"), verdict(FORMATTED))
        .when(F.col("value_type") == "string", verdict(LABEL)).otherwise(verdict(LITERAL))
    )


def range_rule() -> Column:
    kind = F.col("kind")
    return (
        F.when(kind == "table", verdict(TABLE)).when(kind.isin(*LAYOUT_KINDS), verdict(LAYOUT, kind))
        .when(kind == "data_validation", verdict(VALIDATION)).otherwise(verdict(CATCH_ALL, kind))
    )


def hint_text() -> Column:
    """The text that hints are read from: the value unless it is empty, zero or false, else the formula."""
    empty = F.col("value").isNull() | (F.col("value") == "") | (F.col("value_type").isin("long", "double") & (F.expr("try_cast(value as double)") == 0)) | ((F.col("value_type") == "boolean") & (F.lower("value") == "false"))
    return F.when(~empty, F.col("value")).otherwise(F.coalesce("formula", F.lit("")))


def _items(rows: DataFrame, seq: Column, item: Column, rule: Column, refs: list[str], hinted: Column) -> DataFrame:
    return rows.select("sha256", seq.cast("array<long>").alias("seq"), item.alias("id"), rule.alias("v"), F.array(*map(F.lit, refs)).alias("source_artifact_refs"), hinted.alias("hints"), "loc").select(
        "sha256", "seq", "id", "v.category", "v.confidence", "v.reasons", "source_artifact_refs", "hints", "loc"
    )


def no_hints() -> Column:
    return F.array().cast("array<string>")


def cell_items(cells: DataFrame) -> DataFrame:
    return _items(
        cells, F.array("sheet_index", F.lit(CELL_STEP), "row", "column"), F.concat(F.lit("cell:"), label(F.col("sheet_name"), F.col("address"))), cell_rule(),
        ["inventory", "dependency_graph"], hints(hint_text()),
    )


def range_items(ranges: DataFrame) -> DataFrame:
    """Ranges and layout of sheets, and names of the workbook."""
    named = F.col("scope") == "workbook"
    step = F.when(F.col("scope") == "layout", LAYOUT_STEP).otherwise(RANGE_STEP)
    place = F.when(named, F.array(F.lit(AFTER_SHEETS), F.lit(0), F.col("seq"), F.lit(0))).otherwise(F.array(F.col("sheet_index"), step, F.col("seq"), F.lit(0)))
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("address"))
    item = F.concat(F.col("kind"), F.lit(":"), F.when(named, name).otherwise(label(F.col("sheet_name"), F.col("address"))))
    return _items(ranges, place, item, range_rule(), ["inventory"], no_hints())


def unsupported_items(unsupported: DataFrame) -> DataFrame:
    """Diagnostics get an ordinal within the workbook: those of the inventory first, then those of the graph."""
    origin = F.when(F.col("origin") == "inventory", 0).otherwise(1)
    order = Window.partitionBy("sha256").orderBy(origin, "seq")
    ranked = unsupported.withColumn("n", (F.row_number().over(order) - 1).cast("long"))
    said = F.struct(F.lit("unsupported_opaque").alias("category"), F.lit(1.0).alias("confidence"), F.array("description").alias("reasons"))
    return _items(ranked, F.array(F.lit(AFTER_SHEETS), F.lit(1), F.col("n"), F.lit(0)), F.concat_ws(":", F.lit("unsupported"), F.col("n").cast("string"), "feature_type"), said, ["inventory", "dependency_graph"], no_hints())


def empty_items(workbooks: DataFrame, items: DataFrame) -> DataFrame:
    """A catch-all item for every workbook without any."""
    bare = workbooks.select("sha256").distinct().join(items.select("sha256").distinct(), "sha256", "left_anti")
    bare = bare.withColumn("loc", location(path=F.lit("unknown"), object_type="workbook"))
    return _items(bare, F.array(F.lit(AFTER_SHEETS), F.lit(2), F.lit(0), F.lit(0)), F.lit("workbook:empty"), verdict(EMPTY), [], no_hints()).withColumn("source_artifact_refs", no_hints())


def classify(workbooks: DataFrame, cells: DataFrame, ranges: DataFrame, unsupported: DataFrame, filled: DataFrame | None = None) -> DataFrame:
    """All items: (sha256, seq, id, category, confidence, reasons, source_artifact_refs, hints, loc). filled: the workbooks
    that hold anything (sha256), where the caller knows them without another pass over cells, ranges and diagnostics. The
    graph's diagnostics are of cells, so the formulas aren't read a second time for these."""
    items = cell_items(cells).unionByName(range_items(ranges)).unionByName(unsupported_items(unsupported))
    if filled is None:
        filled = cells.select("sha256").unionByName(ranges.select("sha256")).unionByName(unsupported.where("origin <> 'graph'").select("sha256"))
    return items.unionByName(empty_items(workbooks, filled))

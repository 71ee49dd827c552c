"""Counts of what was recognised and what was not, and checks of every frame's constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.contracts import CATEGORIES
from gridspark.operators.inventory import SHEET_OBJECTS


def coverage(workbooks: DataFrame, cells: DataFrame, ranges: DataFrame, unsupported: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(sha256, recognized, opaque, discovered) of each workbook: cells and ranges are recognized, the inventory's diagnostics
    opaque. Diagnostics of the graph don't count. What was discovered is their sum, where `counted` has nothing to say; of
    the kinds that it has (sha256, kind, counted: the parser's own counts) it takes these instead of the frames' rows. So
    objects that a frame has lost or doubled break the equation, which `holds` guards."""
    rows = cells.select("sha256", F.lit("cell").alias("kind")).unionByName(ranges.select("sha256", "kind"))
    by_kind = rows.groupBy("sha256", "kind").agg(F.count(F.lit(1)).alias("n"))
    if counted is None:
        found = by_kind.select("sha256", F.col("n").alias("recognized"), F.lit(0).cast("long").alias("opaque"), F.col("n").alias("discovered"))
    else:
        both = by_kind.unionByName(counted.select("sha256", "kind", "counted"), allowMissingColumns=True).groupBy("sha256", "kind").agg(F.sum("n").alias("n"), F.sum("counted").alias("counted"))
        own = counted_kinds()
        found = both.select("sha256", F.coalesce("n", F.lit(0)).alias("recognized"), F.lit(0).cast("long").alias("opaque"), F.when(F.col("kind").isin(*own), F.coalesce("counted", F.lit(0))).otherwise(F.coalesce("n", F.lit(0))).alias("discovered"))
    problems = unsupported.where("origin = 'inventory'").groupBy("sha256").agg(F.count(F.lit(1)).alias("opaque"))
    zero = F.lit(0).cast("long")
    parts = found.unionByName(problems.select("sha256", zero.alias("recognized"), "opaque", F.col("opaque").alias("discovered")))
    known = workbooks.select("sha256").distinct().select("sha256", zero.alias("recognized"), zero.alias("opaque"), zero.alias("discovered"))
    return known.unionByName(parts).groupBy("sha256").agg(*[F.sum(c).alias(c) for c in ("recognized", "opaque", "discovered")])


def counted_kinds() -> list[str]:
    """The kinds of objects that the parser counts."""
    return ["cell", *(o[3] for o in SHEET_OBJECTS)]


def holds(covered: DataFrame) -> DataFrame:
    """covered, failing at run time where the equation doesn't hold."""
    right = F.col("recognized") + F.col("opaque") == F.col("discovered")
    return covered.withColumn("discovered", F.when(right, F.col("discovered")).otherwise(F.raise_error(F.lit("coverage equation violated")).cast("long")))


def location_problem(loc: str | Column = "loc") -> Column:
    """What is wrong with a location; null if nothing is."""
    c = F.col(loc) if isinstance(loc, str) else loc
    there = lambda name: F.coalesce(c[name], F.lit("")) != ""
    return (
        F.when(~(there("sheet_name") | there("ooxml_part") | there("workbook_path")), "no sheet, part or workbook")
        .when(there("address") & ~there("sheet_name"), "address without sheet").when(c["sheet_index"] < 0, "negative sheet index")
    )


def bound_problem() -> Column:
    """What is wrong with a cell's numbers; null if nothing is."""
    return F.when(F.col("row") < 1, "row below 1").when(F.col("column") < 1, "column below 1").when(F.col("sheet_index") < 0, "negative sheet index")


def confidence_problem() -> Column:
    """What is wrong with an item's confidence or category; null if nothing is."""
    return F.when(~F.col("confidence").between(0.0, 1.0) | F.col("confidence").isNull(), "confidence outside 0 to 1").when(~F.col("category").isin(*CATEGORIES), "unknown category")


def sheet_counts(cells: DataFrame) -> DataFrame:
    """(sha256, sheet_name, kind, n): a small report of the inventory."""
    return cells.groupBy("sha256", "sheet_name", "kind").agg(F.count(F.lit(1)).alias("n"))

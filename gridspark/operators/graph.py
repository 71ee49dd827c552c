"""The formula reference graph: nodes, edges and what could not be read.

All that a formula emits (itself as a node, an external workbook, a diagnostic, its references) is put into one array
and exploded once, so formulas are scanned and their pattern applied a single time. Every emitted row carries its
place (sheet, row, column, step); a node that is emitted more than once is the one emitted first, found by min_by in
a hash aggregation that combines before the shuffle, not by a sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.formula import is_external, label, references
from gridspark.functions.text import location, python_repr


@dataclass(frozen=True)
class FormulaGraph:
    nodes: DataFrame
    edges: DataFrame
    unsupported: DataFrame


def formula_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("formula") != "")


def emissions(cells: DataFrame) -> DataFrame:
    """(sha256, seq, source, id, kind, label, formula, cell_loc, target_loc) of all that the formulas emit. Steps: 0 the
    formula's own cell, 1 an external workbook, 2 a diagnostic, from 3 on its references in order."""
    formulas = formula_cells(cells).select(
        "sha256", "sheet_name", "sheet_index", "row", "column", "formula", F.col("loc").alias("cell_loc"),
        label(F.col("sheet_name"), F.col("address")).alias("own"), references(F.col("formula"), F.col("sheet_name")).alias("refs"),
    )

    def emitted(step: int, kind: str, text: str, when=None):
        row = F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), F.col(text).alias("id_label"), F.col("own" if kind == "cell" else "formula").alias("label"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("ref"))
        return row if when is None else F.when(when, row)

    unread = (F.size("refs") == 0) & F.col("formula").rlike(r"\p{L}")
    targets = F.transform(
        "refs",
        lambda r, i: F.struct(
            (i + 3).alias("step"), F.when(r["ref"].contains(":"), "range").otherwise("cell").alias("kind"), label(r["sheet"], r["ref"]).alias("id_label"),
            label(r["sheet"], r["ref"]).alias("label"), r["sheet"].alias("sheet"), r["ref"].alias("ref"),
        ),
    )
    first = F.array_compact(F.array(emitted(0, "cell", "own"), emitted(1, "external", "formula", is_external(F.col("formula"))), emitted(2, "unsupported", "own", unread)))
    rows = formulas.select("*", F.explode(F.concat(first, targets)).alias("e"))
    found = location(path=F.col("cell_loc.workbook_path"), object_type=F.col("e.kind"), sheet=F.col("e.sheet"), address=F.col("e.ref"), object_id=F.col("e.label"))
    return rows.select(
        "sha256", F.array(F.col("sheet_index"), F.col("row"), F.col("column"), F.col("e.step").cast("long")).alias("seq"), F.concat(F.lit("cell:"), F.col("own")).alias("source"),
        F.concat_ws(":", "e.kind", "e.id_label").alias("id"), F.col("e.kind").alias("kind"), F.col("e.label").alias("label"), F.col("e.step").alias("step"), "formula", "cell_loc",
        F.when(F.col("e.step") >= 3, found).otherwise(F.col("cell_loc")).alias("target_loc"),
    )


def edges_of(emitted: DataFrame) -> DataFrame:
    """One row per reference; equal rows stay."""
    return emitted.where("step > 0").select("sha256", "seq", "source", F.col("id").alias("target"), F.lit("references").alias("relationship"), "formula", F.col("cell_loc").alias("loc"))


def nodes_of(emitted: DataFrame) -> DataFrame:
    """Each id once, as first emitted. A column an aggregate, so that what a query doesn't ask for is neither sorted nor
    shuffled; the kind is what the id begins with."""
    first = lambda c: F.min_by(c, "seq").alias(c)
    nodes = emitted.groupBy("sha256", "id").agg(first("label"), F.min("seq").alias("first_seq"), first("target_loc"))
    return nodes.select("sha256", "id", F.substring_index("id", ":", 1).alias("kind"), "label", "first_seq", F.col("target_loc").alias("loc"))


def unread_of(emitted: DataFrame) -> DataFrame:
    """A diagnostic for every formula with letters but no reference."""
    return emitted.where("kind = 'unsupported'").select(
        "sha256", F.lit("graph").alias("origin"), "seq", F.lit("formula_reference_parse").alias("feature_type"),
        F.concat(F.lit("No references parsed from formula "), python_repr(F.col("formula"))).alias("description"), F.lit("warning").alias("severity"),
        F.lit(False).alias("opaque"), F.create_map().cast("map<string,string>").alias("metadata"), F.col("cell_loc").alias("loc"),
    )


def formula_graph(cells: DataFrame) -> FormulaGraph:
    rows = emissions(cells)
    return FormulaGraph(nodes_of(rows), edges_of(rows), unread_of(rows))

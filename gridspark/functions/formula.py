"""Formula text as Spark columns: references are read, nothing is evaluated."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# An A1 reference or range, with or without a sheet before it, and a bracketed name of another workbook.
REFERENCE = r"((?:'[^']+'|[A-Za-z_][\p{L}\p{N}_ .]*)!)?(\$?[A-Z]{1,3}\$?\p{Nd}+(?::\$?[A-Z]{1,3}\$?\p{Nd}+)?)"
EXTERNAL = r"\[[^\]]+\]"
LOOKUPS = ("VLOOKUP", "XLOOKUP", "HLOOKUP", "INDEX", "MATCH")


def is_formula(value: Column) -> Column:
    return F.coalesce(value.startswith("="), F.lit(False))


def is_external(formula: Column) -> Column:
    return formula.rlike(EXTERNAL)


def uses_lookup(formula: Column) -> Column:
    return reduce(or_, map(F.upper(formula).contains, LOOKUPS))


def clean_sheet(prefix: Column, default: Column) -> Column:
    """The sheet that a prefix like `'My Sheet'!` names; the default without a prefix."""
    name = F.btrim(F.substring(prefix, F.lit(1), F.length(prefix) - 1), F.lit("'"))
    return F.when((prefix == "") | prefix.isNull(), default).otherwise(name)


def references(formula: Column, sheet: Column) -> Column:
    """array<struct<sheet, ref>> of all references, left to right, without dollar signs."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(formula, F.lit(REFERENCE), F.lit(1)).alias("prefix"), F.regexp_extract_all(formula, F.lit(REFERENCE), F.lit(2)).alias("ref")
    )
    return F.transform(pairs, lambda m: F.struct(clean_sheet(m["prefix"], sheet).alias("sheet"), F.replace(m["ref"], F.lit("$"), F.lit("")).alias("ref")))


def label(sheet: Column, ref: Column) -> Column:
    """Sheet!A1; without a sheet the reference alone."""
    return F.when(F.coalesce(sheet, F.lit("")) == "", ref).otherwise(F.concat(sheet, F.lit("!"), ref))

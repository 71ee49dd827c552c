"""Text functions as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each hint is triggered by, in the order in which hints are listed.
HINT_TOKENS = (
    ("assumption", ("assumption", "mortality", "lapse", "expense")),
    ("rate_table", ("rate", "table")),
    ("cashflow", ("cashflow", "cash flow", "premium", "claim")),
    ("projection", ("projection", "duration")),
    ("output", ("output", "result")),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often and wherever body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hints(text: Column) -> Column:
    """array<string> of the domain hints whose tokens the text holds, whatever their case."""

    def found(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(reduce(or_, map(low.contains, tokens)), hint) for hint, tokens in HINT_TOKENS]))

    return let(F.lower(F.coalesce(text, F.lit(""))), found)


def column_letters(number: Column) -> Column:
    """1 to A, 27 to AA, up to three letters."""

    def letter(n: Column) -> Column:
        return F.char(F.lit(65) + n % 26)

    n = number.cast("long")
    first = F.when(n > 702, letter(F.floor((n - 703) / 676))).otherwise("")
    second = F.when(n > 26, letter(F.floor((n - 27) / 26))).otherwise("")
    return F.concat(first, second, letter(n - 1))


def sql_text(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def letters_sql(n: str) -> str:
    """column_letters as SQL text, which is planned faster where it is part of something larger."""
    letter = lambda k: f"char(cast(65 + ({k}) % 26 as int))"
    return f"concat(case when {n} > 702 then {letter(f'({n} - 703) div 676')} else '' end, case when {n} > 26 then {letter(f'({n} - 27) div 26')} else '' end, {letter(f'{n} - 1')})"


def location_sql(object_type: str, path: str = "path", sheet: str = "null", index: str = "null", address: str = "null", object_id: str = "null", part: str = "null") -> str:
    """The provenance struct of `location` as SQL text."""
    text = lambda c: f"cast({c} as string)"
    return (
        f"named_struct('workbook_path', {text(path)}, 'sheet_name', {text(sheet)}, 'sheet_index', cast({index} as bigint), 'address', {text(address)}, "
        f"'object_type', {text(object_type)}, 'object_id', {text(object_id)}, 'ooxml_part', {text(part)})"
    )


def python_repr(text: Column) -> Column:
    """A string literal as Python prints it: double quotes only where the text holds a single quote and no double one."""
    plain = text
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(shown))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def location(
    path: Column | None = None, object_type: Column | str = "", sheet: Column | None = None, index: Column | None = None,
    address: Column | None = None, object_id: Column | None = None, part: Column | None = None,
) -> Column:
    """The provenance struct."""
    kind = F.lit(object_type) if isinstance(object_type, str) else object_type

    def text(c: Column | None) -> Column:
        return (F.lit(None) if c is None else c).cast("string")

    return F.struct(
        text(path).alias("workbook_path"), text(sheet).alias("sheet_name"), (F.lit(None) if index is None else index).cast("long").alias("sheet_index"),
        text(address).alias("address"), kind.alias("object_type"), text(object_id).alias("object_id"), text(part).alias("ooxml_part"),
    )

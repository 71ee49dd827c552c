"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gridspark.functions.text import let
from gridspark.sources.tables import delete, temporary_tables, written
from gridspark.sources.tables import shared_folder as checkpoint_dir

__all__ = ["add_columns", "checkpoint_dir", "delete", "hot_slots", "let", "lower_ascii", "prefix_sums", "table", "temporary_tables", "written"]

#: The white space that separates words in every contract here: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a Java / RE2 class body.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Equal parts of the hash values whose rows are counted; a part is hot with HOT_TIMES the mean and over HOT_LEAST rows.
SLOTS, HOT_TIMES, HOT_LEAST = 65_536, 4, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else (lower() would also fold other letters)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hot_slots(rows: DataFrame, key: str, least: int = HOT_LEAST) -> Column | None:
    """Whether a row's hash `key` lies in a hot slot; None if no slot is hot. Rows are counted by slot before the exchange,
    and at most SLOTS counts come to the driver. A value outside hot slots holds HOT_TIMES / SLOTS of all rows at most (or
    `least` rows), so it can be grouped in one task; a value that holds more is always in a hot slot."""
    slot = f"cast(pmod({key}, {SLOTS}) as int)"
    counts = rows.groupBy(F.expr(slot).alias("slot")).count().collect()
    limit = max(least, HOT_TIMES * sum(r["count"] for r in counts) / SLOTS)
    hot = sorted(r["slot"] for r in counts if r["count"] > limit)
    return F.expr(f"{slot} in ({', '.join(map(str, hot))})") if hot else None


def add_columns(
    df: DataFrame, carry: Sequence[str], new: str, compute: Callable[[dict[str, list]], dict[str, list]], needs: Sequence[str]
) -> DataFrame:
    """df's `carry` columns and the columns of the DDL schema `new`, made from the `needs` columns one Arrow batch at a
    time. Names in `new` win over equal names in `carry`."""
    fields = T.StructType.fromDDL(new).fields
    made = {f.name for f in fields}
    carry = [c for c in carry if c not in made]
    inputs = list(dict.fromkeys([*carry, *needs]))
    df = df.select(*[F.col(f"`{c}`") for c in inputs])
    schema = T.StructType([*[df.schema[c] for c in carry], *fields])
    arrow = [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = compute({c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in needs})
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in carry], *[pa.array(columns[f.name], f.type) for f in arrow]],
                schema=pa.schema([*[batch.schema.field(c) for c in carry], *arrow]),
            )

    return df.mapInArrow(run, schema)


def prefix_sums(lengths: Column, block: int = 128) -> Column:
    """For an array of n numbers the n sums of what stands before each. Blocks keep long arrays from being copied for
    every element."""

    def sums(a: Column) -> Column:
        n = F.size(a)
        zero = F.lit(0).cast("long")
        add = lambda x, y: x + y
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(a, b * block + 1, F.lit(block)), zero, add))
        starts = F.aggregate(blocks, F.array(zero), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
        at = lambda s: F.transform(a, lambda x, i: F.element_at(s, F.floor(i / block).cast("int") + 1) + F.aggregate(F.slice(a, F.floor(i / block).cast("int") * block + 1, i % block), zero, add))
        return F.when(n > 0, let(starts, at)).otherwise(F.array().cast("array<bigint>"))

    return let(lengths, sums)

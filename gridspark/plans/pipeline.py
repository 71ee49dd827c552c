"""The whole decomposition: inventory, graph, classes, questions, coverage."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from gridspark.operators.classify import classify
from gridspark.operators.confirm import questions
from gridspark.operators.coverage import coverage, holds
from gridspark.operators.graph import FormulaGraph, formula_graph
from gridspark.operators.inventory import Inventory, inventory_of
from gridspark.plugins import BUILT_IN, registry
from gridspark.sources.ooxml import read_workbooks
from gridspark.sources.tables import written

for _stage, _function in (("read", read_workbooks), ("inventory", inventory_of), ("graph", formula_graph), ("classify", classify), ("questions", questions)):
    registry.implements(_stage, BUILT_IN, replace=True)(_function)


#: Rows of a file of a written frame: a million formulas, which one task would read for half a minute, take less than 1 MB.
FILE_ROWS = 50_000


@dataclass(frozen=True)
class Decomposition:
    inventory: Inventory
    graph: FormulaGraph
    items: DataFrame
    questions: DataFrame
    coverage: DataFrame


def decompose(spark: SparkSession, paths: str | list[str], use: dict[str, str] | None = None) -> Decomposition:
    """Frames of all workbooks under `paths`: files, folders or patterns of any store that Spark reads. Reading and
    parsing happen here, all else is lazy. use: names of registered implementations by stage, for those not built in."""
    stage = lambda name: registry.get(name, (use or {}).get(name, BUILT_IN))
    found = stage("inventory")(stage("read")(spark, paths))
    found = replace(found, **{f.name: written(getattr(found, f.name), file_rows=FILE_ROWS) for f in fields(found) if f.name != "counted"})  # later stages read them again and again
    graph = stage("graph")(found.cells)
    unsupported = found.unsupported.unionByName(graph.unsupported)
    items = stage("classify")(found.workbooks, found.cells, found.ranges, unsupported)
    covered = holds(coverage(found.workbooks, found.cells, found.ranges, unsupported, found.counted))
    return Decomposition(found, graph, items, stage("questions")(items), covered)

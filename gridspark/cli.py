"""Command line: `python -m gridspark.cli inspect BOOK... --out DIR`."""

from __future__ import annotations

import argparse
import importlib
from pathlib import Path

from pyspark.sql import SparkSession

from gridspark.plans.pipeline import decompose
from gridspark.plugins import BUILT_IN, SHAPES, registry
from gridspark.sinks import store  # noqa: F401  registers the built-in store
from gridspark.sources.tables import temporary_tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridspark", description="Decompose spreadsheet workbooks into reviewable artifacts.")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("inspect", help="inspect workbooks and write their artifacts", description="Inspect workbooks and write their artifacts.")
    one.add_argument("workbook", nargs="+")
    one.add_argument("--out", "-o", default="artifacts")
    one.add_argument("--load", action="append", default=[], metavar="MODULE", help="import a module that registers stages")
    one.add_argument("--use", action="append", default=[], metavar="STAGE=NAME", help=f"run a registered stage ({', '.join(SHAPES)})")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    books = [Path(w).expanduser().resolve() for w in args.workbook]
    for book in books:
        if not book.is_file():
            parser().error(f"no such file: {book}")
    for module in args.load:
        importlib.import_module(module)
    use = dict(x.split("=", 1) for x in args.use if "=" in x)
    for stage, name in use.items():
        if stage not in SHAPES or name not in registry.names(stage):
            parser().error(f"no such stage: {stage}={name}")
    spark = spark or SparkSession.builder.appName("gridspark").getOrCreate()
    with temporary_tables(spark):
        done = decompose(spark, [str(b) for b in books], use)
        records = registry.get("store", use.get("store", BUILT_IN))(done, args.out)
    for record in records:
        print(f"{record.run_id} {record.workbook_sha256}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

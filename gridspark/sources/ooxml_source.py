"""`spark.read.format("ooxml").load(folder)`: package parts as a data source, planned and pruned.

A file is opened where it lies and only its directory is read, and those entries that the query asks for: filters on the
names of parts are pushed into the reader, and nothing is unzipped at all unless the text or the root of a part is
selected (by the schema that the reader is given). Files are packed into partitions by their sizes. Worksheets and shared
strings come in pieces, as from `read_parts`; media and other parts that nothing reads never are unzipped.

    register(spark)
    spark.read.format("ooxml").load("hdfs:///books").where("name like 'xl/worksheets/%'").select("path", "name", "xml")
    spark.read.format("ooxml").schema(DIRECTORY).load("/books")        # names and sizes only
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridspark.contracts import WORKBOOK_TYPES
from gridspark.sinks.json_files import file_system
from gridspark.sources.ooxml import MAX_PART_BYTES, PIECE_BYTES, entries_of

DIRECTORY = "path string, part_seq long, name string, size long, error string"
PARTS = "path string, part_seq long, name string, size long, root string, piece int, rows_before long, xml binary, error string"
#: Bytes of files in a partition, and what opening a file counts as.
PARTITION_BYTES, OPEN_BYTES = 128 << 20, 4 << 20


@dataclass
class Packed(InputPartition):
    paths: tuple[str, ...]


class Ooxml(DataSource):
    """Options: path (a file or a folder, looked through to its leaves), pieceBytes, maxPartBytes."""

    @classmethod
    def name(cls) -> str:
        return "ooxml"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return OoxmlReader(schema, self.options)


class OoxmlReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.columns, self.arrow = schema.fieldNames(), to_arrow_schema(schema)
        self.path = options["path"]
        self.piece_bytes, self.max_part_bytes = int(options.get("pieceBytes", PIECE_BYTES)), int(options.get("maxPartBytes", MAX_PART_BYTES))
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  named by the API
        """Filters on names are taken; the others stay Spark's."""
        kinds = {EqualTo: "equal", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("name",):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f

    def wanted(self, name: str) -> bool:
        checks = {"equal": lambda v: name == v, "in": lambda v: name in v, "starts": name.startswith, "ends": name.endswith, "contains": lambda v: v in name}
        return all(checks[kind](value) for kind, value in self.tests)

    def partitions(self) -> list[Packed]:
        system, root = file_system(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
        books = sorted((f for f in files if f.extension.lower() in WORKBOOK_TYPES), key=lambda f: (-f.size, f.path))
        packed: list[list[str]] = []
        room = 0
        for f in books:
            if not packed or room < f.size + OPEN_BYTES:
                packed.append([])
                room = PARTITION_BYTES
            packed[-1].append(f.path)
            room -= f.size + OPEN_BYTES
        return [Packed(tuple(p)) for p in packed] or [Packed(())]

    def read(self, partition: Packed) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        unzip = bool({"xml", "root"} & set(self.columns))
        for path in partition.paths:
            ready, size = [], 0
            with system.open_input_file(path) as file:
                for part in entries_of(file, self.piece_bytes, self.max_part_bytes, self.wanted, unzip):
                    if part["name"] is None and self.tests:
                        continue  # no package: it has no part of any name
                    ready.append({"path": path, **part})
                    size += len(part["xml"] or b"")
                    if size >= self.piece_bytes:
                        yield self.batch(ready)
                        ready, size = [], 0
            if ready:
                yield self.batch(ready)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in self.arrow], schema=self.arrow)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Ooxml)

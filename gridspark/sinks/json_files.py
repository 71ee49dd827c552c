"""JSON artifacts written by tasks: every artifact is a stream of small rows, never one value.

`artifact_lines` gives one row for each object of an artifact (a cell, a node, a sheet's head) with its place; the JSON
text of each is made, indented, where the row is: by SQL, or by Python where values are typed as they come (metadata) or a
number may have to be written otherwise. One exchange brings the rows of a file together, Spark sorts them by
their places, with spill, and the data source `gridspark-json` streams them into the file, counting and hashing as it
goes: a file may be as large as its file system lets it be, whatever the memory of a task.

Files are staged first, each attempt of a task in a folder of its own, through pyarrow's file systems (local, HDFS, S3,
GCS); with the option `compression` set to gzip as `.json.gz`, which Spark's readers unzip, since indented JSON is over
twenty times as large. Digest and bytes are always those of the JSON text. When all tasks are done, `commit` leaves a list of the files that count; a task that fails removes its own, `abort`
all of them. Publishing is renaming, by the store.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from gridspark.contracts import SCHEMA_VERSION
from gridspark.functions.text import sql_text
from gridspark.plans.pipeline import Decomposition
from gridspark.sources.tables import written

#: By file the artifact's type and its arrays in order; sheets have arrays of their own.
LAYOUTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "workbook_manifest.json": ("workbook_manifest", ("sheets", "package_parts", "unsupported_features")),
    "inventory.json": ("workbook_inventory", ("full_sheets", "workbook_ranges", "unsupported_features")),
    "dependency_graph.json": ("formula_graph", ("nodes", "edges", "unsupported_features")),
    "module_classification.json": ("module_classification", ("items", "unsupported_features")),
    "confirmation_template.json": ("confirmation_template", ("questions",)),
}
NESTED = {"full_sheets": ("sheets", ("cells", "ranges", "layout_objects"))}
#: Metadata entries that are no text.
TYPED = {"hidden": lambda v: v == "true", "height": float, "width": float, "bytes": int}
LINES = "sha256 string, artifact string, place array<bigint>, text string"
#: Rows that a Python worker holds as objects at a time: Arrow brings 10,000, whatever their length.
HELD_ROWS = 500
STAGED = "staged.json"
#: Suffixes by the option `compression`. Level 1: indented JSON shrinks to less than a twentieth at 400 MB a second.
SUFFIXES = {"none": "", "gzip": ".gz"}
GZIP_LEVEL = 1


# ------------------------------------------------------------------------------------------------ lines

#: What a JSON text escapes, and what such a text is cut into.
_ESCAPED, _PIECES = sql_text(r'["\\\x00-\x1f]'), sql_text(r'["\\\x00-\x1f]|[^"\\\x00-\x1f]+')
_SHORT = {'"': '"', "\\": "\\", "\b": "b", "\t": "t", "\n": "n", "\f": "f", "\r": "r"}
_ESCAPE = f"case {' '.join(f'when p = char({ord(c)}) then {sql_text(chr(92) + e)}' for c, e in _SHORT.items())} when p < ' ' then concat({sql_text(chr(92) + 'u00')}, lower(lpad(hex(ascii(p)), 2, '0'))) else p end"
#: Numbers that every writer writes alike: 15 digits at most, the last no zero, from 0.0001 on without an exponent.
_ALIKE = sql_text(r"^-?(0\.(0|0{0,3}[1-9]|0{0,3}[1-9][0-9]*[1-9])|[1-9][0-9]*\.(0|[0-9]*[1-9]))\z")


def quoted_sql(text: str) -> str:
    """A string as JSON, as SQL text."""
    escaped = f"array_join(transform(regexp_extract_all({text}, {_PIECES}, 0), p -> {_ESCAPE}), '')"
    return f"coalesce(concat('\"', case when {text} rlike {_ESCAPED} then {escaped} else {text} end, '\"'), 'null')"


def alike_sql(number: str) -> str:
    """Whether a number, given as text, is JSON as it stands, the very text that json.dumps writes."""
    return f"coalesce(length({number}) <= 16 and {number} rlike {_ALIKE}, true)"


def json_sql(value: str, kind: T.DataType, level: int, at: str = "v") -> str:
    """A value as SQL text that gives what json.dumps(indent=2, ensure_ascii=False) writes `level` steps in. Fractions are
    those of alike_sql."""
    pad, end = "\n" + "  " * (level + 1), "\n" + "  " * level
    if isinstance(kind, T.StructType):
        texts = ", ".join(f"{sql_text((',' if i else '{') + pad + json.dumps(f.name, ensure_ascii=False) + ': ')}, {json_sql(f'{value}.`{f.name}`', f.dataType, level + 1, at)}" for i, f in enumerate(kind.fields))
        return f"if({value} is null, 'null', concat({texts}, {sql_text(end + '}')}))"
    if isinstance(kind, T.ArrayType):
        opened, between, closed = "[" + pad, "," + pad, end + "]"
        each = f"array_join(transform({value}, {at} -> {json_sql(at, kind.elementType, level + 1, at + 'v')}), {sql_text(between)})"
        text = f"concat({sql_text(opened)}, {each}, {sql_text(closed)})"
        if isinstance(kind.elementType, T.StringType):  # mostly nothing is to be escaped; a null counts as what is
            plain = f"concat({sql_text(opened + chr(34))}, array_join({value}, {sql_text(chr(34) + between + chr(34))}), {sql_text(chr(34) + closed)})"
            text = f"case when array_join({value}, '', '\"') rlike {_ESCAPED} then {text} else {plain} end"
        return f"case when {value} is null then 'null' when size({value}) = 0 then '[]' else {text} end"
    if isinstance(kind, T.StringType):
        return quoted_sql(value)
    if isinstance(kind, (T.IntegralType, T.BooleanType, T.DoubleType)):
        return f"coalesce(cast({value} as string), 'null')"
    raise TypeError(f"{value} is {kind.simpleString()}")


#: Fields named json:x are JSON already where SQL makes the text, and of another type where Python does.
_VALUE = (
    "case value_type when 'long' then cast(try_cast(value as bigint) as variant) when 'double' then cast(try_cast(value as double) as variant) "
    "when 'boolean' then cast(value = 'true' as variant) else cast(value as variant) end"
)
_VALUE_JSON = (
    f"case value_type when 'long' then coalesce(cast(try_cast(value as bigint) as string), 'null') when 'double' then coalesce(value, 'null') "
    f"when 'boolean' then coalesce(cast(value = 'true' as string), 'null') else {quoted_sql('value')} end"
)
_CELL = ("loc as source_location", "address", "row", "column", "kind", f"{_VALUE} as value", "data_type", "number_format", "formula", "style_id")
_CELL_JSON = tuple(f"{_VALUE_JSON} as json:value" if f.endswith(" as value") else f for f in _CELL)
_RANGE = ("loc as source_location", "name", "address", "kind", "metadata")
_PROBLEM = ("feature_type", "description", "loc as source_location", "severity", "opaque", "metadata")
_SHEET_LOC = "named_struct('workbook_path', path, 'sheet_name', sheet_name, 'sheet_index', sheet_index, 'address', cast(null as string), 'object_type', 'sheet', 'object_id', cast(null as string), 'ooxml_part', cast(null as string))"


def artifact_lines(done: Decomposition) -> DataFrame:
    """LINES of all artifacts of all workbooks: [0] is the head of a file, [k, ...] what its k-th array holds, in order."""
    inv, graph = done.inventory, done.graph

    def named(fields: tuple[str, ...]) -> list[tuple[str, str]]:
        return [tuple(reversed(f.rsplit(" as ", 1))) if " as " in f else (f, f) for f in fields]

    def rows(df: DataFrame, artifact: str, place: str, fields: tuple[str, ...], depth: int = 2, head: bool = False) -> None:
        """Text by SQL. The rows of `df` have numbers that are written alike only."""
        names = [name for name, _ in named(fields)]
        picked = df.selectExpr("sha256", f"{place} as place", *[f"{value} as f{i}" for i, (_, value) in enumerate(named(fields))])
        texts = []
        for name, field in zip(names, picked.schema.fields[2:], strict=True):
            key = json.dumps(name.removeprefix("json:"), ensure_ascii=False)
            before = (",\n" if texts else "  " * depth + "{\n") + "  " * (depth + 1) + key + ": "
            texts += [sql_text(before), field.name if name.startswith("json:") else json_sql(field.name, field.dataType, depth + 1)]
        end = [] if head else [sql_text("\n" + "  " * depth + "}")]  # a head goes on with arrays
        ready.append(picked.selectExpr("sha256", f"'{artifact}' as artifact", "place", f"concat({', '.join(texts + end)}) as text"))

    def typed_rows(df: DataFrame, artifact: str, place: str, fields: tuple[str, ...], depth: int = 2) -> None:
        """Text by Python."""
        pairs = ", ".join(f"'{name}', {value}" for name, value in named(fields))
        to_type.append(df.selectExpr("sha256", f"'{artifact}' as artifact", f"{place} as place", f"to_json(named_struct({pairs}), map('ignoreNullFields', 'false')) as text", f"{depth} as depth", "false as head"))

    def head(df: DataFrame, artifact: str, *fields: str) -> None:
        rows(df, artifact, "array(0L)", (f"'{SCHEMA_VERSION}' as schema_version", f"'{LAYOUTS[artifact][0]}' as artifact_type", *fields), 0, True)

    ready: list[DataFrame] = []
    to_type: list[DataFrame] = []
    manifest, inventory, dependencies, classes, template = LAYOUTS
    unread = written(graph.unsupported)  # few rows, for which each use would read all formulas
    covered = done.coverage.selectExpr("sha256", "named_struct('recognized_inventory_objects', recognized, 'unsupported_or_opaque_objects', opaque, 'discovered_workbook_objects', discovered) as coverage")
    books = inv.manifest
    known = lambda k: f"concat(array({k}L), seq)"
    cell_place, cell_alike = "array(1L, sheet_index, 1L, row, column)", f"(value_type is null or value_type <> 'double' or {alike_sql('value')})"
    item, item_alike = ("id", "category", "confidence", "reasons", "loc as source_location", "source_artifact_refs", "hints as actuarial_hints"), alike_sql("cast(confidence as string)")
    head(books, manifest, "workbook_path", "file_name", "file_size", "sha256", "is_macro_enabled", "named_ranges_count", "calc_mode")
    rows(inv.sheets, manifest, "array(1L, sheet_index)", ("sheet_name as name", "sheet_index as index", "state", "max_row", "max_column"))
    rows(inv.parts, manifest, "array(2L, part_seq)", ("name", "content_type", "relationship_type", "size", "opaque", "loc as source_location"))
    typed_rows(inv.unsupported, manifest, known(3), _PROBLEM)
    head(covered, inventory, "sha256 as workbook_sha256", "coverage")
    rows(inv.sheets, inventory, "array(1L, sheet_index, 0L)", (f"{_SHEET_LOC} as source_location", "sheet_name as name", "sheet_index as index", "max_row", "max_column", "state"), 2, True)
    rows(inv.cells.where(cell_alike), inventory, cell_place, _CELL_JSON, 4)
    typed_rows(inv.cells.where(f"not {cell_alike}"), inventory, cell_place, _CELL, 4)
    typed_rows(inv.ranges.where("scope = 'sheet_range'"), inventory, "array(1L, sheet_index, 2L, seq)", _RANGE, 4)
    typed_rows(inv.ranges.where("scope = 'layout'"), inventory, "array(1L, sheet_index, 3L, seq)", _RANGE, 4)
    typed_rows(inv.ranges.where("scope = 'workbook'"), inventory, "array(2L, seq)", _RANGE)
    typed_rows(inv.unsupported, inventory, known(3), _PROBLEM)
    head(books, dependencies)
    rows(graph.nodes, dependencies, "concat(array(1L), first_seq)", ("id", "kind", "label", "loc as source_location", "'{}' as json:metadata"))
    rows(graph.edges, dependencies, known(2), ("source", "target", "relationship", "formula", "loc as source_location"))
    typed_rows(unread, dependencies, known(3), _PROBLEM)
    head(books, classes)
    rows(done.items.where(item_alike), classes, known(1), item)
    typed_rows(done.items.where(f"not {item_alike}"), classes, known(1), item)
    typed_rows(inv.unsupported.unionByName(unread), classes, "concat(array(2L, if(origin = 'graph', 1L, 0L)), seq)", _PROBLEM)
    head(books, template, "cast(array() as array<string>) as decisions")
    rows(done.questions, template, known(1), ("id", "prompt", "question_type", "loc as source_location", "options", "default", "rationale"))
    return reduce(DataFrame.unionByName, [*ready, indented(reduce(DataFrame.unionByName, to_type))])


def indented(lines: DataFrame) -> DataFrame:
    """LINES with the text as it stands in the file: two spaces a level, metadata typed, heads without their braces' end."""

    return lines.mapInArrow(indent_batches, LINES)


def indent_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def typed(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if isinstance(out.get("metadata"), dict):
            out["metadata"] = {k: TYPED[k](v) if k in TYPED and v is not None else v for k, v in out["metadata"].items()}
        return out

    def shown(text: str, depth: int, head: bool) -> str:
        found = json.dumps(json.loads(text, object_pairs_hook=typed), indent=2, ensure_ascii=False)
        found = found[:-2] if head else found  # a head goes on with arrays
        return found if not depth else "\n".join("  " * depth + line for line in found.split("\n"))

    for batch in held(batches):
        texts, depths, heads = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "depth", "head"))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(map(shown, texts, depths, heads), pa.string())], names=["sha256", "artifact", "place", "text"])


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of batches, in their order, in slices of HELD_ROWS at most; nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, HELD_ROWS):
            yield batch.slice(at, HELD_ROWS)


class Document:
    """An artifact as its rows come in: opens and closes its arrays, and counts and hashes what is written."""

    def __init__(self, write, artifact: str):
        self.write_out, self.digest, self.size = write, hashlib.sha256(), 0
        self.arrays = LAYOUTS[artifact][1]
        self.section, self.items, self.sheet, self.part, self.part_items = 0, 0, None, 0, 0

    def write(self, text: str | bytes) -> None:
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
        self.digest.update(data)
        self.size += len(data)
        self.write_out(data)

    def nested(self, section: int) -> tuple[str, tuple[str, ...]] | None:
        return NESTED.get(self.arrays[section - 1]) if section else None

    def put(self, place: list[int], text: str) -> None:
        self.put_all(place[0], place[2] if self.nested(place[0]) else 0, text, 1)

    def put_all(self, section: int, part: int, texts: str | bytes, n: int) -> None:
        """n rows, with commas between, that follow each other in one array: a section's own, or with part (from 1) that
        of the sheet that came last. Heads, of files and of sheets, come one by one."""
        if section == 0:
            self.write(texts)
            return
        self.reach(section)
        nested = self.nested(section)
        if part:
            self.reach_part(nested[1], part)
            self.write(",\n" if self.part_items else "\n")
            self.part_items += n
        else:
            self.close_sheet()
            self.write(",\n" if self.items else "\n")
            self.items += n
            self.sheet = nested
        self.write(texts)

    def reach(self, section: int) -> None:
        while self.section < section:
            self.close()
            name = self.arrays[self.section]
            self.section, self.items = self.section + 1, 0
            self.write(f',\n  "{NESTED[name][0] if name in NESTED else name}": [')

    def close(self) -> None:
        self.close_sheet()
        if self.section:
            self.write("\n  ]" if self.items else "]")

    def reach_part(self, names: tuple[str, ...], part: int) -> None:
        while self.part < part:
            if self.part:
                self.write("\n      ]" if self.part_items else "]")
            self.write(f',\n      "{names[self.part]}": [')
            self.part, self.part_items = self.part + 1, 0

    def close_sheet(self) -> None:
        if self.sheet:
            self.reach_part(self.sheet[1], len(self.sheet[1]))
            self.write(("\n      ]" if self.part_items else "]") + "\n    }")
            self.sheet, self.part, self.part_items = None, 0, 0

    def end(self) -> None:
        self.reach(len(self.arrays))
        self.close()
        self.write("\n}\n")


# ------------------------------------------------------------------------------------------------ the sink


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or a local path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"[a-z][a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


@dataclass
class Files(WriterCommitMessage):
    files: list[dict]


class JsonFiles(DataSource):
    """`df.write.format("gridspark-json").option("path", staging)`: LINES, all of a file in one partition and in order."""

    @classmethod
    def name(cls) -> str:
        return "gridspark-json"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return JsonWriter(self.options["path"], self.options.get("compression", "none"))


def at_depth(places: pa.Array, k: int) -> pa.Array:
    """The k-th number of each place; 0 where a place ends before."""
    starts, ends = places.offsets[:-1].to_numpy(), places.offsets[1:].to_numpy()
    there = starts + k < ends
    return pc.if_else(pa.array(there), places.values.take(pa.array(np.where(there, starts + k, 0))), 0) if len(places.values) else pa.array(np.zeros(len(places), np.int64))


def runs(*keys: pa.Array) -> Iterator[tuple[int, int]]:
    """(begin, end) of rows in a row that have equal keys."""
    n = len(keys[0])
    changes = np.zeros(max(n - 1, 0), bool)
    for key in keys:
        changes |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    borders = [0, *(np.flatnonzero(changes) + 1).tolist(), n]
    return zip(borders[:-1], borders[1:]) if n else iter(())


def joined(texts: pa.Array) -> pa.Buffer:
    """The texts with commas and line ends between, as UTF-8."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), ",\n")[0].as_buffer()


class JsonWriter(DataSourceArrowWriter):
    def __init__(self, staging: str, compression: str = "none"):
        self.staging, self.compression = staging, compression
        self.suffix = SUFFIXES[compression]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        system, root = file_system(self.staging)
        own = f"{root}/{uuid.uuid4().hex}"  # another attempt has another folder
        done: list[dict] = []
        streams, document, current = [], None, None  # streams: as they are to be closed

        def begin() -> Document:
            system.create_dir(f"{own}/{current[0]}", recursive=True)
            streams[:] = [system.open_output_stream(f"{own}/{current[0]}/{current[1]}{self.suffix}", compression=None, buffer_size=1 << 20)]
            if self.suffix:
                streams.insert(0, gzip.GzipFile(filename="", mode="wb", compresslevel=GZIP_LEVEL, fileobj=streams[0], mtime=0))
            return Document(streams[0].write, current[1])

        def finish() -> None:
            document.end()
            for stream in streams:
                stream.close()
            done.append({"sha256": current[0], "name": current[1], "staged": f"{own}/{current[0]}/{current[1]}{self.suffix}", "digest": document.digest.hexdigest(), "bytes": document.size})

        try:
            for batch in held(iterator):
                sha256, artifact, places, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("sha256", "artifact", "place", "text"))
                section, part = at_depth(places, 0), at_depth(places, 2)
                for a, b in runs(sha256, artifact):
                    if (found := (sha256[a].as_py(), artifact[a].as_py())) != current:
                        if document:
                            finish()
                        current = found
                        document = begin()
                    for c, d in runs(section[a:b]):
                        at = section[a + c].as_py()
                        own_parts = part[a + c : a + d] if document.nested(at) else None
                        for e, f in [(0, d - c)] if own_parts is None else runs(own_parts):
                            k = 0 if own_parts is None else own_parts[e].as_py()
                            step = f - e if at and (own_parts is None or k) else 1  # heads come one by one
                            for g in range(a + c + e, a + c + f, step):
                                document.put_all(at, k, joined(texts[g : g + step]), step)
            if document:
                finish()
        except BaseException:
            for stream in streams:
                if not stream.closed:
                    stream.close()
            if system.get_file_info(own).type != fs.FileType.NotFound:
                system.delete_dir(own)
            raise
        return Files(done)

    def commit(self, messages: list[Files | None]) -> None:
        system, root = file_system(self.staging)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{STAGED}") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Files | None]) -> None:
        system, root = file_system(self.staging)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)


def stage(lines: DataFrame, staging: str, compression: str = "none") -> list[dict]:
    """The files of LINES, written under `staging`: (sha256, name, staged, digest, bytes) of each; digest and bytes before
    they are compressed."""
    spark: SparkSession = lines.sparkSession
    spark.dataSource.register(JsonFiles)
    keys = ["sha256", "artifact"]
    lines.repartition(*keys).sortWithinPartitions(*keys, "place").write.format("gridspark-json").mode("append").options(path=staging, compression=compression).save()
    system, root = file_system(staging)
    with system.open_input_stream(f"{root}/{STAGED}") as found:
        return json.loads(found.read())

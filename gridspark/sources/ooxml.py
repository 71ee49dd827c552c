"""Workbooks as rows: any file system that Spark reads, unzipped and parsed inside tasks.

`read_workbooks` loads whole files. `read_parts` explodes a workbook into its package parts; of XML parts that hold
something to be read it gives the text, and cuts worksheets and shared strings, as they are unzipped, at the borders of
rows and strings into pieces of a few megabytes, each a document of its own. `read_elements` parses the pieces, so a
single large sheet is parsed by as many tasks as there are pieces, and none is ever whole in memory. What relates parts
and pieces to each other (sheets to their files, cells to shared strings, styles and shared formulas, links to targets)
is left to joins, in operators/inventory.py.

An element is known by its place, not its name alone: a number format counts below numFmts and not below a table's dxf, a
pane below a sheet's own view and not below a custom view, a name in the workbook and not in an external link.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.package import is_workbook

#: A piece's parts row carries the part's entry; pieces after the first have only what was cut, and the last row before it.
PARTS = "sha256 string, path string, part_seq long, name string, size long, root string, piece int, rows_before long, xml binary, error string"
ELEMENTS = (
    "sha256 string, path string, part string, piece int, seq long, tag string, nth long, attrs map<string,string>, text string, "
    "row_no long, col_no long, t string, style_id long, v string, f string, si string, inline string"
)
#: Bytes of XML after which a part is cut, and beyond which a part is not read.
PIECE_BYTES = 4 << 20
MAX_PART_BYTES = 4 << 30
#: Pieces are numbered within a part, elements within a piece: seq = piece * 2^24 + number.
SEQ_BITS = 24
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
STRICT_RELATION = "{http://purl.oclc.org/ooxml/officeDocument/relationships}"
#: By the root of a part the places of what is read there.
PLACES = {
    "Types": ("Default", "Override"),
    "Relationships": ("Relationship",),
    "workbook": ("sheets/sheet", "definedNames/definedName", "calcPr", "workbookPr"),
    "styleSheet": ("numFmts/numFmt", "cellXfs/xf"),
    "worksheet": (
        "sheetViews/sheetView/pane", "cols/col", "sheetData/row", "mergeCells/mergeCell", "dataValidations/dataValidation", "conditionalFormatting", "hyperlinks/hyperlink",
        "sheetProtection", "tableParts/tablePart",
    ),
    "sst": ("si",),
    "table": (".",),
    "comments": ("authors/author", "commentList/comment"),
}
#: What holds the units that a part can be cut between.
CUT = {b"worksheet": (b"sheetData", b"row"), b"sst": (b"sst", b"si")}
BULK = ("worksheet", "sst")
ROOT = re.compile(rb"<((?:[A-Za-z_][\w.-]*:)?)([A-Za-z_][\w.-]*)(?=[\s>/])[^>]*>")
DECLARATION = re.compile(rb"^\s*<\?xml[^>]*\?>")
ROW_NUMBER = re.compile(rb"""\sr\s*=\s*["'](\d+)["']""")
SIZE = re.compile(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*")
CELL_ADDRESS = re.compile(r"\$?([A-Za-z]{1,3})\$?([0-9]{1,7})$")


def read_workbooks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(sha256, path, file_name, file_size, content) of each file."""
    return as_workbooks(spark.read.format("binaryFile").load(paths))


def as_workbooks(files: DataFrame) -> DataFrame:
    """Files by their path and content, as read_workbooks gives them."""
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(F.sha2("content", 256).alias("sha256"), path.alias("path"), F.substring_index(path, "/", -1).alias("file_name"), F.length("content").cast("long").alias("file_size"), "content")


def distinct_workbooks(files: DataFrame) -> DataFrame:
    """(sha256, path, file_name, file_size, other_paths): one row for each content. Files of the same bytes are one
    workbook, under its smallest path that has a workbook's suffix, or else its smallest; the others are listed."""
    rank = F.struct((~is_workbook(F.col("path"))).alias("no_workbook"), F.col("path"), F.col("file_name"), F.col("file_size"))
    books = files.groupBy("sha256").agg(F.min(rank).alias("first"), F.sort_array(F.collect_set("path")).alias("paths"))
    return books.select("sha256", "first.path", "first.file_name", "first.file_size", F.array_remove("paths", F.col("first.path")).alias("other_paths"))


# ------------------------------------------------------------------------------------------------ unzipping and cutting


def read_parts(workbooks: DataFrame, piece_bytes: int = PIECE_BYTES, max_part_bytes: int = MAX_PART_BYTES) -> DataFrame:
    """PARTS: a row for each zip entry in archive order, with the XML of those parts that are read, and further rows for
    the further pieces of large ones. A file that is no zip gives one row (part_seq -1) with an error; so does, besides its
    entry, a part that is larger than max_part_bytes or can't be unzipped."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in PARTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sha256, path, content = (batch.column(k)[i].as_py() for k in range(3))
                ready, size = [], 0
                for part in entries(content, piece_bytes, max_part_bytes):
                    ready.append({"sha256": sha256, "path": path, **part})
                    size += len(part["xml"] or b"")
                    if size >= piece_bytes or len(ready) == 1000:
                        yield pa.RecordBatch.from_pylist(ready, schema=schema)
                        ready, size = [], 0
                yield pa.RecordBatch.from_pylist(ready, schema=schema)

    return workbooks.where(is_workbook(F.col("path"))).select("sha256", "path", "content").mapInArrow(run, PARTS)


def entries(content: bytes, piece_bytes: int = PIECE_BYTES, max_part_bytes: int = MAX_PART_BYTES) -> Iterator[dict]:
    return entries_of(io.BytesIO(content), piece_bytes, max_part_bytes)


def entries_of(file, piece_bytes: int, max_part_bytes: int, wanted: Callable[[str], bool] = lambda name: True, unzip: bool = True) -> Iterator[dict]:
    """The parts of a package in a seekable file, those whose names are wanted; without `unzip` what the directory says."""
    broken = (zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, RuntimeError, OSError, EOFError, ValueError, zlib.error)
    try:
        package = zipfile.ZipFile(file)
    except broken as e:
        yield {"part_seq": -1, "name": None, "size": None, "root": None, "piece": 0, "rows_before": 0, "xml": None, "error": f"{type(e).__name__}: {e}"}
        return
    for i, info in enumerate(package.infolist()):
        if not wanted(info.filename):
            continue
        entry = {"part_seq": i, "name": info.filename, "size": info.file_size, "root": None, "piece": 0, "rows_before": 0, "xml": None, "error": None}
        found = False
        is_xml = unzip and info.filename.endswith((".xml", ".rels"))
        if is_xml and info.file_size <= max_part_bytes:  # no more than that is ever unzipped
            try:
                with package.open(info) as stream:
                    for piece, (root, rows_before, xml) in enumerate(pieces(stream, piece_bytes)):
                        found = True
                        yield entry | {"root": root, "piece": piece, "rows_before": rows_before, "xml": xml}
            except broken as e:
                yield entry | {"piece": -1, "error": f"{type(e).__name__}: {e}"}
        elif is_xml:
            yield entry | {"piece": -1, "error": f"larger than {max_part_bytes} bytes"}
        if not found:
            yield entry


def pieces(stream, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[str | None, int, bytes | None]]:
    """(root, number of the last row before, XML) of a part's pieces. A part with nothing to read gives one without XML."""
    head = stream.read(1 << 16)
    if head[:2] in (b"\xff\xfe", b"\xfe\xff") or not (root := root_of(head)):
        yield None, 0, head + stream.read()  # in another encoding, or no XML: for the parser to say
        return
    prefix, name = root[1], root[2]
    if name.decode() not in PLACES:
        yield name.decode(), 0, None
        return
    if name not in CUT:
        yield name.decode(), 0, head + stream.read()
        return
    yield from cut(stream, head, prefix, name, root, piece_bytes)


def root_of(head: bytes) -> re.Match | None:
    """The first tag that isn't in a comment."""
    return ROOT.search(re.sub(rb"<!--.*?-->", lambda m: b" " * len(m[0]), head, flags=re.S))


QUOTE = re.compile(rb"<!--|<!\[CDATA\[")
QUOTES = re.compile(rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>", re.S)


def inside_quote(data: bytes, at: int) -> bool:
    """Whether `at` lies in a comment or a CDATA section, where tags are text."""
    here = 0
    while m := QUOTE.search(data, here, at):
        here = data.find(b"-->" if m[0] == b"<!--" else b"]]>", m.end())
        if here < 0 or here > at:
            return True
    return False


def cut(stream, head: bytes, prefix: bytes, name: bytes, root: re.Match, piece_bytes: int) -> Iterator[tuple[str, int, bytes]]:
    """The pieces of a worksheet or of shared strings, each with the root and the holder of its units around it."""
    holder, unit = CUT[name]
    opening = re.compile(rb"<" + prefix + unit + rb"(?=[\s>/])")
    tag = b"<" + prefix + holder + b">" if holder != name else b""
    before = (m[0] if (m := DECLARATION.match(head)) else b"") + root[0] + tag
    after = (b"</" + prefix + holder + b">" if tag else b"") + b"</" + prefix + name + b">"
    data, first, rows = head, True, 0
    while True:
        more = stream.read(piece_bytes)
        data += more
        place = 0
        if more and len(data) >= piece_bytes:
            place = len(data)
            while (place := data.rfind(b"<" + prefix + unit, 0, place)) > 0 and (not opening.match(data, place) or inside_quote(data, place)):
                pass
        if more and place <= 0:
            continue
        if not more:
            yield name.decode(), rows, data if first else before + data
            return
        piece = data[:place]
        yield name.decode(), rows, (piece if first else before + piece) + after
        rows, data, first = last_row(piece, opening, rows), data[place:], False


def last_row(piece: bytes, opening: re.Pattern, rows: int) -> int:
    """The number of the last row in a piece, rows without a number being counted on."""
    if b"<!" in piece:
        piece = QUOTES.sub(b"", piece)
    tags = [m.end() for m in opening.finditer(piece)]
    number = lambda at: ROW_NUMBER.search(piece, at, piece.find(b">", at))
    if not tags or (last := number(tags[-1])):
        return int(last[1]) if tags else rows
    for at in tags:
        rows = int(m[1]) if (m := number(at)) else rows + 1
    return rows


# ------------------------------------------------------------------------------------------------ parsing


_KINDS = {"piece": pa.int32(), "seq": pa.int64(), "nth": pa.int64(), "attrs": pa.map_(pa.string(), pa.string()), "row_no": pa.int64(), "col_no": pa.int64(), "style_id": pa.int64()}
_NAMES = [f.split()[0] for f in re.sub(r"map<[^>]*>", "map", ELEMENTS).split(", ")]
ELEMENT_SCHEMA = pa.schema([(n, _KINDS.get(n, pa.string())) for n in _NAMES])


class Rows:
    """Elements as columns, given out as Arrow batches."""

    def __init__(self, sha256: str, path: str, part: str, piece: int):
        self.same = {"sha256": sha256, "path": path, "part": part, "piece": piece}
        self.columns: dict[str, list] = {n: [] for n in _NAMES if n not in self.same}

    def add(self, values: dict) -> None:
        for n, column in self.columns.items():
            column.append(values.get(n))

    def batch(self) -> pa.RecordBatch:
        n = len(self.columns["seq"])
        out = pa.RecordBatch.from_arrays([pa.array([self.same[f.name]] * n if f.name in self.same else self.columns[f.name], f.type) for f in ELEMENT_SCHEMA], schema=ELEMENT_SCHEMA)
        self.columns = {k: [] for k in self.columns}
        return out


def read_elements(parts: DataFrame) -> DataFrame:
    """ELEMENTS of each piece, in order. A piece that is no XML gives one element `error`; a piece of a part that can be
    cut, besides, an element `piece` with the number of its strings and
    the counts of a sheet's objects by tag. nth counts the elements of a tag within a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sha256, path, part, part_seq, piece, rows_before, xml = (batch.column(k)[i].as_py() for k in range(7))
                rows = Rows(sha256, path, part, piece)
                for number, element in enumerate(elements(xml, rows_before)):
                    if element["tag"] == "error":
                        element["attrs"] = [("part_seq", str(part_seq))]
                    rows.add({"seq": (piece << SEQ_BITS) + number, **element})
                    if number % 20_000 == 19_999:
                        yield rows.batch()
                yield rows.batch()

    return parts.where("xml is not null").select("sha256", "path", F.col("name").alias("part"), "part_seq", "piece", "rows_before", "xml").mapInArrow(run, ELEMENTS)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def elements(xml: bytes, rows_before: int = 0) -> Iterator[dict]:
    """The elements at the places of a part's root. Formulas of a validation are among its attributes."""
    try:
        root = ElementTree.fromstring(xml)
    except (ElementTree.ParseError, ValueError, LookupError) as e:
        yield {"tag": "error", "nth": 0, "text": str(e)}
        return
    name, space = local(root.tag), root.tag.rpartition("}")[0] + "}" if root.tag.startswith("{") else ""
    counts: dict[str, int] = {}
    strings = 0
    for element in _placed(root, name, space, rows_before):
        if name == "worksheet" and counts_as_object(element):
            counts[element["tag"]] = counts.get(element["tag"], 0) + 1
        strings += element["tag"] == "si"
        yield element
    if name in BULK:
        yield {"tag": "piece", "nth": strings, "attrs": [(tag, str(n)) for tag, n in counts.items()]}


def _placed(root: ElementTree.Element, name: str, space: str, rows_before: int) -> Iterator[dict]:
    for place in PLACES.get(name, ()):
        found = [root] if place == "." else root.iterfind("/".join(space + step for step in place.split("/")))
        if place == "sheetData/row":
            yield from sheet_rows(found, space, rows_before)
            continue
        for nth, node in enumerate(found):
            yield {"tag": local(node.tag), "nth": nth, "attrs": attributes(node), "text": joined_text(node, space) if local(node.tag) in ("si", "comment") else node.text}


def counts_as_object(element: dict) -> bool:
    """Whether a sheet's element is something that the inventory lists. The parser's own count, which the frames made by
    joins are held against."""
    tag, attrs = element["tag"], dict(element.get("attrs") or ())
    if tag == "c":
        return any(element.get(k) is not None for k in ("v", "f", "si", "inline"))
    yes = lambda key: attrs.get(key, "").lower() in ("1", "true")
    if tag in ("row", "col"):
        size = attrs.get("ht", "") if tag == "row" else attrs.get("width", "13")
        return yes("hidden") or bool(SIZE.fullmatch(size)) and float(size) != 0 or tag == "col" and not SIZE.fullmatch(size)
    return tag in ("mergeCell", "dataValidation") or tag == "sheetProtection" and yes("sheet") or tag == "pane" and element["nth"] == 0 and attrs.get("state") in ("frozen", "frozenSplit") and "topLeftCell" in attrs


def attributes(node: ElementTree.Element) -> list[tuple[str, str]]:
    out = [(k.replace(RELATION, "r:").replace(STRICT_RELATION, "r:").rpartition("}")[2], v) for k, v in node.attrib.items()]
    if local(node.tag) == "dataValidation":
        out += [(local(child.tag), child.text or "") for child in node]
    return list(dict(out).items())


def sheet_rows(rows: Iterator[ElementTree.Element], space: str, row_no: int) -> Iterator[dict]:
    """Rows and cells. What has no address stands next to what came before."""
    cell, shown = space + "c", 0
    count = 0
    for row in rows:
        number = row.get("r")
        row_no = int(number) if number and number.isdigit() else row_no + 1
        yield {"tag": "row", "nth": shown, "attrs": attributes(row), "row_no": row_no}
        shown += 1
        col_no, at = 0, row_no
        for c in row.iterfind(cell):
            if m := CELL_ADDRESS.match(c.get("r", "")):
                col_no, at = column_number(m[1].upper()), int(m[2])
            else:
                col_no += 1
            style = c.get("s", "0")
            out = {"tag": "c", "nth": count, "row_no": at, "col_no": col_no, "t": c.get("t", "n"), "style_id": int(style) if style.isdigit() else 0}
            for child in c:
                tag = local(child.tag)
                if tag == "v":
                    out["v"] = child.text or None
                elif tag == "is":
                    out["inline"] = joined_text(child, space)
                elif tag == "f":
                    out["f"] = child.text or None
                    out["si"] = child.get("si") if child.get("t") == "shared" else None
            count += 1
            yield out


def joined_text(node: ElementTree.Element, space: str) -> str:
    """The text of all runs, without phonetic hints."""
    hints = {t for hint in node.iter(space + "rPh") for t in hint.iter(space + "t")}
    return "".join(t.text or "" for t in node.iter(space + "t") if t not in hints)


def column_number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n

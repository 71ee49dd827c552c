"""WARC archives: pages written as records, and a reader that salvages what is left of damaged archives.

`write_warc` writes one file a task, every record a gzip member of its own (or plain), through Spark's text sink: that
reaches any file system, and commits files of finished tasks only. The sink ends each row with a separator, so the
separator is chosen as what a record ends with: the last CRLF of a plain record, the last byte of a member, which is
zero unless the record has 16 MiB or more (a zero after such a member is padding that readers skip).

Equal payloads of at least `MIN_REVISIT` bytes are stored once: the row with the smallest page_id is the response, the
others are revisit records that refer to it. Only digests are exchanged to find them; the pages join the table of the
digests that occur more than once, which the planner broadcasts while it is small, and can split where one is hot.

`scan_warc` streams each archive in one task and holds one record at a time. A record is taken only if all checks hold:
the member inflates with its checksum and length, version line and mandatory fields are there, the block ends where
Content-Length says, and stated block and payload digests agree. Where a check fails, the next place is sought at which
a whole valid member, or a whole valid record at a version line, begins; what lies between is logged as a quarantined
gap with its first and last byte and the reason. Damaged bytes can hide a record from no other record's sight.

Archives are opened by pyarrow where it knows the file system (local, HDFS, S3, GCS); others come through Spark's
binaryFile source, a whole archive at a time.

Defined results: a null html is an empty payload, a null url becomes a urn of the page; a null page_id counts as the
greatest and stays null; rows of equal page_id and payload are all responses (or all revisits), as none of them is
smaller than the other; an empty table gives archives without pages; other columns are not read. A record that is longer
than `max_record` (a row can't hold it) is quarantined.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import checkpoint_dir, written

MIN_REVISIT = 100
MAX_RECORD = 1 << 30
MAX_HEADER = 1 << 20
CHUNK = 1 << 20
#: What begins a gzip member and a record, and the fields that each record must have.
MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/\d\.\d{1,2}\r\n")
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/\d")
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCAN = (
    "path string, start long, end long, reason string, warc_type string, record_id string, target_uri string, headers map<string,string>, "
    "payload_bytes long, payload_sha256 string, payload binary"
)


# ------------------------------------------------------------------------------------------------ writing


def page_uri(page_id: int | None, url: str | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{'' if page_id is None else page_id}"


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest} {url}'.encode('utf-8', 'replace')).digest())}>"


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record: version line, fields that have a value, length, block."""
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def info_record(date: str) -> bytes:
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def page_record(page: dict, date: str) -> bytes:
    """A page as a response, or, where `first_page` names another, as a revisit of that (its HTTP head without payload)."""
    html, again = page["html"] or b"", page["first_page"] is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page["page_id"], page["url"], page["digest"])), ("WARC-Date", date), ("WARC-Target-URI", page_uri(page["page_id"], page["url"])),
        ("WARC-Payload-Digest", f"sha256:{page['digest']}"), ("Page-ID", None if page["page_id"] is None else str(page["page_id"])), ("Content-Type", "application/http; msgtype=response"),
    ]
    if again:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(page["first_page"], page["first_url"], page["digest"])), ("WARC-Refers-To-Target-URI", page_uri(page["first_page"], page["first_url"])), ("Refers-To-Page-ID", str(page["first_page"]))]
    return record(fields, head if again else head + html)


def with_first_pages(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html as bytes, digest, first_page, first_url): the last two only of pages that are revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    large = rows.where(F.octet_length("html") >= min_revisit)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))))
    repeated = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1 and first is not null").select("digest", "first")
    found = rows.join(written(repeated), "digest", "left")
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first.page_id")))
    return found.select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", F.when(later, F.col("first.page_id")).alias("first_page"), F.when(later, F.nullif("first.url", F.lit(""))).alias("first_url"))


def write_warc(pages: DataFrame, folder: str, compress: bool = True, min_revisit: int = MIN_REVISIT, date: str | None = None) -> None:
    """The pages (page_id, url, html) as archives in a new folder, one for each task, a warcinfo record first."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    ending = b"\x00" if compress else b"\r\n"
    schema = pa.schema([("value", pa.binary())])

    def row(data: bytes) -> bytes:
        data = gzip.compress(data, 6, mtime=0) if compress else data
        return data.removesuffix(ending)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size = [row(info_record(date))], 0
        for batch in batches:
            for i in range(batch.num_rows):
                ready.append(row(page_record({c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}, date)))
                size += len(ready[-1])
                if size >= 8 * CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(ready, pa.binary())], schema=schema)
                    ready, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ready, pa.binary())], schema=schema)

    records = with_first_pages(pages, min_revisit).mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", ending.decode()).text(folder)


# ------------------------------------------------------------------------------------------------ reading


class Bad(Exception):
    """Why no valid record begins here."""


class Source:
    """A file as it streams by: what lies from `base` on and has been read."""

    def __init__(self, read, data: bytes = b""):
        self.read, self.base, self.data, self.done = read, 0, bytearray(data), read is None

    def has(self, end: int) -> bool:
        """Whether the file reaches `end`; reads up to there."""
        while not self.done and self.base + len(self.data) < end:
            more = self.read(max(CHUNK, end - self.base - len(self.data)))
            self.data += more
            self.done = not more
        return self.base + len(self.data) >= end

    def get(self, start: int, end: int) -> bytes:
        self.has(end)
        return bytes(self.data[max(0, start - self.base) : end - self.base])

    def drop(self, before: int) -> None:
        if before - self.base >= CHUNK or self.done:
            del self.data[: before - self.base]
            self.base = before

    def find(self, start: int) -> int | None:
        """The first place from `start` on where a member or version line may begin; scanned bytes are dropped."""
        while True:
            self.has(start + CHUNK)
            if hit := NEXT.search(self.data, start - self.base):
                return self.base + hit.start()
            end = self.base + len(self.data)
            if self.done:
                return None
            start = max(start, end - 8)
            self.drop(start)


def digest_holds(stated: str | None, data: bytes) -> bool:
    """Whether a digest, like sha1:BASE32 or sha256:hex, is that of data; unknown kinds say nothing."""
    kind, _, value = (stated or "").partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512") or not value:
        return True
    own = hashlib.new(kind, data).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def fields_of(head: bytes) -> dict[str, str]:
    """The fields of a record or HTTP head by their names in lower case; lines that go on are joined."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Bad("a header line without a name")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def record_at(src: Source, start: int, max_record: int) -> tuple[int, dict[str, str], bytes]:
    """(end, fields, block) of the plain record at `start`; Bad where any check fails."""
    if not VERSION.match(src.get(start, start + 12)):
        raise Bad("no version line")
    size = 4096
    while (stop := src.get(start, start + size).find(b"\r\n\r\n")) < 0:
        if not src.has(start + size + 1) or size >= MAX_HEADER:
            raise Bad("a header without an end")
        size *= 4
    fields = fields_of(src.get(start, start + stop))
    if missing := [f for f in MANDATORY if f not in fields]:
        raise Bad(f"no field {missing[0]}")
    length = fields["content-length"]
    if not (length.isascii() and length.isdigit()):
        raise Bad("a length that is no number")
    begin, end = start + stop + 4, start + stop + 4 + int(length)
    if int(length) > max_record:
        raise Bad("longer than the bound")
    if not src.has(end + 4):
        raise Bad("cut off before its end")
    if src.get(end, end + 4) != b"\r\n\r\n":
        raise Bad("no end where its length puts it")
    block = src.get(begin, end)
    if not digest_holds(fields.get("warc-block-digest"), block):
        raise Bad("another block digest")
    return end + 4, fields, block


def member_at(src: Source, start: int, max_record: int) -> tuple[int, bytes]:
    """(end, content) of the gzip member at `start`; Bad where it doesn't inflate, or holds no record."""
    inflate, at, out = zlib.decompressobj(31), start, bytearray()
    try:
        while not inflate.eof:
            piece = inflate.unconsumed_tail
            if not piece:
                src.has(at + 1)  # what is at hand, or else the next chunk
                piece = src.get(at, min(at + CHUNK, max(at + 1, src.base + len(src.data))))
                if not piece:
                    raise Bad("a member cut off before its end")
                at += len(piece)
            out += inflate.decompress(piece, CHUNK)
            if not b"WARC/".startswith(bytes(out[:5])):
                raise Bad("a member without a record")
            if len(out) > max_record + MAX_HEADER:
                raise Bad("longer than the bound")
    except zlib.error as e:
        raise Bad(f"a damaged member: {re.sub(r'.*: ', '', str(e))}") from None
    return at - len(inflate.unused_data), bytes(out)


def parsed(fields: dict[str, str], block: bytes) -> dict:
    """The columns of a valid record; Bad where the payload has another digest than is stated."""
    payload, http = block, {}
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        http = fields_of(head) if gap else {}
    kind, stated = fields["warc-type"].lower(), fields.get("warc-payload-digest")
    if kind == "revisit":
        length = http.get("content-length", "")
        size, digest = int(length) if length.isdigit() else None, (stated or "").removeprefix("sha256:") if (stated or "").startswith("sha256:") else None
    else:
        if not {"transfer-encoding", "content-encoding"} & http.keys() and "warc-truncated" not in fields and not digest_holds(stated, payload):
            raise Bad("another payload digest")
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return {"warc_type": kind, "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"), "headers": list(fields.items()), "payload_bytes": size, "payload_sha256": digest, "payload": payload}


def salvage(src: Source, max_record: int = MAX_RECORD) -> Iterator[dict]:
    """The valid records of an archive in order, and between them the gaps that hold none (a row with a reason)."""
    at, gap, reason = 0, None, ""
    while src.has(at + 1):
        try:
            found: list[dict] = []
            if src.get(at, at + 3) == MAGIC:
                end, content = member_at(src, at, max_record)
                found = list(salvage(Source(None, content), max_record)) if content else []
                if not any(r["reason"] is None for r in found):
                    raise Bad(found[0]["reason"] if found else "a member without a record")
                for r in found:
                    r |= {"start": at, "end": end}
            else:
                end, fields, block = record_at(src, at, max_record)
                found = [{"start": at, "end": end, "reason": None, **parsed(fields, block)}]
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            following = src.find(at + 1)
            if following is None:
                break
            at = following
            continue
        if gap is not None:
            yield {"start": gap, "end": at, "reason": reason}
            gap = None
        yield from found
        at = end
        while src.get(at, at + 1) == b"\x00":  # padding
            at += 1
        src.drop(at)
    if gap is not None:
        while src.has(src.base + len(src.data) + 1):
            src.drop(src.base + len(src.data))
        yield {"start": gap, "end": src.base + len(src.data), "reason": reason}


def opened(path: str):
    """(file system, path in it): by pyarrow; an error where it doesn't know the file system."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def scan_warc(spark: SparkSession, folder: str, payloads: bool = True, max_record: int = MAX_RECORD) -> DataFrame:
    """A row for each valid record (reason null) and for each quarantined gap of the archives in `folder`. payload_bytes
    and payload_sha256 are those of the payload found, or, of revisits, those stated of the payload that is not there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    try:
        opened(folder)
        files = files.select("path", F.lit(None).cast("binary").alias("content"))  # only the names come from Spark
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        files = files.select("path", "content")
    names = [f.split()[0] for f in re.sub(r"map<[^>]*>", "map", SCAN).split(", ")]
    kinds = {"start": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def rows(path: str, content: bytes | None) -> Iterator[dict]:
        if content is not None:
            yield from salvage(Source(None, content), max_record)
            return
        system, place = opened(path)
        with system.open_input_stream(place) as stream:
            yield from salvage(Source(stream.read), max_record)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.to_pylist():
                ready, size = [], 0
                for r in rows(archive["path"], archive["content"]):
                    size += len(r.get("payload") or b"") if payloads else 0
                    ready.append({"path": archive["path"], **r} | ({} if payloads else {"payload": None}))
                    if size >= 8 * CHUNK or len(ready) == 2000:
                        yield pa.RecordBatch.from_pylist(ready, schema=schema)
                        ready, size = [], 0
                yield pa.RecordBatch.from_pylist(ready, schema=schema)

    return files.mapInArrow(run, SCAN)


def records(scan: DataFrame) -> DataFrame:
    return scan.where("reason is null").drop("reason")


def gaps(scan: DataFrame) -> DataFrame:
    """(path, start, end, reason): the bytes from start to before end hold no valid record."""
    return scan.where("reason is not null").select("path", "start", "end", "reason")


def page_report(scan: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page in the archives."""
    field = lambda name: F.col("headers")[name].cast("long")
    pages = records(scan).where("warc_type in ('response', 'revisit')")
    return pages.select(field("page-id").alias("page_id"), "payload_bytes", F.col("payload_sha256").alias("payload_digest"), F.col("warc_type").alias("record_type"), field("refers-to-page-id").alias("refers_to"))


def round_trip(pages: DataFrame, compress: bool = True) -> DataFrame:
    """The report of pages written to the shared folder and read back."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, folder, compress)
    return page_report(scan_warc(spark, folder, payloads=False))


ORACLE = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, coalesce(html, '') as html, min(page_id) over (partition by coalesce(html, '')) as first from pages
), r as (
  select *, payload_bytes >= 100 and first is not null and (page_id is null or page_id > first) as again from p
)
select page_id, payload_bytes, sha256(html) as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to from r
"""

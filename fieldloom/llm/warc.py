"""Web archives: a converter of legacy ARC archives, and WARC archives written and read.

ARC files state their version and field names in a first ``filedesc://`` record; every other
record is a line of those fields, the last of which is the declared length of what follows.
The converter synthesises WARC records of the same contents: identifiers from the records
themselves, dates from the 14-digit stamps, types from the contents, SHA-1 digests.

Archives are rows of a binary column: files that ``spark.read.format("binaryFile")`` reads
(``read_files``), or parts of ``ARCHIVE_BYTES`` that a task wrote.  ARC archives may be plain or of
gzip members; WARC archives are of gzip members, one a record.  ``convert`` reads the archives
twice: once for the digests alone, of which the repeated ones meet by digest, and once to write;
payloads are shuffled only where more than ``BROADCAST_IDS`` records are revisits, and then by
record, so no payload, however common, is a key of its own.

Payloads are equal when their SHA-1 and size are, which is what a revisit by digest says.  Null
payloads are empty, null addresses are written as ``-``, a null page_id stays null and its record
is a response.  Repeated rows are records of their own; those with the largest page_id of their
payload are responses all.  A long payload is worked on by one task.  Extra columns of any name
are ignored.  An empty table gives an empty table.  A broken archive raises ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import stored

#: Bytes of compressed records in one row of archives, and of records in one batch.
ARCHIVE_BYTES, BATCH_BYTES = 2 << 20, 4 << 20
#: Revisits (about 200 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1 << 17
#: The names of the ARC fields, in order: fixed values of the format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_PAGE = b"X-Page-Id"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    version: int


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in (self.headers | {"Content-Length": str(len(self.block))}).items())
        return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + self.block + b"\r\n\r\n"


#: A revisit's header for the length of the payload that it hasn't.
_LENGTH = "WARC-Payload-Length"
_EMPTY_LINE = re.compile(rb"\r?\n\r?\n")


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def split_http(block: bytes) -> tuple[bytes, dict[bytes, bytes], bytes]:
    """Status line, headers (names as they are written, values without white space around) and payload of an HTTP response; a block of another kind is all payload.

    The head ends at the first empty line, and lines end at a line feed, with or without a carriage
    return before it, as both stand in archives.  A head without an empty line has an empty payload.
    Transfer and content codings are left as they are: the payload is what was sent.
    """
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    end = _EMPTY_LINE.search(block)
    head, payload = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    status, *lines = (x.rstrip(b"\r") for x in head.split(b"\n"))
    pairs = (x.split(b":", 1) for x in lines if b":" in x)
    return status, {k.strip(): v.strip() for k, v in pairs}, payload


# ARC


def arc_version_block(version: int, filename: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    return arc_record(version, {"URL": f"filedesc://{filename}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain"}, body)


def arc_record(version: int, fields: dict[str, str], block: bytes) -> bytes:
    fields = fields | {"Archive-length": str(len(block))}
    line = " ".join(fields.get(k) or "-" for k in ARC_FIELDS[version])
    return line.encode() + b"\n" + block + b"\n"


def parse_arc(raw: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC archive, plain or of gzip members, the version block first.

    Field names are those that the version block declares, or those of its version where it
    declares none.  A length that isn't a number or goes beyond the archive raises ValueError.
    """
    names, version = None, 1
    for part in members(raw) if raw[:2] == b"\x1f\x8b" else (raw,):
        at = 0
        while at < len(part):
            if part[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = part.find(b"\n", at)
            if end < 0:
                raise ValueError(f"no header line at byte {at}")
            words = part[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
            first = names is None
            if first:
                # the version block itself has the five fields of version 1, or the ten of version 2
                names = ARC_FIELDS[2] if len(words) == len(ARC_FIELDS[2]) else ARC_FIELDS[1]
            if len(words) < len(names):
                raise ValueError(f"{len(words)} fields at byte {at}; {len(names)} are declared")
            # an address may hold spaces: what is left over belongs to the first field
            extra = len(words) - len(names)
            fields = dict(zip(names, [" ".join(words[: extra + 1]), *words[extra + 1 :]]))
            if not fields["Archive-length"].isdigit() or end + 1 + (size := int(fields["Archive-length"])) > len(part):
                raise ValueError(f"length {fields['Archive-length']!r} at byte {at}")
            block = part[end + 1 : end + 1 + size]
            if first:
                about, _, rest = block.partition(b"\n")
                if m := re.match(rb"(\d+)\s", about):
                    version = int(m[1])
                declared = rest.split(b"\n", 1)[0].decode("utf-8", "replace").split()
                names = declared if declared and declared[-1] == "Archive-length" else ARC_FIELDS.get(version, ARC_FIELDS[1])
            yield ArcRecord(fields, block, version)
            at = end + 1 + size


def to_warc(arc: ArcRecord) -> WarcRecord:
    """The WARC record that says the same: warcinfo for the version block, response for HTTP, resource for the rest."""
    url, date = arc.fields["URL"], arc.fields["Archive-date"].ljust(14, "0")
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    _, http, payload = split_http(arc.block)
    kind = "warcinfo" if url.startswith("filedesc:") else "response" if http or arc.block.startswith(b"HTTP/") else "resource"
    page = http.get(_PAGE)
    key = f"page:{page.decode()}" if page else f"{url} {date} {digest(arc.block)}"
    out = {"WARC-Type": kind, "WARC-Record-ID": record_id(key), "WARC-Date": stamp}
    if kind == "warcinfo":
        return WarcRecord(out | {"WARC-Filename": url.removeprefix("filedesc://"), "Content-Type": "text/plain"}, arc.block)
    if arc.fields["IP-address"] not in ("-", "0.0.0.0"):
        out["WARC-IP-Address"] = arc.fields["IP-address"]
    mime = "application/http; msgtype=response" if kind == "response" else arc.fields["Content-type"]
    return WarcRecord(out | {"WARC-Target-URI": url, "WARC-Block-Digest": f"sha1:{digest(arc.block)}", "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": mime}, arc.block)


def as_revisit(record: WarcRecord, refers_to: str) -> WarcRecord:
    """The record without its payload, which ``refers_to`` (a record identifier) has; the payload's length stays as a header."""
    payload = split_http(record.block)[2]
    head = record.block[: len(record.block) - len(payload)]
    more = {"WARC-Type": "revisit", _LENGTH: str(len(payload)), "WARC-Refers-To": refers_to, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Block-Digest": f"sha1:{digest(head)}"}
    return WarcRecord(record.headers | more, head)


# WARC


def members(raw: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, each decompressed."""
    view, at = memoryview(raw), 0
    while at < len(view):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a member")
            step = view[at : at + 16384]
            parts.append(one.decompress(step))
            at += len(step) - len(one.unused_data)
        yield b"".join(parts)


def parse_warc(raw: bytes) -> Iterator[WarcRecord]:
    """Records of uncompressed WARC bytes."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield WarcRecord(headers, raw[end + 4 : end + 4 + size])
        at = end + 4 + size + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive) of the ARC or WARC files of a folder, in any store that Spark reads; a file is a row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("content").alias("archive"))


def _archives(members_: Iterator[bytes], head: bytes = b"") -> Iterator[pa.RecordBatch]:
    """Gzip members gathered to archives, each of which begins with ``head``."""
    rows, size = [], 0
    for member in members_:
        rows.append(member)
        size += len(member)
        if size >= ARCHIVE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([head + b"".join(rows)], pa.binary())], ["archive"])
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([head + b"".join(rows)], pa.binary())], ["archive"])


def write_arc(pages: DataFrame, date: str = "20240101000000", version: int | None = None) -> DataFrame:
    """(archive): pages laid down as ARC archives of this version; by default of version 1 in every other partition, of 2 in the rest."""
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), (F.spark_partition_id() % 2 + 1 if version is None else F.lit(version)).alias("version"))

    def run(batches):
        first = next(batches, None)
        if first is None or not first.num_rows:
            return
        own = first.column("version")[0].as_py()

        def records():
            for b in chain([first], batches):
                for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    payload = (html or "").encode()
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
                    if page_id is not None:
                        head += _PAGE + b": %d\r\n" % page_id
                    address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "-")
                    fields = {"URL": address, "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": "-"}
                    yield gzip.compress(arc_record(own, fields, head + b"\r\n" + payload), 1, mtime=0)

        yield from _archives(records(), gzip.compress(arc_version_block(own, "pages.arc", date), 1, mtime=0))

    return given.mapInArrow(run, "archive binary")


def _converted(raw: bytes) -> Iterator[tuple[WarcRecord, int | None, int, str]]:
    """Records of an ARC archive as WARC, but for its version block: with page_id (if its head has one), size and digest of the payload."""
    for arc in parse_arc(raw):
        record = to_warc(arc)
        if record.headers["WARC-Type"] != "warcinfo":
            _, http, payload = split_http(record.block)
            yield record, int(http[_PAGE]) if _PAGE in http else None, len(payload), record.headers["WARC-Payload-Digest"]


def revisit_table(archives: DataFrame, min_bytes: int = 0, unnumbered: bool = False) -> DataFrame:
    """(record_id, digest, refers_to): responses whose payload a later one has, and that one's identifier.

    The later of two is that with the larger page_id.  Responses without one, as in archives from
    elsewhere, take part where ``unnumbered`` says so: they come before all that have one, and
    among them the later date and then the greater identifier counts.  Payloads stay in their task.
    """
    names = ["record_id", "page_id", "date", "size", "digest"]

    def run(batches):
        for b in batches:
            for raw in b.column("archive"):
                rows = [(r.headers["WARC-Record-ID"], page, r.headers["WARC-Date"], size, d) for r, page, size, d in _converted(raw.as_py()) if r.headers["WARC-Type"] == "response"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))], names)

    keys = stored(archives.mapInArrow(run, "record_id string, page_id long, date string, size long, digest string").where((F.lit(unnumbered) | F.col("page_id").isNotNull()) & (F.col("size") >= min_bytes)).distinct(), "digests")
    last = keys.groupBy("digest", "size").agg(F.max(F.struct("page_id", "date", "record_id"))["record_id"].alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keys.join(last, ["digest", "size"]).where("record_id <> refers_to").select("record_id", "digest", "refers_to").distinct()


def convert(archives: DataFrame, min_bytes: int = 0, unnumbered: bool = False) -> DataFrame:
    """(archive): ARC archives as WARC archives, repeated payloads as revisits, also those of responses without a page number where ``unnumbered`` says so."""
    refers = stored(revisit_table(archives, min_bytes, unnumbered), "revisits")

    def rows(batches):
        """The records, some megabytes to a batch."""
        names = ["record_id", "digest", "head", "block"]
        held, size = [], 0
        for b in batches:
            for raw in b.column("archive"):
                for record, _, _, d in _converted(raw.as_py()):
                    held.append((record.headers["WARC-Record-ID"], d, json.dumps(record.headers), record.block))
                    size += len(record.block)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    types = (pa.string(), pa.string(), pa.string(), pa.binary())

    def write(batches):
        def records():
            for b in batches:
                for head, block, last in zip(*(b.column(c) for c in ("head", "block", "refers_to"))):
                    record = WarcRecord(json.loads(head.as_py()), block.as_py())
                    if last.is_valid:
                        record = as_revisit(record, last.as_py())
                    yield gzip.compress(record.to_bytes(), 1, mtime=0)

        yield from _archives(records())

    found = archives.mapInArrow(rows, "record_id string, digest string, head string, block binary")
    joined = found.join(F.broadcast(refers) if refers.count() <= BROADCAST_IDS else refers, ["record_id", "digest"], "left")
    return joined.select("head", "block", "refers_to").mapInArrow(write, "archive binary")


def read_archives(archives: DataFrame, column: str = "archive") -> DataFrame:
    """A row for each record: record_id, record_type, refers_to_id, target_uri, date, page_id, payload_bytes, payload_digest."""
    schema = "record_id string, record_type string, refers_to_id string, target_uri string, date string, page_id long, payload_bytes long, payload_digest string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for b in batches:
            for raw in b.column(column):
                rows = []
                for member in members(raw.as_py()):
                    for r in parse_warc(member):
                        _, http, payload = split_http(r.block)
                        kind, page = r.headers["WARC-Type"], http.get(_PAGE)
                        size = int(r.headers.get(_LENGTH) or http.get(b"Content-Length", b"0")) if kind == "revisit" else len(payload)
                        rows.append((r.headers["WARC-Record-ID"], kind, r.headers.get("WARC-Refers-To"), r.headers.get("WARC-Target-URI"), r.headers["WARC-Date"], int(page) if page else None, size, r.headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return archives.select(column).mapInArrow(run, schema)


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of pages, by way of ARC archives and their conversion."""
    archives = stored(convert(stored(write_arc(pages), "arc")), "warc")
    records = stored(read_archives(archives), "records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = records.where("record_type = 'revisit'")
    responses = records.where("record_type = 'response'").join(again.select(F.col("refers_to_id").alias("record_id")), "record_id", "left_semi")
    responses = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    # responses refer to nothing, so they take no part in the join
    own = records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return own.select(columns).union(again.join(responses, "refers_to_id", "left").select(columns))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op8_warc": op8_warc}
ORACLE_SQL = {
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last,
            list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS INTEGER) + 1, 1)) AS b FROM p)
        SELECT page_id, payload_bytes, array_to_string(b, '') AS payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN last <> page_id THEN last END AS refers_to FROM d
    """
}

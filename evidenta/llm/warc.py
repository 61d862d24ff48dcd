"""Converter of legacy ARC archives to WARC.

An ARC file begins with a version block: a `filedesc:` record whose body names the version and the fields of the header lines
that follow. Version 1 lines have five fields (URL, IP address, date, content type, length), version 2 lines ten (a result
code, checksum, location, offset and file name come before the length). Every record is a line, as many bytes as it declares,
and a newline. The converter reads the version block first, then takes records by declared lengths only, so payloads may hold
lines that look like headers.

Header lines are taken apart from both ends, so a URL or content type may hold blanks. Bytes where a header line should be but
none is, and a last record that ends before its declared length, are damage: each such stretch becomes a record of its own, of
status `damaged` and without a URL, up to the next header line. Nothing is dropped. `parse_arc` raises instead if asked to.

Records are bytes from end to end: they travel in binary columns and are written as they are by Spark's text writer with
gzip, one record per row, in files of about FILE_BYTES, so the commit protocol covers them and a lost executor leaves none
behind. Readers take one file per row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenta.llm.common import slices, store
from evidenta.llm.components import hub_join

#: A file is closed at about so many bytes (a single record may be longer).
FILE_BYTES = 4 << 20
#: Fields of header lines by ARC version, and the WARC profile of revisits.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header lines of both versions.
LINES = {
    1: re.compile(rb"(?P<url>[^\n]*?) (?P<ip>[^ \n]+) (?P<date>\d{4,14}) (?P<mime>[^\n]*) (?P<length>\d+)\r?\n"),
    2: re.compile(rb"(?P<url>[^\n]*?) (?P<ip>[^ \n]+) (?P<date>\d{4,14}) (?P<mime>[^\n]*) (?P<status>[^ \n]+) [^ \n]+ [^ \n]+ \d+ [^ \n]+ (?P<length>\d+)\r?\n"),
}
DAMAGED = "damaged"
#: What is to be known of the copies, by file, is broadcast up to so many bytes by its measured size.
BROADCAST_BYTES = 32 << 20
DATE = "20240101000000"
KEY = b"x-archive-key"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    status: str
    offset: int
    block: bytes


def sha1(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_field(text: str | None) -> str:
    """A value as a field of a header line: white space, controls and what is outside ASCII are percent-encoded; `-` for none."""
    return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in (text or "").encode()) or "-"


def arc_record(version: int, url: str | None, block: bytes, mime: str = "text/html", status: str = "200", date: str = DATE, ip: str = "0.0.0.0", name: str = "-") -> bytes:
    """A record of an ARC file, without the newline behind it."""
    middle = f" {status} {sha1(block)} - 0 {name}" if version == 2 else ""
    return f"{header_field(url)} {ip} {date} {mime}{middle} {len(block)}\n".encode() + block


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 evidenta\n{FIELDS[version]}\n".encode()
    return arc_record(version, f"filedesc://{name}", body, "text/plain")


def http_block(key, payload: bytes) -> bytes:
    """An HTTP response whose body is the payload; the key, if any, travels as a header."""
    named = f"X-Archive-Key: {key}\r\n" if key is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_parts(block: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Headers (lower-case names) and body of an HTTP block; a block that isn't HTTP is all body."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        head, _, body = block.partition(b"\n\n")
    lines = (x.partition(b":") for x in head.splitlines()[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}, body


def parse_arc(data: bytes, strict: bool = False) -> Iterator[ArcRecord]:
    """Records of an ARC file, the version block first; damage is a record of its own, or a ValueError if `strict`.

    Without a version block, lines are taken for those of version 1.
    """
    at, line = 0, LINES[1]
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        found = (LINES[2].match(data, at) or LINES[1].match(data, at)) if at == 0 else line.match(data, at)
        length = int(found["length"]) if found else 0
        if found and found.end() + length <= len(data):
            block = data[found.end() : found.end() + length]
            by = {k: v.decode("latin-1") for k, v in found.groupdict().items()}
            if at == 0:
                line = LINES[2] if block.startswith(b"2") else LINES[1]
                if strict and not (by["url"].startswith("filedesc:") and block[:1] in b"12"):
                    raise ValueError("no version block")
            yield ArcRecord(by["url"], by["ip"], by["date"], by["mime"], by.get("status", "-"), at, block)
            at = found.end() + length
            continue
        if strict:
            raise ValueError(f"the record at byte {at} ends early" if found else f"no header line at byte {at}")
        # on to the next line that is a header and whose record the file holds
        end = data.find(b"\n", at) + 1
        while 0 < end < len(data) and not ((m := line.match(data, end)) and m.end() + int(m["length"]) <= len(data)):
            end = data.find(b"\n", end) + 1
        end = end if 0 < end < len(data) else len(data)
        yield ArcRecord("-", "0.0.0.0", DATE, "application/octet-stream", DAMAGED, at, data[at:end])
        at = end


def record_id(archive: str, offset: int) -> str:
    """Identifier of the record at a place of an archive, the same each time it is converted."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive}#{offset}')}>"


def warc_date(date: str) -> str:
    """ISO form of a date of 4 to 14 digits."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record without the last of the two line ends behind it."""
    lines = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of a WARC file."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        length = int(head["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"the record at byte {at} ends early")
        yield head, block
        at = end + 4 + length


def _write(rows: DataFrame, path: str, line_end: str) -> None:
    """Write (file, seq, value) rows, in order within a file."""
    # the bytes as they are: the writer doesn't look at a string's encoding
    rows.sortWithinPartitions("file", "seq").select("file", F.col("value").cast("string")).write.partitionBy("file").option("lineSep", line_end).option("compression", "gzip").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of every file below a path; none if the path has no files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt.gz").load(path).select(F.regexp_extract("path", r"(file=[^/]*/[^/]*)$", 1).alias("name"), "content")


def write_arc(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", version: int = 1) -> None:
    """Write ARC files with a record per row; the payload is a text (as UTF-8) or bytes, and empty if null."""
    source = df.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, size = 0, 0
        for batch in batches:
            for part in slices(batch, "payload"):
                out = []
                for k, u, p in zip(*(part.column(c).to_pylist() for c in ("key", "url", "payload")), strict=True):
                    if not out and not size or size > FILE_BYTES:
                        no, size = no + 1, 0
                        out.append((no, 0, version_block(version, str(no))))
                    r = arc_record(version, u, http_block(k, p))
                    size += len(p) + 1
                    out.append((no, size, r))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["file", "seq", "value"])

    _write(source.mapInArrow(run, "file int, seq long, value binary"), path, "\n")


def _arc_rows(name: str, content: bytes) -> Iterator[dict]:
    """What read_arc gives of each captured record of one file."""
    for r in parse_arc(gzip.decompress(content)):
        if r.url.startswith("filedesc:"):
            continue
        head, body = http_parts(r.block)
        key = head.get(KEY)
        yield {"id": record_id(name, r.offset), "key": key and key.decode("latin-1"), "url": r.url, "date": warc_date(r.date), "mime": r.mime, "status": r.status, "digest": sha1(body), "payload_bytes": len(body), "block": r.block}


def read_arc(spark: SparkSession, path: str, block: bool = True) -> DataFrame:
    """(file, id, key, url, date, mime, status, digest, payload_bytes, block) of every captured record of the ARC files below a path.

    The column `block` can be left out.
    """
    names = ["file", "id", "key", "url", "date", "mime", "status", "digest", "payload_bytes", *(["block"] * block)]
    kinds = {"payload_bytes": "long", "block": "binary"}
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(kinds.get(n), pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                rows = [{k: v for k, v in ({"file": name.as_py()} | r).items() if k in names} for r in _arc_rows(name.as_py(), content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return _files(spark, path).mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def convert(spark: SparkSession, arc: str, path: str) -> None:
    """Convert the ARC files below `arc` to WARC files below `path`.

    Of records with equal payloads the one with the largest numeric key (of equal ones the largest identifier; null is least)
    is a response (a resource, if it isn't HTTP), the others are revisits that refer to it. Identifiers follow from archive and
    offset, dates from the header line, digests from the payload.

    The roles are worked out on rows without payloads. What the copies refer to is gathered by file, and the files are read
    once more beside it, so that no payload is shuffled (beyond BROADCAST_BYTES of references, whole compressed files are).
    """
    records = store(read_arc(spark, arc, block=False).select("file", "id", "key", "url", "date", "digest"), "arc-records")
    order = F.struct(F.col("key").try_cast("long").alias("n"), F.col("id").alias("id"), F.col("url").alias("url"), F.col("date").alias("date"))
    # only digests that repeat are joined, by a small row each
    first = records.groupBy("digest").agg(F.max(order).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    total = records.count()
    copies = hub_join(records.select("file", "id", "digest"), first, "digest", "copies", total).where("first.id <> id")
    refers = store(copies.groupBy("file").agg(F.collect_list(F.struct("id", "first")).alias("copies")), "arc-copies")
    size = refers.agg(F.sum(F.length(F.to_json("copies")))).first()[0] or 0
    refers = refers.withColumnRenamed("file", "name")
    files = _files(spark, arc).join(F.broadcast(refers) if size <= BROADCAST_BYTES else refers, "name", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, size, seq = 0, 0, 0
        for batch in batches:
            for name, content, copies in zip(*(batch.column(c) for c in ("name", "content", "copies")), strict=True):
                known = {x["id"]: x["first"] for x in copies.as_py() or ()}
                out, held = [], 0
                for r in _arc_rows(name.as_py(), content.as_py()):
                    same = known.get(r["id"])
                    block = b"" if same else r["block"]
                    fields = [("WARC-Record-ID", r["id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]), ("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("X-Archive-Key", r["key"]), ("X-Payload-Length", r["payload_bytes"])]
                    if same:
                        kind = "revisit"
                        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", same["id"]), ("WARC-Refers-To-Target-URI", same["url"]), ("WARC-Refers-To-Date", same["date"]), ("X-Refers-To-Key", same["n"])]
                    else:
                        http = block.startswith(b"HTTP/")
                        kind = "response" if http else "resource"
                        fields.append(("Content-Type", "application/http; msgtype=response" if http else r["mime"]))
                    if size > FILE_BYTES:
                        no, size = no + 1, 0
                    data = warc_record(kind, fields, block)
                    seq, size, held = seq + 1, size + len(data), held + len(data)
                    out.append((no, seq, data))
                    if held > FILE_BYTES:
                        yield made(out)
                        out, held = [], 0
                if out:
                    yield made(out)

    def made(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["file", "seq", "value"])

    _write(files.mapInArrow(run, "file int, seq long, value binary"), path, "\r\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(key, record_type, payload_bytes, payload_digest, refers_to, target_uri, date, payload) of the records below a path.

    The digest of a record that has its payload is taken from the payload read and must be the one it declares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, block in parse_warc(gzip.decompress(content.as_py())):
                    kind, declared = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    body = None if kind == "revisit" else http_parts(block)[1]
                    if body is not None and (sha1(body) != declared or len(body) != int(head["x-payload-length"])):
                        raise ValueError(f"digest of {head['warc-record-id']} differs")
                    rows.append({"key": head.get("x-archive-key"), "record_type": kind, "payload_bytes": int(head["x-payload-length"]), "payload_digest": declared, "refers_to": head.get("x-refers-to-key"), "target_uri": head["warc-target-uri"], "date": head["warc-date"], "payload": body})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, WARC_SCHEMA)

    return _files(spark, path).mapInArrow(run, "key string, record_type string, payload_bytes long, payload_digest string, refers_to string, target_uri string, date string, payload binary")


WARC_SCHEMA = pa.schema([("key", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload", pa.binary())])


def archive_round_trip(pages: DataFrame, work: str, key: str = "page_id", url: str = "url", payload: str = "html", version: int = 1) -> DataFrame:
    """Write `pages` as ARC files below `work`, convert them to WARC and read these back.

    Null payloads are empty, null URLs `-`; a null key stays null and is never preferred. Repeated rows are equal payloads, of
    which one is the response. An empty table gives no archives and an empty result. Other columns aren't archived.
    """
    spark = pages.sparkSession
    write_arc(pages, f"{work}/arc", key, url, payload, version)
    convert(spark, f"{work}/arc", f"{work}/warc")
    return read_warc(spark, f"{work}/warc")

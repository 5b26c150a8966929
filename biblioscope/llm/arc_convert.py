"""Legacy archive converter: ARC files (versions 1 and 2) to WARC, and back to rows.

Archives are plain files in a folder, gzip-compressed, written and read by Spark's own
text writer and binary reader, so any store that Spark reaches will do.  A file is
closed at the first record past ``ARCHIVE_BYTES``, which bounds what one task holds at a
time; a page is never cut.

*Reading ARC.*  The first record of a file is its version block; its third line names
the fields of the header lines that follow, which differ between version 1 and 2.  A
header line is split from the right (old URLs may hold spaces); its last field is the
declared length of the network document, and only that length tells where it ends.

*Writing WARC.*  Record id (a UUID of archive name and offset), ISO date, type,
payload and block digests (base32 SHA-1) are synthesised.  The smallest id among
records of one payload is the response; the others revisit it and carry no payload.
Which is which follows from a map-side minimum per digest and a join of narrow rows;
decisions go back to each archive as one list, bounded by its records, so payloads
stay with their archive: they are shuffled, compressed, only where the lists are too
large to broadcast, and never by digest.

Defined results: a null page is an empty payload; a null URL is written as ``-`` and
blanks in URLs are percent-encoded; a null page id ranks after all others; of rows
with equal id and payload one is the response and the others revisit it; an empty
table gives empty archives and an empty result; other columns of the input are not
carried, so their names cannot clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioscope.llm.tables import lookup, scratch_path, written

ARCHIVE_BYTES = 8 << 20     # uncompressed
PADDING = "\0"              # gzip readers skip zero bytes after the data
# Fixed values of the two formats.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
EPOCH = datetime(2001, 1, 1, tzinfo=timezone.utc)
SPAN = 10 * 365 * 86_400


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _archive(records: list[bytes]) -> pa.RecordBatch:
    """One row: the records of a file, each with its separator, compressed."""
    return pa.RecordBatch.from_arrays([pa.array([gzip.compress(b"".join(records), 1, mtime=0)], pa.binary())], names=["file"])


def _save(files: DataFrame, path: str) -> None:
    """Each row's bytes as a file of its own."""
    (files.select(F.col("file").cast("string").alias("value")).write
     .option("lineSep", PADDING).option("maxRecordsPerFile", 1).text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))


# --- ARC ----------------------------------------------------------------------

def version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 biblioscope\n{FIELDS[version]}\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    head += ["200", "-", "-", "0", name] if version == 2 else []
    return (" ".join(head) + f" {len(body)}\n").encode() + body


def arc_record(version: int, name: str, url: str, date: str, document: bytes) -> bytes:
    head = [url, "0.0.0.0", date, "text/html"]
    head += ["200", sha1_base32(document), "-", "0", name] if version == 2 else []
    return (" ".join(head) + f" {len(document)}\n").encode() + document


def _http(page_id: int | None, payload: bytes) -> bytes:
    head = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return head + CRLF + payload


def _to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of whole records, a version block first."""
    part, number, size, out = TaskContext.get().partitionId(), 0, 0, []
    version = 1 + part % 2
    for batch in batches:
        ids, urls, pages = (batch.column(i) for i in range(3))
        for i in range(batch.num_rows):
            page_id = ids[i].as_py()
            date = (EPOCH + timedelta(seconds=(page_id or 0) % SPAN)).strftime("%Y%m%d%H%M%S")
            if not out:
                name = f"pages-{part:06d}-{number:06d}.arc"
                out += [version_block(name, version, date), b"\n"]
            url = quote(urls[i].as_py() or "-", safe="%/:=&?~#+!$,;'@()*[]|{}^`<>\\\"")
            out += [arc_record(version, name, url, date, _http(page_id, (pages[i].as_py() or "").encode())), b"\n"]
            size += len(out[-2])
            if size >= ARCHIVE_BYTES:
                yield _archive(out)
                number, size, out = number + 1, 0, []
    if out:
        yield _archive(out)


def write_arc(pages: DataFrame, path: str) -> None:
    """``pages`` (page_id, url, html) as ARC files, version 1 or 2 by task."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _save(rows.mapInArrow(_to_arc, "file binary"), path)


def read_arc(data: bytes) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """(archive, offset, header fields, network document) of each record after the version block."""
    names, archive, at = FIELDS[1].split(" "), "", 0
    while at < len(data):
        eol = data.index(b"\n", at)
        line = data[at:eol].decode("utf-8", "surrogateescape")
        length = int(line.rpartition(" ")[2])
        body = data[eol + 1:eol + 1 + length]
        if line.startswith("filedesc://"):
            block = body.decode().split("\n")
            names, archive = block[1].split(" "), line.split(" ")[0].removeprefix("filedesc://")
        else:
            yield archive, at, dict(zip(names, line.rsplit(" ", len(names) - 1), strict=True)), body
        at = eol + 1 + length
        at += data[at:at + 1] == b"\n"


def split_http(document: bytes) -> tuple[bytes, bytes]:
    """Header block with its empty line, and payload."""
    if not document.startswith(b"HTTP/"):
        return b"", document
    end = document.find(b"\r\n\r\n")
    return (document, b"") if end < 0 else (document[:end + 4], document[end + 4:])


def _page_id(head: bytes) -> int | None:
    m = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return int(m[1]) if m else None


def warc_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def warc_date(date: str) -> str:
    return datetime.strptime(date.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


INDEX = "file string, offset long, page_id long, digest string, record_id string, url string, date string"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in INDEX.split(", ")]
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for archive, offset, fields, document in read_arc(gzip.decompress(content.as_py())):
                head, payload = split_http(document)
                rows.append((file, offset, _page_id(head), sha1_base32(payload), warc_id(archive, offset),
                             fields["URL"], warc_date(fields["Archive-date"])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i != 2 else pa.array(c, pa.int64())
                                                  for i, c in enumerate(zip(*rows, strict=True))], names=names)


# --- WARC ---------------------------------------------------------------------

def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
            f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogateescape") + block


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _archive(list(_convert(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or [])))


def _convert(content: bytes, revisits: list[dict]) -> Iterator[bytes]:
    """One archive: its records as WARC, those listed in ``revisits`` without payload."""
    refers, begun = {r["offset"]: r for r in revisits}, False
    for archive, offset, fields, document in read_arc(gzip.decompress(content)):
        date = warc_date(fields["Archive-date"])
        if not begun:
            begun = True
            info = f"software: biblioscope\r\nisPartOf: {archive}\r\n".encode()
            yield warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", warc_id(archive, -1)), ("WARC-Date", date),
                               ("WARC-Filename", archive), ("Content-Type", "application/warc-fields")], info) + CRLF + CRLF
        head, payload = split_http(document)
        common = [("WARC-Record-ID", warc_id(archive, offset)), ("WARC-Date", date), ("WARC-Target-URI", fields["URL"]),
                  ("WARC-IP-Address", fields["IP-address"]), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
        if head:
            common.append(("Content-Type", "application/http; msgtype=response"))
        else:
            common.append(("Content-Type", fields["Content-type"]))
        if offset in refers:
            first = refers[offset]
            yield warc_record([("WARC-Type", "revisit"), *common, ("WARC-Profile", REVISIT_PROFILE),
                               ("WARC-Refers-To", first["record_id"]), ("WARC-Refers-To-Target-URI", first["url"]),
                               ("WARC-Refers-To-Date", first["date"])], head) + CRLF + CRLF
        else:
            yield warc_record([("WARC-Type", "response" if head else "resource"), *common], document) + CRLF + CRLF


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """All archives of ``arc_path`` as WARC files in ``warc_path``."""
    files = _files(spark, arc_path)
    index = written(files.mapInArrow(_index, INDEX), "index")
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "file", "offset")
    seen = index.groupBy("digest").agg(F.min(F.struct(place.alias("place"), "record_id", "url", "date")).alias("first"),
                                       F.count(F.lit(1)).alias("n")).where("n > 1")
    later = (lookup(index.select("file", "offset", "digest", place.alias("place")), written(seen.select("digest", "first"), "seen"),
                    "digest", F.xxhash64("file", "offset"), how="inner")
             .where(F.col("place") != F.col("first.place"))
             .groupBy("file").agg(F.collect_list(F.struct("offset", "first.record_id", "first.url", "first.date")).alias("revisits")))
    # broadcast by Spark where the written lists are within the session's threshold
    joined = files.join(written(later, "revisits"), "file", "left").select("content", "revisits")
    _save(joined.mapInArrow(_to_warc, "file binary"), warc_path)


RECORD = ("record_type string, record_id string, refers_to_id string, date string, url string, page_id long, "
          "payload_bytes long, payload_digest string")


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; the declared length ends the block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        length = int(fields["Content-Length"])
        yield fields, data[end + 4:end + 4 + length]
        at = end + 4 + length + 4


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in RECORD.split(", "))])
    for batch in batches:
        for content in batch.column(1):
            rows = []
            for fields, block in read_warc(gzip.decompress(content.as_py())):
                kind = fields["WARC-Type"]
                if kind == "warcinfo":
                    continue
                head, payload = split_http(block)
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind != "revisit" and sha1_base32(payload) != digest:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                rows.append((kind, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), fields["WARC-Date"],
                             fields["WARC-Target-URI"], _page_id(head), None if kind == "revisit" else len(payload), digest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                                 schema=schema)


def read_records(spark: SparkSession, warc_path: str) -> DataFrame:
    """One row per record; a revisit has the length and id of the response it refers to."""
    records = written(_files(spark, warc_path).mapInArrow(_records, RECORD), "records")
    full = records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).drop("refers_to_id")
    again = records.where("record_type = 'revisit'").drop("payload_bytes")
    target = (full.select(F.col("record_id").alias("refers_to_id"), "payload_bytes", F.col("page_id").alias("refers_to"))
              .join(again.select("refers_to_id").distinct(), "refers_to_id"))
    again = lookup(again, written(target, "targets"), "refers_to_id", F.xxhash64("record_id")).drop("refers_to_id")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "url"]
    return full.select(columns).unionByName(again.select(columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` to ARC, ARC to WARC, WARC to rows."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_records(spark, warc)


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, {5 * g + 1}, 5))::int >> {shift}) % 32 + 1, 1)"
    for g in range(8) for shift in (15, 10, 5, 0))

ORACLE = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as hex,
             min(page_id) over (partition by html) as first_id from p)
select page_id, payload_bytes, {_BASE32} as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from d
"""

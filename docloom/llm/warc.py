"""Web archives: a converter from legacy ARC to WARC, with writers and readers of both.

Pages are written as ARC files (version 1 or 2), these are parsed by the header line that their
version block declares and by the lengths in it, and equivalent WARC records are made: the
identifier from the page id and the record's digest, the date from the 14 digits, the type from
the content (response where it is an HTTP message, else resource), block and payload digests.
Of records with equal payloads of at least REVISIT bytes that of the largest id is the response,
the others become revisit records that refer to it and carry the HTTP head only.

Files are written and read by Spark's own sources (text lines, whole binary files), so any store
that Spark reaches will do. A file starts anew after RECORDS records or FILE_BYTES bytes, which bounds
what a task holds of one file to that and one record.

Defined cases: a null page is an empty payload; a null url is `urn:page:<id>`; white space in a
url is percent-encoded; of repeated rows of the largest id the last written one is the response;
an empty table gives no files and an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_batches, scratch, written

#: Payloads that are shorter are never revisits.
REVISIT = 1000
RECORDS = 1000
FILE_BYTES = 8 << 20
ZERO_IP, DATE = "0.0.0.0", "20240101000000"  # noqa: S104
# The field lines of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_SPACE = uuid.UUID("8a4f7f0e-1f0a-5c55-9a6b-0d6c3c5b2f11")


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 docloom\n{FIELDS[version]}\n".encode()
    tail = f"{len(body)}" if version == 1 else f"200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} {ZERO_IP} {DATE} text/plain {tail}\n".encode() + body


def arc_record(version: int, url: str, content: bytes, name: str, kind: str = "text/html", date: str = DATE) -> bytes:
    if version == 1:
        tail = f"{len(content)}"
    else:
        tail = f"200 {hashlib.md5(content, usedforsecurity=False).hexdigest()} - 0 {name} {len(content)}"
    return f"{url} {ZERO_IP} {date} {kind} {tail}\n".encode() + content


def http_message(page_id: int | None, body: bytes, head_only: bool = False) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + (b"" if head_only else body)


def parse_head(block: bytes) -> tuple[dict[str, str], int]:
    """Fields of the head at the start of block (names in lower case) and where its body starts."""
    end = block.find(b"\r\n\r\n")
    lines = block[: end if end >= 0 else len(block)].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, end + 4 if end >= 0 else len(block)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one or more ARC files one after the other: the fields that the version block
    names, and `content`, `at` (place in data). A header line has one value for each field; in
    version 1 a content type may hold spaces, so values are counted from both ends."""
    at, names = 0, FIELDS[1].split(" ")
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace")
        values = line.split(" ")
        length = int(values[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ValueError(f"record at {at} is cut off")
        if line.startswith("filedesc://"):
            first, _, rest = content.partition(b"\n")
            version = int(first.split(b" ")[0])
            named = rest.partition(b"\n")[0].decode("utf-8", "replace").strip()
            names = (named or FIELDS[version]).split(" ")
        else:
            extra = len(values) - len(names)
            if extra > 0:
                values[3 : 4 + extra] = [" ".join(values[3 : 4 + extra])]
            yield dict(zip((n.lower() for n in names), values, strict=False)) | {"content": content, "at": at}
        at = end + 1 + length


def from_arc(record: dict) -> dict:
    """What a WARC record needs: url, date, type, head, payload, page_id and the digests."""
    content, d = record["content"], record["archive-date"]
    http = content.startswith(b"HTTP/")
    fields, start = parse_head(content) if http else ({}, 0)
    page = fields.get("x-page-id")
    return {
        "url": record["url"], "ip": record["ip-address"],
        "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "type": "response" if http else "resource",
        "page_id": int(page) if page is not None else None,
        "payload": content[start:], "digest": hashlib.sha1(content[start:], usedforsecurity=False).hexdigest(), "at": record["at"],
    }


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest}')}>"


def _digest_field(hexdigest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexdigest)).decode()


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    own = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", _digest_field(hashlib.sha1(block, usedforsecurity=False).hexdigest())), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own).encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_from(row: dict) -> bytes:
    """A WARC record of a converted ARC record; refers_to set makes it a revisit."""
    revisit, payload = row["refers_to"] is not None, row["payload"]
    fields = [
        ("WARC-Record-ID", record_id(row["page_id"], row["digest"])), ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["url"]), ("WARC-IP-Address", row["ip"]), ("WARC-Payload-Digest", _digest_field(row["digest"])),
    ]
    if row["type"] != "response" and not revisit:
        return warc_record(row["type"], [*fields, ("Content-Type", "application/octet-stream")], payload)
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(row["refers_to"], row["digest"])), ("X-Refers-To-Page-Id", str(row["refers_to"])),
        ]
    block = http_message(row["page_id"], payload, head_only=revisit)
    return warc_record("revisit" if revisit else "response", [*fields, ("Content-Type", "application/http; msgtype=response")], block)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, by the declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at) + 4
        fields, _ = parse_head(data[at:end])
        n = int(fields["content-length"])
        yield fields, data[end : end + n]
        at = end + n


def unzipped(data: bytes) -> bytes:
    """data, or what its gzip members hold."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def _save(lines: DataFrame, path: str) -> None:
    """Writes each row's binary `value` and a line end as a file of its own."""
    (lines.select(F.col("value").cast("string").alias("value")).write
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path))


def _whole_files(records: Iterator[bytes], start: Callable[[int], bytes], between: bytes) -> Iterator[pa.RecordBatch]:
    """Contents of files, one a batch: what start gives for the file's number, and records until
    the file has RECORDS of them or FILE_BYTES bytes."""
    file, held, size = 0, [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([between.join([start(file), *held])], pa.binary())], ["value"])

    for record in records:
        held.append(record)
        size += len(record)
        if len(held) >= RECORDS or size >= FILE_BYTES:
            yield made()
            file, held, size = file + 1, [], 0
    if held:
        yield made()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, version: int = 1, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Writes pages as gzipped ARC files under path."""
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), pages[body_col].cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, body in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "body")), strict=True):
                    safe = quote(url, safe="%:/?#[]@!$&'()*+,;=-._~") if url else f"urn:page:{page}"
                    yield arc_record(version, safe, http_message(page, body or b""), "00000.arc")

        return _whole_files(records(), lambda i: arc_version_block(version, f"{i:05d}.arc"), b"\n")

    _save(map_batches(rows, run, "value binary"), path)


#: Winners of equal payloads, and revisits, that are broadcast at most.
BROADCAST_ROWS = 100_000


def read_arc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """Converted records of the ARC files under path: page_id, digest, bytes, file, at, and with
    bodies url, ip, date, type, payload."""
    more = {"url": pa.string(), "ip": pa.string(), "date": pa.string(), "type": pa.string(), "payload": pa.binary()} if bodies else {}
    types = {"page_id": pa.int64(), "digest": pa.string(), "bytes": pa.int64(), "file": pa.string(), "at": pa.int64()} | more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, data = batch.column("path")[i].as_py(), unzipped(batch.column("content")[i].as_py())
                rows = []
                for r in map(from_arc, parse_arc(data)):
                    rows.append(r | {"bytes": len(r["payload"]), "file": file})
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in types.items()], names=list(types))
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in types.items()], names=list(types))

    schema = "page_id long, digest string, bytes long, file string, at long" + ", url string, ip string, date string, type string, payload binary" * bodies
    return map_batches(_files(spark, path), run, schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Writes the WARC files of the ARC files under arc_path. Winners of equal payloads are
    found on ids and digests alone, summed in the map; so is which record revisits which. Payloads are joined by file and place, a key that
    one record has, so that a payload of many copies makes no large task."""
    keys = written(read_arc(spark, arc_path, bodies=False), "arc-keys").where(F.col("bytes") >= REVISIT)
    winners = written(
        keys.groupBy("digest").agg(F.max(F.struct("page_id", "file", "at")).alias("w"), F.count("*").alias("c"))
        .where("c > 1").select(F.col("digest").alias("d"), "w"),
        "winners",
    )
    few = winners.count() <= BROADCAST_ROWS
    copies = keys.join(F.broadcast(winners) if few else winners.hint("merge"), F.col("digest") == F.col("d"))
    revisits = copies.where((F.col("w.file") != F.col("file")) | (F.col("w.at") != F.col("at")))
    revisits = written(revisits.select(F.col("file").alias("f"), F.col("at").alias("a"), F.col("w.page_id").alias("refers_to")), "revisits")
    records = read_arc(spark, arc_path)
    some = revisits.count() <= BROADCAST_ROWS
    joined = records.join(F.broadcast(revisits) if some else revisits.hint("merge"), (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")), "left").select(
        *(c for c in records.columns if c not in ("file", "at", "bytes")), "refers_to",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def info(file: int) -> bytes:
            note = b"software: docloom\r\nformat: WARC File Format 1.1\r\n"
            return warc_record("warcinfo", [("WARC-Record-ID", record_id(file, "warcinfo")), ("WARC-Date", f"{DATE[:4]}-{DATE[4:6]}-{DATE[6:8]}T00:00:00Z"), ("Content-Type", "application/warc-fields")], note)

        records = (warc_from(row) for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        return _whole_files(records, info, b"")

    _save(map_batches(joined, run, "value binary"), warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, url, date, payload_bytes, payload_digest, refers_to, payload (null
    for revisits) of the records of pages under path."""
    types = {
        "page_id": pa.int64(), "record_type": pa.string(), "url": pa.string(), "date": pa.string(), "payload_bytes": pa.int64(),
        "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(),
    }

    def row(fields: dict, block: bytes) -> dict:
        kind = fields["warc-type"]
        head, start = parse_head(block) if kind != "resource" else ({}, 0)
        page, refers, payload = head.get("x-page-id"), fields.get("x-refers-to-page-id"), block[start:]
        told = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        if kind != "revisit" and hashlib.sha1(payload, usedforsecurity=False).hexdigest() != told:
            raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
        return {
            "page_id": int(page) if page else None, "record_type": kind, "url": fields["warc-target-uri"], "date": fields["warc-date"],
            "payload_bytes": int(head["content-length"]) if kind == "revisit" else len(payload), "payload_digest": told,
            "refers_to": int(refers) if refers else None, "payload": None if kind == "revisit" else payload,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for fields, block in parse_warc(unzipped(batch.column("content")[i].as_py())):
                    if fields["warc-type"] != "warcinfo":
                        rows.append(row(fields, block))
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in types.items()], names=list(types))
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in types.items()], names=list(types))

    schema = "page_id long, record_type string, url string, date string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return map_batches(_files(spark, path), run, schema)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", version: int = 1) -> DataFrame:
    """pages to ARC, ARC to WARC, and the WARC read back."""
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, arc, version, id_col, url_col, body_col)
    convert(spark, arc, warc)
    return read_warc(spark, warc)

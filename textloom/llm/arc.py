"""Legacy archive converter: ARC records to WARC.

An ARC file begins with a ``filedesc:`` record whose body names the version and the fields of the header lines: five in
version 1, ten in version 2. A header line is split from the right, since a URL may hold blanks, and declares the length of
what follows. For each record an equivalent WARC/1.1 record is made: the type by what the record is, a UUID from archive,
record number, URL, date and digest, the date from the 14 digits, SHA-256 digests of block and payload.

``parse_archive`` reads whole archive files (plain or gzip, ``read_archives``); ``convert`` takes one record a row.

Defined results: a null or empty page is a record with an HTTP header alone; a null URL is ``unknown:``; blanks in a URL
are written as %20; a declared length beyond the data gives ``WARC-Truncated: length`` and the bytes that are there; less
than the data, the rest is left out (in a file the next header is sought after it); a line that is no header is skipped
up to the next that is, and a row without a header gives no record but a row of ``unread``; dates that are short, or no date
of the calendar, keep what is valid before that and are padded with the least valid ones; a null ``page_id`` stays null as ``id``
and counts as record 0; repeated rows are records each; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import calendar
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "file", "length"),
}
WARC = (
    "id long, archive string, number long, version int, warc_type string, record_id string, target_uri string, warc_date string, ip string, "
    "content_type string, content_length long, block_digest string, payload_digest string, payload_type string, truncated boolean, record binary"
)
#: Pages of one archive when ``pages`` are written as ARC records.
ARCHIVE_PAGES = 256
_NUMBER = re.compile(rb"\d+")
_DATE = re.compile(r"\d{4,14}")


class Header(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    length: int


def parse_header(line: bytes, version: int) -> Header | None:
    """The header, or None if the line is none of this version."""
    names = FIELDS[version]
    parts = line.strip(b"\r\n").rsplit(b" ", len(names) - 1)
    if len(parts) != len(names) or not parts[0] or not _NUMBER.fullmatch(parts[-1]):
        return None
    own = dict(zip(names, (p.decode("utf-8", "replace") for p in parts)))
    if not _DATE.fullmatch(own["date"]):
        return None
    return Header(own["url"], own["ip"], own["date"], own["mime"], int(own["length"]))


def version_of(block: bytes) -> int:
    """The version that a ``filedesc:`` block names: its first number, or the number of its fields."""
    lines = block.split(b"\n")
    first = lines[0].split(b" ")[0].strip()
    if first in (b"1", b"2"):
        return int(first)
    return 2 if len(lines) > 1 and len(lines[1].split()) == len(FIELDS[2]) else 1


def warc_date(digits: str) -> str:
    """The date of up to 14 digits; from the first part on that is missing or isn't in the calendar, the least valid ones."""
    year = max(int(digits[:4]), 1)
    parts, least, most = [], (1, 1, 0, 0, 0), [12, 31, 23, 59, 59]
    for at, low in enumerate(least):
        given = digits[4 + 2 * at : 6 + 2 * at]
        if len(given) < 2 or not low <= int(given) <= most[at]:
            break
        parts.append(int(given))
        if at == 0:
            most[1] = calendar.monthrange(year, parts[0])[1]
    month, day, hour, minute, second = (*parts, *least[len(parts) :])
    return f"{year:04}-{month:02}-{day:02}T{hour:02}:{minute:02}:{second:02}Z"


def _kind(header: Header, block: bytes) -> tuple[str, str]:
    if header.url.startswith("filedesc:"):
        return "warcinfo", "application/warc-fields"
    if header.url.startswith("dns:"):
        return "response", "text/dns"
    if block.startswith(b"HTTP/"):
        return "response", "application/http; msgtype=response"
    return "resource", header.mime or "application/octet-stream"


def to_warc(archive: str, number: int, header: Header, block: bytes) -> dict:
    """The WARC record as a row of WARC without ``id`` and ``version``."""
    truncated = len(block) < header.length
    kind, content_type = _kind(header, block)
    if kind == "warcinfo":
        block = f"software: textloom\r\nformat: WARC File Format 1.1\r\ndescription: {header.url}\r\n".encode()
    payload, payload_type = block, header.mime
    if content_type.startswith("application/http"):
        end = block.find(b"\r\n\r\n")
        skip = 4 if end >= 0 else 2
        end = end if end >= 0 else block.find(b"\n\n")
        payload = block[end + skip :] if end >= 0 else b""
    digest, payload_digest, date = hashlib.sha256(block).hexdigest(), hashlib.sha256(payload).hexdigest(), warc_date(header.date)
    h = hashlib.sha256(f"{archive}\n{number}\n{header.url}\n{date}\n{digest}".encode()).hexdigest()
    record_id = f"urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Filename: {archive}"] if kind == "warcinfo" else [f"WARC-Target-URI: {header.url}", f"WARC-IP-Address: {header.ip}", f"WARC-Payload-Digest: sha256:{payload_digest}", f"WARC-Identified-Payload-Type: {header.mime}"]
    lines += ["WARC-Truncated: length"] if truncated else []
    lines += [f"WARC-Block-Digest: sha256:{digest}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return {
        "archive": archive, "number": number, "warc_type": kind, "record_id": record_id, "target_uri": header.url, "warc_date": date, "ip": header.ip, "content_type": content_type,
        "content_length": len(block), "block_digest": f"sha256:{digest}", "payload_digest": f"sha256:{payload_digest}", "payload_type": payload_type, "truncated": truncated, "record": record,
    }


def parse_archive(data: bytes) -> Iterator[tuple[int, Header, bytes]]:
    """Version, header and block of each record of an archive file."""
    if data[:2] == b"\x1f\x8b":  # gzip members one after another
        parts = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(parts)
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end]
        header = None
        if line.startswith(b"filedesc:"):
            two = parse_header(line, 2)
            one = parse_header(line, 1)
            for header in (two, one):
                if header and (header is one or version_of(data[end + 1 : end + 1 + header.length]) == 2):
                    break
            version = version_of(data[end + 1 : end + 1 + header.length]) if header else version
        elif line.strip():
            header = parse_header(line, version)
        if header is None:
            at = end + 1
            continue
        yield version, header, data[end + 1 : end + 1 + header.length]
        at = end + 1 + header.length


def convert(records: DataFrame) -> DataFrame:
    """``records``: id, archive, number, version, member (a header line and what follows it). A row in WARC for each."""

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in WARC.split(", ")}
            held = 0
            for i, archive, number, version, member in zip(*(batch.column(c).to_pylist() for c in ("id", "archive", "number", "version", "member"))):
                line, _, rest = member.partition(b"\n")
                header = parse_header(line, version)
                if header is None:
                    continue
                row = to_warc(archive, number, header, rest[: header.length]) | {"id": i, "version": version}
                for k, v in out.items():
                    v.append(row[k])
                held += len(rest)
                if held > 1 << 24:
                    yield _batch(out)
                    out, held = {k: [] for k in out}, 0
            yield _batch(out)

    return records.select("id", "archive", "number", "version", "member").mapInArrow(converted, WARC)


def unread(records: DataFrame) -> DataFrame:
    """``id, archive, number, version, line``: the rows that ``convert`` makes no record of, as their first line is no header."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [m.partition(b"\n")[0] for m in batch.column("member").to_pylist()]
            bad = pa.array([parse_header(line, v) is None for line, v in zip(lines, batch.column("version").to_pylist())], pa.bool_())
            own = [batch.column(c) for c in ("id", "archive", "number", "version")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())], ["id", "archive", "number", "version", "line"]).filter(bad)

    return records.select("id", "archive", "number", "version", "member").mapInArrow(kept, "id long, archive string, number long, version int, line string")


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = dict(c.split() for c in WARC.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(v, _ARROW[kinds[k]]) for k, v in columns.items()], list(columns))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files under ``path`` as WARC rows; ``id`` is null, ``number`` counts from 0 in each file.

    A file is read by one task, as its records can be found only one after another."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                out: dict[str, list] = {c.split()[0]: [] for c in WARC.split(", ")}
                held = 0
                for number, (version, header, block) in enumerate(parse_archive(data)):
                    row = to_warc(name.rpartition("/")[2], number, header, block) | {"id": None, "version": version}
                    for k, v in out.items():
                        v.append(row[k])
                    held += len(block)
                    if held > 1 << 24:
                        yield _batch(out)
                        out, held = {k: [] for k in out}, 0
                yield _batch(out)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(parsed, WARC)


def page_records(pages: DataFrame) -> DataFrame:
    """Web pages as ARC records, for ``convert``: version 1 in archives of even number, version 2 in the others."""
    number = F.coalesce("page_id", F.lit(0))
    archive_number = F.expr(f"coalesce(page_id, 0) div {ARCHIVE_PAGES}")
    url = F.regexp_replace(F.coalesce(F.nullif("url", F.lit("")), F.lit("unknown:")), r"[ \t\r\n\x0B\f]", "%20")
    body = F.coalesce("html", F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    archive: Column = F.concat(F.lit("crawl-"), F.lpad(F.col("a").cast("string"), 8, "0"), F.lit(".arc"))
    date = F.date_format(F.timestamp_seconds(F.lit(978307200) + F.pmod("number", F.lit(100_000_000))), "yyyyMMddHHmmss")
    rows = pages.select(F.col("page_id").alias("id"), number.alias("number"), archive_number.alias("a"), url.alias("url"), block.alias("block"))
    rows = rows.select("id", "number", "url", "block", archive.alias("archive"), (F.col("a") % 2 + 1).cast("int").alias("version"), date.alias("date"), F.octet_length("block").cast("string").alias("length"))
    first = F.concat_ws(" ", "url", F.lit("192.0.2.1"), "date", F.lit("text/html"))
    line = F.when(F.col("version") == 1, F.concat_ws(" ", first, "length")).otherwise(F.concat_ws(" ", first, F.lit("200 - - 0"), "archive", "length"))
    return rows.select("id", "archive", "number", "version", F.encode(F.concat(line, F.lit("\n"), "block"), "UTF-8").alias("member"))

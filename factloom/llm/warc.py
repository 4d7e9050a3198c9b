"""Legacy ARC archives, and their conversion to WARC.

An ARC file begins with a version block; its record definition names the fields of every header line
that follows, five in version 1 and ten in version 2, of which the last is the length of the record.  A
WARC record has named header lines and a length among them.  Both are cut by declared lengths, so a
payload may hold anything, header lines of either format included.

Archives are gzip files of lines, written and read by Spark's own text source, so they may lie in any
store that Spark reaches.  A compressed file is not split: a task streams its lines in order and holds
one record at a time.  Files are as large as the tasks that wrote them.

The converter gives each record an identifier (from its file and offset), a date, a type (``response``
for HTTP, ``resource`` for other blocks, ``warcinfo`` for version blocks) and digests of block and
payload.  Of records with equal payloads (by SHA-256) the one of the smallest id is kept whole, the
others become ``revisit`` records that carry their HTTP header only.  Only the groups with more than one
record are a table that is joined to the records; it is staged, so its size is known to the planner,
which broadcasts it if small and else joins by shuffle and splits groups that are too large.

Null payloads are empty.  Null ids come last: a null id keeps the payload only if no other id has it.
Rows of one id and payload are ordered by identifier, so one of them is the response.  Null urls are
``-`` in ARC, as unknown values are there.  What cannot be read is a row with a ``fault``: ``header``
for lines that are no header, ``truncated`` for a record cut short, ``length`` for one that does not end
where it says, ``digest`` for a payload that differs from its digest.  Other columns are left out,
whatever their names.  No rows give archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import own, ship, tidy
from factloom.llm.fill_middle import batched
from factloom.session import discard, discard_path, shared_path, stage

# The record definitions of both versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = "X-Page-Id"
FIRST_DATE = "19960101000000"


def digest(data: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines of archives in order, each with two numbers that stand for its file."""
    ship(spark)
    file = F.col("_metadata.file_path")
    return spark.read.text(path, lineSep="\n").select(
        F.xxhash64(file).alias("file"), F.xxhash64(file, F.lit("archive")).alias("file_too"), F.col("value").cast("binary").alias("line")
    )


def write_lines(df: DataFrame, path: str) -> None:
    """Records as gzip files, compressed at the level that takes least time."""
    lines = df.select(F.col("value").cast("string").alias("value"))
    lines.write.option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip", lineSep="\n")


def by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in ("file", "file_too", "line")))

    for key, found in groupby(rows(), lambda r: r[:2]):
        yield f"{key[0]}:{key[1]}", (r[2] for r in found)


def take(lines: Iterator[bytes], length: int) -> tuple[bytes, int, str | None]:
    """The next ``length`` bytes, the bytes of the lines they stand in, and a fault."""
    parts, have = [], 0
    while have < length:
        line = next(lines, None)
        if line is None:
            return b"\n".join(parts), have, "truncated"
        parts.append(line)
        have += len(line) + 1
    body = b"\n".join([*parts, b""])
    return body[:length], have, "length" if body[length:].strip() else None


# --- ARC ---------------------------------------------------------------------------------------------


def write_arc(
    df: DataFrame, path: str, version: int = 1, date: str = FIRST_DATE, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> None:
    """Pages as legacy archives of one version, one file per task."""
    fields = ARC_FIELDS[version]

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at = f"v{version}-{TaskContext.get().partitionId():05d}.arc", 0

        def record(target: str, mime: str, body: bytes) -> bytes:
            values = {
                "URL": target, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime, "Result-code": "200", "Checksum": "-",
                "Location": "-", "Offset": str(at), "Filename": name, "Archive-length": str(len(body)),
            }
            return " ".join(values[f] for f in fields.split()).encode() + b"\n" + body

        def made() -> Iterator[tuple]:
            nonlocal at
            whole = record(f"filedesc://{name}", "text/plain", f"{version} 0 factloom\n{fields}\n\n".encode())
            yield (whole,)
            at += len(whole) + 1
            for batch in batches:
                for key, target, page in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html"))):
                    payload = (page or "").encode()
                    named = "" if key is None else f"{ID_HEADER}: {quote(str(key))}\r\n"
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n"
                    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", target or "-")
                    whole = record(safe, "text/html", http.encode() + payload)
                    yield (whole,)
                    at += len(whole) + 1

        yield from batched(made(), pa.schema([("value", pa.binary())]))

    write_lines(own(df, page_id=page_id, url=url, html=html).mapInArrow(tidy(archive), "value binary"), path)


def arc_header(line: bytes, fields: list[str]) -> dict[str, str] | None:
    """Fields of a header line by name.  Urls of old archives may hold spaces, so it is split from its end."""
    values = line.rstrip(b"\r").decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
    if len(values) != len(fields) or not values[-1].isdigit():
        return None
    found = dict(zip(fields, values))
    return found if re.fullmatch(r"\d{4,17}", found.get("Archive-date", "")) else None


def arc_records(lines: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """Offset, header fields, block and fault of each record of a file."""
    fields, at = ARC_FIELDS[1].split(), 0
    for line in lines:
        start, at = at, at + len(line) + 1
        if not line.strip():
            continue
        if line.startswith(b"filedesc://"):  # the fields are those of its version, which its block names
            length = line.rsplit(b" ", 1)[-1].strip()
            body, have, fault = take(lines, int(length)) if length.isdigit() else (b"", 0, "header")
            at += have
            said = body.decode("utf-8", "replace").split("\n")
            named = said[1].split() if len(said) > 1 else []
            if named[-1:] == ["Archive-length"]:
                fields = named
            elif (version := int(said[0].split(" ")[0] or 0) if said[0].split(" ")[0].isdigit() else 0) in ARC_FIELDS:
                fields = ARC_FIELDS[version].split()
            date = next((x for x in line.decode("utf-8", "replace").split(" ") if re.fullmatch(r"\d{14}", x)), FIRST_DATE)
            yield start, {"URL": line.split(b" ")[0].decode("utf-8", "replace"), "Archive-date": date, "Content-type": "text/plain"}, body, fault
            continue
        head = arc_header(line, fields)
        if head is None:
            yield start, {}, line, "header"
            continue
        body, have, fault = take(lines, int(head["Archive-length"]))
        at += have
        yield start, head, body, fault


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header with its empty line, and payload, of an HTTP message."""
    ends = [at + len(gap) for gap in (b"\r\n\r\n", b"\n\n") if (at := block.find(gap)) >= 0]
    at = min(ends, default=len(block))
    return block[:at], block[at:]


def header_value(http: bytes, name: str) -> str | None:
    found = re.search(rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*)", http.decode("utf-8", "replace"))
    return unquote(found[1]) if found else None


def warc_date(digits: str) -> str:
    """ISO date of 4 to 17 digits of an archive date; dates that do not exist are those of the first archives."""
    whole = (digits + FIRST_DATE[len(digits) : 14])[:14]
    try:
        return datetime.strptime(whole, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return warc_date(FIRST_DATE)


def record_id(*parts: object) -> str:
    name = hashlib.sha256("\n".join(map(str, parts)).encode()).digest()[:16]
    return f"urn:uuid:{uuid.UUID(bytes=name, version=5)}"


ARC_ROW = (
    "record_id string, warc_type string, url string, ip string, date string, content_type string, page_id string,"
    " payload_bytes long, payload_digest string, payload_key string, block_digest string, fault string, http binary, payload binary"
)


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of legacy archives with what a WARC record of them needs; see ``ARC_ROW``.

    Without ``payloads`` the bytes stay behind; their digests do not.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for file, lines in by_file(batches):
                for at, head, block, fault in arc_records(lines):
                    url, mime = head.get("URL"), head.get("Content-type")
                    if url and url.startswith("filedesc://"):
                        kind, content, http, payload = "warcinfo", mime, b"", block
                    elif block.startswith(b"HTTP/"):
                        kind, content = "response", "application/http; msgtype=response"
                        http, payload = split_http(block)
                    else:
                        kind, content, http, payload = "resource", mime, b"", block
                    yield (
                        record_id(file, at), kind if head else None, None if url == "-" else url, head.get("IP-address"),
                        warc_date(head.get("Archive-date", "")), content, header_value(http, ID_HEADER), len(payload), digest(payload),
                        hashlib.sha256(payload).hexdigest(), digest(block), fault, http, payload if payloads else None,
                    )

        yield from batched(made(), arrow_schema(ARC_ROW))

    return lines_of(spark, path).mapInArrow(tidy(read), ARC_ROW)


def arrow_schema(row: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in row.split(","))])


# --- WARC --------------------------------------------------------------------------------------------


def warc_record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A record without its last line end, which the writer of lines adds."""
    named = {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in named.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r"


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0, id_type: str = "bigint") -> None:
    """Legacy archives as WARC files; payloads of ``least_bytes`` or more are kept once.

    ``id_type`` is the type by which ids (of the HTTP header ``X-Page-Id``) are ordered.
    """
    key = F.col("page_id").try_cast(id_type)
    known = read_arc(spark, arc_path, payloads=False).where("warc_type in ('response', 'resource') and fault is null")
    first = F.min(F.struct(key.isNull().alias("no_id"), key.alias("id"), "record_id", "url", "date"))
    copies = stage(
        known.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_key")
        .agg(first.alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("payload_key", "first.record_id", "first.url", "first.date")
        .toDF("payload_key", "first_id", "first_url", "first_date"),
        "archive-copies",
    )
    usable = F.col("warc_type").isin("response", "resource") & F.col("fault").isNull()
    keyed = read_arc(spark, arc_path).withColumn("payload_key", F.when(usable, F.col("payload_key")))
    joined = keyed.join(copies, "payload_key", "left").drop("payload_key")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            started = False
            for batch in batches:
                for r in batch.to_pylist():
                    if not started:
                        started = True
                        said = b"software: factloom\r\nformat: WARC File Format 1.1\r\n"
                        yield (warc_record("warcinfo", {"WARC-Record-ID": f"<{record_id(r['record_id'], 'file')}>", "WARC-Date": r["date"], "Content-Type": "application/warc-fields"}, said),)
                    yield (converted(r),)

        yield from batched(made(), pa.schema([("value", pa.binary())]))

    write_lines(joined.mapInArrow(tidy(write), "value binary"), warc_path)
    discard(copies)


def converted(r: dict) -> bytes:
    """The WARC record of one row of a legacy archive; what had a fault is kept as metadata."""
    fields = {
        "WARC-Record-ID": f"<{r['record_id']}>", "WARC-Date": r["date"], "WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"],
        "WARC-Payload-Digest": f"sha1:{r['payload_digest']}",
    }
    block = (r["http"] or b"") + (r["payload"] or b"")
    if r["fault"]:
        return warc_record("metadata", fields | {"Content-Type": "application/octet-stream", "X-Fault": r["fault"]}, block)
    if r["first_id"] and r["first_id"] != r["record_id"]:
        fields |= {
            "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{r['first_id']}>", "WARC-Refers-To-Target-URI": r["first_url"],
            "WARC-Refers-To-Date": r["first_date"], "WARC-Truncated": "length", "Content-Type": r["content_type"],
        }
        return warc_record("revisit", fields | {"WARC-Block-Digest": f"sha1:{digest(r['http'] or b'')}"}, r["http"] or b"")
    return warc_record(r["warc_type"], fields | {"WARC-Block-Digest": f"sha1:{r['block_digest']}", "Content-Type": r["content_type"]}, block)


def warc_records(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields by lower-case name, block and fault of each record of a file."""
    for line in lines:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            yield {}, line, "header"
            continue
        head, last = {}, None
        for named in lines:
            named = named.rstrip(b"\r").decode("utf-8", "replace")
            if not named:
                break
            if named[0] in " \t" and last:  # a value goes on
                head[last] += " " + named.strip()
            else:
                last, _, value = named.partition(":")
                last = last.strip().lower()
                head[last] = value.strip()
        length = head.get("content-length", "")
        if not length.isdigit():
            yield head, b"", "header"
            continue
        block, _, fault = take(lines, int(length))
        yield head, block, fault


WARC_ROW = (
    "record_id string, warc_type string, url string, date string, refers_to string, page_id string,"
    " payload_bytes long, payload_digest string, fault string, payload binary"
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of WARC files; see ``WARC_ROW``.  Sizes and digests are taken from the bytes; a revisit has the digest it names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for _, lines in by_file(batches):
                for head, block, fault in warc_records(lines):
                    kind, named = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    http, payload = split_http(block) if "application/http" in head.get("content-type", "") else (b"", block)
                    found, size = digest(payload), len(payload)
                    if kind == "revisit":
                        found, size, payload = named, None, None
                    elif named and named != found:
                        fault = fault or "digest"
                    ids = [head.get(x, "").strip("<>") or None for x in ("warc-record-id", "warc-refers-to")]
                    yield (
                        ids[0], kind, head.get("warc-target-uri"), head.get("warc-date"), ids[1], header_value(http, ID_HEADER), size, found,
                        fault or head.get("x-fault"), payload if payloads else None,
                    )

        yield from batched(made(), arrow_schema(WARC_ROW))

    return lines_of(spark, path).mapInArrow(tidy(read), WARC_ROW)


def resolved(records: DataFrame) -> DataFrame:
    """Responses and revisits, the latter with size and page of the record that they refer to.

    ``records`` is read twice; the join's sides are plain scans, so a record with very many revisits is split.
    """
    pages = records.where("warc_type in ('response', 'revisit') and fault is null")
    whole = pages.where("warc_type = 'response'")
    to = whole.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_page"), F.col("payload_bytes").alias("whole_bytes"))
    again = pages.where("warc_type = 'revisit'").join(to, "refers_to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "warc_type", "refers_page"]
    return whole.withColumn("refers_page", F.lit(None).cast("string")).select(*columns).unionByName(
        again.withColumn("payload_bytes", F.col("whole_bytes")).select(*columns)
    )


def archived(df: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages through legacy archives of both versions and WARC files: what the latter hold, per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    spark = df.sparkSession
    kind = df.schema[page_id].dataType.simpleString()
    arc, warc = shared_path(spark, "archives-arc"), shared_path(spark, "archives-warc")
    even = F.pmod(F.xxhash64(F.col(f"`{page_id}`"), F.col(f"`{url}`")), F.lit(2)) == 0
    write_arc(df.where(even), f"{arc}/v1", 1, page_id=page_id, url=url, html=html)
    write_arc(df.where(~even), f"{arc}/v2", 2, page_id=page_id, url=url, html=html)
    convert(spark, f"{arc}/*", warc, least_bytes, kind)
    discard_path(spark, arc)
    records = stage(read_warc(spark, warc, payloads=False).drop("payload"), "archive-records")
    discard_path(spark, warc)
    return resolved(records).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("warc_type").alias("record_type"), F.col("refers_page").cast(kind).alias("refers_to"),
    )

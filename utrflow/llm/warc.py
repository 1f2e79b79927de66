"""Legacy ARC archives as WARC.

An ARC file starts with a version block (its record is named filedesc://) that says the version and the names of the fields
in record header lines; each record is such a line, whose last field is the declared length, and so many bytes. The
converter turns records into WARC ones: identifiers (derived from the content, so that a repeated run gives the same),
ISO timestamps, types and SHA-256 digests. Records with equal payloads become revisits of the first.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.llm.exact_dedup import marked
from utrflow.llm.segments import small_batches
from utrflow.plans.storage import new_path

#: Fixed values of the formats: the fields of header lines by ARC version; the least payload that is worth a revisit.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 100
ID_HEADER = "X-Page-Id"
#: A row of the writer ends with the record that brings it to so many bytes; so many rows make a file.
ROW_BYTES, FILE_ROWS = 1 << 20, 8
#: What the writer puts after each row: a gzip member that holds nothing.
NOTHING = gzip.compress(b"", 1, mtime=0)


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    block: bytes


def arc_file(records: list[tuple[str, str, str, bytes]], version: int = 1, name: str = "pages.arc", date: str = "20200101000000") -> bytes:
    """An ARC file of (url, date, content type, block) records."""
    names = FIELDS[version]
    text = f"{version} 0 utrflow\n{' '.join(names)}\n".encode()
    out = bytearray()

    def add(url: str, when: str, kind: str, block: bytes) -> None:
        known = {"URL": re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url) or "-", "IP-address": "0.0.0.0", "Archive-date": when, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(len(out)), "Filename": name, "Archive-length": str(len(block))}
        out.extend(" ".join(known[n] for n in names).encode() + b"\n" + block + b"\n")

    add(f"filedesc://{name}", date, "text/plain", text)
    for record in records:
        add(*record)
    return bytes(out)


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block first. Raises ValueError at a header line that its version doesn't allow."""
    at, names = 0, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1  # the separator; some writers put several
            continue
        end = data.find(b"\n", at)
        line = data[at:end].decode(errors="surrogateescape").rstrip("\r")
        first = line.startswith("filedesc://") and data[end + 1 : end + 6] != b"HTTP/"  # a page may have such a URL, too
        values = line.split(" ")
        if first:
            names = FIELDS[2] if len(values) == len(FIELDS[2]) else FIELDS[1]
        if len(values) > len(names):  # content types of old crawlers may hold spaces
            spare, k = len(values) - len(names), names.index("Content-type")
            values[k : k + spare + 1] = [" ".join(values[k : k + spare + 1])]
        if end < 0 or len(values) != len(names) or not values[-1].isdigit() or end + 1 + int(values[-1]) > len(data):
            raise ValueError(f"not an ARC header line at byte {at}: {line[:200]!r}")
        at = end + 1 + int(values[-1])
        block = data[end + 1 : at]
        if first:
            lines = block.decode(errors="replace").split("\n")
            if len(lines) > 1 and lines[1].strip():
                names = lines[1].split()
        yield ArcRecord(dict(zip(FIELDS[2] if first and len(values) == len(FIELDS[2]) else FIELDS[1] if first else names, values, strict=False)), block)


def iso_date(digits: str) -> str:
    """A 14-digit ARC date (or the 12 or 8 digits of older ones) as WARC writes it."""
    d = (re.sub(r"\D", "", digits) + "00010101000000"[len(re.sub(r"\D", "", digits)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def converted(record: ArcRecord) -> dict:
    """What the WARC record of an ARC record needs: url, date, kind, content type, block, payload, digests, HTTP headers."""
    url, block = record.fields["URL"], record.block
    http = block[:5] == b"HTTP/"
    head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    headers = dict(line.split(": ", 1) for line in head.decode(errors="replace").split("\r\n")[1:] if ": " in line)
    digest = hashlib.sha256(body).hexdigest()
    kind = "response" if http else "warcinfo" if url.startswith("filedesc://") else "resource"
    return {"url": url, "ip": record.fields.get("IP-address", "0.0.0.0"), "date": iso_date(record.fields["Archive-date"]), "kind": kind, "content_type": "application/http;msgtype=response" if http else record.fields["Content-type"], "head": head + b"\r\n\r\n" if http else b"", "payload": body, "payload_digest": digest, "http": headers}


def record_id(digest: str, page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest} {page}')}>"


def warc_record(kind: str, identity: str, url: str, date: str, content_type: str, block: bytes, payload_digest: str, more: dict[str, str]) -> bytes:
    """A WARC/1.1 record without the two line ends after it (the writer adds them)."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identity}", f"WARC-Target-URI: {url}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{payload_digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", *[f"{k}: {v}" for k, v in more.items()], f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode(errors="surrogateescape") + b"\r\n\r\n" + block


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open (decompressed) WARC file."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode(errors="surrogateescape").rstrip("\r\n").partition(": ")
            headers[k] = v
        yield headers, stream.read(int(headers["Content-Length"]))


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", version: int | None = None, date: str = "20200101000000") -> DataFrame:
    """One ARC file (column arc) for each few MB of ``pages``, of the given version or of both in turn. The id goes into an HTTP header; null html is an empty body.

    A null id gets no header, a null url the id's urn. Rows may repeat; other columns aren't read.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches):
            records = []
            for page, address, body in zip(b["id"].to_pylist(), b["url"].to_pylist(), b["html"].cast(pa.binary()).to_pylist(), strict=True):
                body = body or b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n" + (f"{ID_HEADER}: {page}\r\n" if page is not None else "")
                records.append((address if address else f"urn:page:{page}", date, "text/html", head.encode() + b"\r\n" + body))
            yield pa.RecordBatch.from_arrays([pa.array([arc_file(records, version or 1 + k % 2, date=date)], pa.binary())], ["arc"])

    return pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, "arc binary")


RECORDS = "page_id long, url string, date string, kind string, content_type string, head binary, payload binary, payload_bytes long, payload_digest string"


def arc_to_records(arcs: DataFrame, column: str = "arc") -> DataFrame:
    """The converted records of ARC files (a binary ``column``; null and empty files have none), without version blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary(), pa.int64(), pa.string()]
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for record in arc_records(data.as_py() or b""):
                    c = converted(record)
                    if c["kind"] == "warcinfo":
                        continue
                    page = c["http"].get(ID_HEADER)
                    rows.append((int(page) if page else None, c["url"], c["date"], c["kind"], c["content_type"], c["head"], c["payload"], len(c["payload"]), c["payload_digest"]))
                    size += len(c["payload"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return arcs.select(column).mapInArrow(run, RECORDS)


def _warcinfo() -> bytes:
    fields = b"software: utrflow\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(hashlib.sha256(fields).hexdigest(), 'warcinfo')}", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Block-Digest: sha256:{hashlib.sha256(fields).hexdigest()}", "Content-Type: application/warc-fields", f"Content-Length: {len(fields)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + fields


def write_warc(records: DataFrame, path: str, least: int = LEAST, size: int = ROW_BYTES) -> None:
    """Writes converted records as WARC files at ``path``: a warcinfo record first, each record a gzip member of its own.

    Of records with equal payloads of at least ``least`` bytes that with the smallest page_id (nulls last; of repeated rows
    one) is a response, the others revisit it, without their payload; smaller ones are all responses. Only records whose
    digest may occur more than once are shuffled. Of every ``FILE_ROWS`` rows, each of which ends with the record that
    brings it to ``size`` bytes, a file is made. An empty table gives no records.
    """
    known = marked(records.withColumn("__digest", F.when(F.col("payload_bytes") >= least, F.col("payload_digest"))), "__digest", "page_id")
    member = lambda record: gzip.compress(record + b"\r\n\r\n", 1, mtime=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the writer begins a file at every FILE_ROWS rows of a task
        rows, out, used = 0, [member(_warcinfo())], 0
        for b in batches:
            for r in b.to_pylist():
                more = {}
                kind, block = r["kind"], r["head"] + r["payload"]
                if not r["kept"]:
                    kind, block = "revisit", r["head"]
                    more = {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(r["payload_digest"], r["keep_id"])} | ({"X-Refers-To-Page-Id": str(r["keep_id"])} if r["keep_id"] is not None else {})
                more |= {"X-Payload-Length": str(r["payload_bytes"])} | ({ID_HEADER: str(r["page_id"])} if r["page_id"] is not None else {})
                # of repeated rows each needs an identifier of its own only where it isn't the response
                identity = record_id(r["payload_digest"], r["page_id"] if r["kept"] else f"revisit {r['page_id']} {r['url']}")
                out.append(member(warc_record(kind, identity, r["url"], r["date"], r["content_type"], block, r["payload_digest"], more)))
                used += len(out[-1])
                if used >= size:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])
                    rows += 1
                    out, used = [member(_warcinfo())] if rows % FILE_ROWS == 0 else [], 0
        if used:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])

    # the bytes of a row go out as they are, and the separator after them in the given encoding
    text = known.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    text.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", FILE_ROWS).option("compression", "none").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the gzipped WARC files at ``path`` but warcinfo: page_id, url, date, payload_bytes,
    payload_digest, record_type, refers_to, sound.

    Length and digest are worked out from the payload that was read; a revisit holds none, so that they are its headers'.
    ``sound``: the block has the digest of its header, and so has the payload, and its length.
    """
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for content in b.column(0):
                rows = []
                with gzip.open(io.BytesIO(content.as_py())) as stream:
                    for h, block in warc_records(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        told = (int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"))
                        body = block.partition(b"\r\n\r\n")[2] if h["Content-Type"].startswith("application/http") else block
                        got = told if h["WARC-Type"] == "revisit" else (len(body), sha(body))
                        sound = got == told and h["WARC-Block-Digest"] == f"sha256:{sha(block)}"
                        rows.append((number(h.get(ID_HEADER)), h["WARC-Target-URI"], h["WARC-Date"], *got, h["WARC-Type"], number(h.get("X-Refers-To-Page-Id")), sound))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
                columns = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(arc_to_records(pages_to_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"))), path)
    kind = F.when(F.col("sound"), F.col("record_type")).otherwise(F.raise_error(F.lit("a record that was read back differs from what its headers tell")).cast("string"))
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.first IS NULL OR g.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON g.payload_digest = p.payload_digest AND p.payload_bytes >= 100
"""

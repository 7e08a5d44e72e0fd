"""Legacy archives: writing ARC files, converting ARC to WARC, and reading WARC files back.

An ARC file starts with a version block (`filedesc://...`) whose body names the version and the fields of the header
lines that follow; version 1 has five fields and version 2 has ten. Each record is a header line, as many bytes as the
line's last field declares, and a line feed. The converter reads header lines by the version in force and takes bodies
by their declared lengths alone, whatever they contain, then synthesises what a WARC record needs and ARC lacks: an
identifier (from archive and offset), an ISO timestamp, a type, and digests. Of records with equal payloads the first
by key is a response and the others are revisits, which keep their HTTP header and refer to it.

Archives are written by Spark's text writer, which commits files as it does for any table, so they may be in any store
that Spark writes; a row is one record or several that make up `ROW_BYTES` at most, and the line separator is the one that
the format puts after a record. Files are read whole, as binary files. Their size is bounded by bytes: a file gets so
many rows that it stays under `FILE_BYTES`, whatever the sizes of records (one record is always allowed).

Defined cases: a null payload is empty; null URLs become `urn:page:KEY`; blanks, controls and non-ASCII characters of
URLs are percent-encoded; null keys rank behind every other and are left out of the header; rows that repeat are
records of their own, of which one is the response. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, new_path, ship

FILE_BYTES, ROW_BYTES = 256 << 20, 8 << 20
#: Bytes of URLs that a broadcast may hold.
BROADCAST_BYTES = 32 << 20
LEAST_REVISIT = 100
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    version: int
    offset: int
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    extra: dict[str, str] = field(default_factory=dict)


def unpacked(data: bytes) -> bytes:
    """The bytes of a file that may be compressed as one gzip member or several."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        part = zlib.decompressobj(31)
        out.append(part.decompress(data))
        data = part.unused_data
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, version blocks included."""
    at, names = 0, FIELDS[1].split()
    version = 1
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)]
        if not line.strip():
            at += len(line) + 1
            continue
        start, text = at, line.decode("utf-8", "replace").rstrip("\r")
        at += len(line) + 1
        if text.startswith("filedesc://"):
            size = int(text.rsplit(" ", 1)[1])
            body = data[at : at + size]
            said = body.split(b"\n", 2)
            version = int(said[0].split()[0])
            names = said[1].decode().split() if len(said) > 1 and said[1].strip() else FIELDS[version].split()
            parts = text.rsplit(" ", len(FIELDS[1].split()) - 1)[:5]
            yield ArcRecord(version, start, parts[0], parts[1], parts[2], parts[3], body)
        else:
            # the URL is the only field that may hold blanks, so fields are told apart from the right
            parts = text.rsplit(" ", len(names) - 1)
            if len(parts) != len(names) or not parts[-1].isdigit():
                raise ValueError(f"not an ARC header line of version {version} at byte {start}: {text[:200]!r}")
            got = dict(zip(names, parts, strict=True))
            size = int(got.pop("Archive-length"))
            body = data[at : at + size]
            if len(body) < size:
                raise ValueError(f"the record at byte {start} declares {size} bytes, and {len(body)} follow")
            yield ArcRecord(version, start, got.pop("URL"), got.pop("IP-address"), got.pop("Archive-date"), got.pop("Content-type"), body, got)
        at += size


def iso_date(stamp: str) -> str:
    """Of 8 to 14 digits; what is missing is the least possible."""
    d = re.sub(r"\D", "", stamp).ljust(8, "0")
    d = (d[:4] + (d[4:6] if d[4:6] > "00" else "01") + (d[6:8] if d[6:8] > "00" else "01") + d[8:]).ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its blank line, and the payload; no header if the body isn't an HTTP response."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    m = re.search(rb"\r?\n\r?\n", body)
    return (body[: m.end()], body[m.end() :]) if m else (body, b"")


def http_field(header: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", header)
    return m[1].decode("latin-1").strip() if m else None


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def warc_record(kind: str, rid: str, date: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    """A record without the line end that closes it, which the writer adds."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in headers)]
    lines += [f"WARC-Block-Digest: sha256:{sha256(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n"


def converted(r: ArcRecord, archive: str, original: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; `original` (identifier, URL, date) makes it a revisit of that record."""
    rid, date = record_id(archive, r.offset), iso_date(r.date)
    if r.url.startswith("filedesc://"):
        text = f"software: voxtide\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC version {r.version}\r\n".encode()
        return warc_record("warcinfo", rid, date, text, [("WARC-Filename", r.url.removeprefix("filedesc://")), ("Content-Type", "application/warc-fields")])
    header, payload = http_parts(r.body)
    about = [("WARC-Target-URI", r.url), ("WARC-Payload-Digest", f"sha256:{sha256(payload)}")]
    if re.fullmatch(r"[0-9a-fA-F.:]+", r.ip) and r.ip != "0.0.0.0":
        about.append(("WARC-IP-Address", r.ip))
    kind = "application/http; msgtype=response" if header else r.mime
    if original:
        about += [("WARC-Refers-To", original[0]), ("WARC-Refers-To-Target-URI", original[1]), ("WARC-Refers-To-Date", original[2]), ("WARC-Profile", REVISIT_PROFILE)]
        return warc_record("revisit", rid, date, header, [*about, ("Content-Type", kind)])
    return warc_record("response" if header else "resource", rid, date, r.body, [*about, ("Content-Type", kind)])


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record at byte {at}: {first[:100]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4 + int(fields["content-length"])
        yield fields, data[end + 4 : at]


def _encoded(url: str | None, key) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{key}"


def _write(rows: DataFrame, path: str, end: str, per_file: int) -> None:
    # the text writer writes a string's bytes as they are; the bytes need not be UTF-8
    out = rows.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    out.option("maxRecordsPerFile", per_file).text(path)


def rows_per_file(largest: int) -> int:
    """Rows of ROW_BYTES, or of one record of `largest` bytes where that is more, that a file may hold."""
    return max(1, FILE_BYTES // max(ROW_BYTES, largest + 2000))


def joined(records: Iterator[bytes], end: bytes, most: int) -> Iterator[bytes]:
    """Records that follow each other, as few rows: as many of them as make up `most` bytes."""
    held, size = [], 0
    for r in records:
        if held and size + len(r) + len(end) > most:
            yield end.join(held)
            held, size = [], 0
        held.append(r)
        size += len(r) + len(end)
    if held:
        yield end.join(held)


def _rows(values: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    return (pa.RecordBatch.from_arrays([pa.array([v], pa.binary())], ["value"]) for v in values)


def write_arc(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", body_col: str = "html", stamp: str = "20240101000000") -> None:
    """One ARC record per row: an HTTP response with the body in UTF-8 and the key in a header field. Files alternate between versions 1 and 2."""
    ship(pages.sparkSession)
    per_file = rows_per_file(pages.agg(F.max(F.octet_length(body_col))).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, held, size = TaskContext.get().partitionId(), 0, [], 0

        def value() -> bytes:
            version = (part + rows // per_file) % 2 + 1
            about = f"{version} 0 voxtide\n{FIELDS[version]}\n".encode()
            head = [f"filedesc://part-{part}-{rows}.arc 0.0.0.0 {stamp} text/plain {len(about)}\n".encode() + about] if rows % per_file == 0 else []
            out = [f"{url} 0.0.0.0 {stamp} text/html {'' if version == 1 else f'200 - - 0 part-{part}-{rows}.arc '}{len(block)}\n".encode() + block for url, block in held]
            return b"\n".join(head + out)

        for batch in batches:
            for key, url, body in zip(*batch.columns, strict=True):
                key, url, body = key.as_py(), url.as_py(), body.as_py()
                named = b"" if key is None else f"X-Page-Id: {key}\r\n".encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + named + f"Content-Length: {len(body)}\r\n\r\n".encode() + body
                url = _encoded(url, key)
                if held and size + len(block) + len(url) > ROW_BYTES:
                    yield from _rows([value()])
                    rows, held, size = rows + 1, [], 0
                held.append((url, block))
                size += len(block) + len(url) + 200
        if held:
            yield from _rows([value()])

    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(key_col), F.col(url_col), body).mapInArrow(run, "value binary")
    _write(rows.select(F.col("value").cast("string")), path, "\n", per_file)


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def arc_index(spark, path: str, key_type: str = "long") -> DataFrame:
    """(rid, key, bytes, digest, url, date) of each record of ARC files, version blocks left out."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for r in arc_records(unpacked(content.as_py())):
                    if not r.url.startswith("filedesc://"):
                        header, payload = http_parts(r.body)
                        key = http_field(header, b"X-Page-Id")
                        out.append((record_id(name, r.offset), key, len(payload), sha256(payload), r.url, iso_date(r.date)))
                cols = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 2 else pa.string()) for i, c in enumerate(cols)], ["rid", "key", "bytes", "digest", "url", "date"])

    rows = _files(spark, path).mapInArrow(run, "rid string, key string, bytes long, digest string, url string, date string")
    return rows.withColumn("key", F.col("key").cast(key_type))


def convert_arc(spark, source: str, target: str, key_type: str = "long", least: int = LEAST_REVISIT) -> None:
    """ARC files to WARC files. Of equal payloads of at least `least` bytes, the one with the least key is the response."""
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "rid", "url", "date")).alias("first")
    most = ROW_BYTES
    every = materialize(arc_index(spark, source, key_type), "arc-index")
    per_file = rows_per_file(every.agg(F.max("bytes")).first()[0] or 0)
    index = every.filter(F.col("bytes") >= least)
    originals = index.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first.rid", "first.url", "first.date")
    originals = materialize(originals, "arc-originals")

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = [(name, r.offset, None if r.url.startswith("filedesc://") else sha256(http_parts(r.body)[1]), r.url, r.ip, r.date, r.mime, r.version, r.body) for r in arc_records(unpacked(content.as_py()))]
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def build(batches):
        def records():
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    r = ArcRecord(row["version"], row["offset"], row["u"], row["ip"], row["stamp"], row["mime"], row["body"])
                    again = row["rid"] and row["rid"] != record_id(row["name"], row["offset"])
                    yield converted(r, row["name"], (row["rid"], row["url"], row["date"]) if again else None)

        yield from _rows(joined(records(), b"\r\n", most))

    names = ["name", "offset", "digest", "u", "ip", "stamp", "mime", "version", "body"]
    records = _files(spark, source).mapInArrow(parse, "name string, offset long, digest string, u string, ip string, stamp string, mime string, version long, body binary")
    wide = originals.agg(F.sum(F.octet_length("url"))).first()[0] or 0
    rows = records.join(broadcast_if_small(originals) if wide <= BROADCAST_BYTES else originals, "digest", "left")
    _write(rows.mapInArrow(build, "value binary").select(F.col("value").cast("string")), target, "\r\n", per_file)


def warc_index(spark, path: str, key_type: str = "long") -> DataFrame:
    """(rid, refers, kind, key, bytes, digest) of each response, resource and revisit of WARC files.

    Length and digest are those of the full payload: measured and compared with the header where a record has it, and
    taken from the header fields where it is a revisit.
    """
    ship(spark)

    def run(batches):
        for batch in batches:
            for content in batch.column(1):
                out = []
                for fields, block in warc_records(unpacked(content.as_py())):
                    kind = fields["warc-type"]
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    header, payload = http_parts(block)
                    key, said = http_field(header, b"X-Page-Id"), fields["warc-payload-digest"].removeprefix("sha256:")
                    size, digest = (int(http_field(header, b"Content-Length") or 0), said) if kind == "revisit" else (len(payload), sha256(payload))
                    if digest != said:
                        raise ValueError(f"{fields['warc-record-id']}: the payload doesn't have the digest that its header says")
                    out.append((fields["warc-record-id"], fields.get("warc-refers-to"), kind, key, size, digest))
                cols = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 4 else pa.string()) for i, c in enumerate(cols)], ["rid", "refers", "kind", "key", "bytes", "digest"])

    rows = _files(spark, path).mapInArrow(run, "rid string, refers string, kind string, key string, bytes long, digest string")
    return rows.withColumn("key", F.col("key").cast(key_type))


def archive_round_trip(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """`pages` as ARC files, converted to WARC files and read back: key, payload_bytes, payload_digest, record_type, refers_to (the response's key)."""
    spark, kind = pages.sparkSession, pages.schema[key_col].dataType.simpleString()
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, key_col, url_col, body_col)
    convert_arc(spark, arc, warc, kind)
    rows = materialize(warc_index(spark, warc, kind), "warc-index")
    # only responses that something refers to are looked up
    wanted = rows.filter("refers is not null").select(F.col("refers").alias("rid")).distinct()
    of = materialize(rows.join(wanted, "rid", "left_semi").select(F.col("rid").alias("refers"), F.col("key").alias("refers_to")), "warc-originals")
    out = rows.join(broadcast_if_small(of), "refers", "left")
    return out.select(F.col("key").alias(key_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")

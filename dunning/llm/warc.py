"""WARC archives: writer with revisit records and a splittable reader
(operator 8).

Archives hold one gzip member for each record.  The reader needs no index: a
task takes a byte range, looks for the gzip magic, accepts a place only if a
member starts there that decodes to a WARC header, and owns the records that
start inside its range; it reads on past the end of the range to finish the
last one.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, column, new_folder, pieces, read_table, stage, tasks_for
from .files import open_read, write_new

by_value(__name__)

GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive at about which the next one begins, and of a range that a task scans.
ARCHIVE_BYTES, RANGE_BYTES = 16 << 20, 4 << 20
#: Read at a time.
BUFFER = 1 << 20
MANIFEST = pa.schema([("file", pa.string()), ("size", pa.int64()), ("records", pa.int64())])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing ------------------------------------------------------------------


def with_revisits(pages: DataFrame, page_id: str, html: str, url: str, least_bytes: int) -> DataFrame:
    """page_id, uri, payload and refers_to: of equal payloads of at least
    ``least_bytes`` the page with the largest id, null for that page itself and
    for smaller payloads."""
    body = F.coalesce(column(pages, html).cast("string"), F.lit("")).cast("binary")
    uri = column(pages, url).cast("string") if url in pages.columns else F.lit(None).cast("string")
    rows = pages.select(column(pages, page_id).alias("page_id"), uri.alias("uri"), body.alias("payload")).withColumn("key", F.sha2("payload", 512))
    # partial maxima before the shuffle: a single payload may belong to a third of all pages
    last = rows.filter(F.length("payload") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    last = last.filter("n > 1 and last is not null").select("key", "last")
    copies = rows.select("page_id", "key").join(last, "key").filter("page_id is null or page_id != last").distinct()
    copies = copies.select(F.col("page_id").alias("copy"), F.col("key").alias("its"), "last")
    return rows.join(copies, F.col("page_id").eqNullSafe(F.col("copy")) & (F.col("key") == F.col("its")), "left").select(
        "page_id", "uri", "payload", F.col("last").alias("refers_to")
    )


def record(page_id, payload: bytes, uri: str, refers_to) -> bytes:
    """One record as a gzip member.  A revisit holds no payload, but its size
    and digest."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode(),
        b"WARC-Date: 2000-01-01T00:00:00Z",
        b"WARC-Target-URI: " + "".join(uri.split()).encode(),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}".encode(),
        f"X-Payload-Length: {len(payload)}".encode(),
        b"Content-Type: text/html",
        b"Content-Length: %d" % len(body),
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}".encode(), f"WARC-Refers-To: <urn:page:{refers_to}>".encode()]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def write_warc(
    pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write one record for each row and return the manifest: file, size,
    records.

    The payload is the html in UTF-8, null an empty one.  A null id is an empty
    id; repeated rows are records of their own: of a page id repeated with
    equal payloads that is the largest, each row is a response.  An empty table
    writes no archive.
    """
    folder = new_folder(pages.sparkSession, "warc")
    rows = with_revisits(pages, page_id, html, url, least_bytes)

    def save(batches):
        parts, size, records = [], 0, 0
        for piece in pieces(batches, "payload"):
            for page, uri, payload, refers_to in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                data = record(page, payload, uri or f"urn:page:{page}", refers_to)
                if parts and size + len(data) > archive_bytes:
                    yield pa.RecordBatch.from_pylist([{"file": write_new(folder, ".warc.gz", b"".join(parts)), "size": size, "records": records}], MANIFEST)
                    parts, size, records = [], 0, 0
                parts.append(data)
                size, records = size + len(data), records + 1
        if parts:
            yield pa.RecordBatch.from_pylist([{"file": write_new(folder, ".warc.gz", b"".join(parts)), "size": size, "records": records}], MANIFEST)

    return stage(rows.mapInArrow(save, "file string, size long, records long"), "warc-manifest")


# --- reading ------------------------------------------------------------------


class Source:
    """Forward reading with a bounded buffer."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def bytes_at(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, BUFFER))
        return self.data[at - self.at : at - self.at + n]


def header_at(source: Source, at: int) -> tuple[dict[str, str], bytes] | None:
    """Header fields of the record whose gzip member starts at ``at``, and its
    first line; None if no such member starts there.  A header may have any
    length: what begins like one is decoded to its end."""
    packer = zlib.decompressobj(31)
    out, data, k = bytearray(), b"", 0
    while not packer.eof:
        if not data:
            data = source.bytes_at(at + k, 4096)
            k += len(data)
            if not data:
                return None
        seen = len(out)
        try:
            out += packer.decompress(data, 1 << 16)
        except zlib.error:
            return None
        data = packer.unconsumed_tail
        if not b"WARC/".startswith(out[:5]):
            return None
        end = out.find(b"\r\n\r\n", max(seen - 3, 0))
        if end >= 0:
            lines = bytes(out[:end]).split(b"\r\n")
            fields = dict(x.decode("utf-8", "replace").split(":", 1) for x in lines[1:] if b":" in x)
            return {a.strip().lower(): b.strip() for a, b in fields.items()}, lines[0]
    return None


def member_at(source: Source, at: int) -> tuple[bytes, int]:
    """The whole member at ``at``, decoded, and where it ends."""
    packer, out, k = zlib.decompressobj(31), [], at
    while not packer.eof:
        data = source.bytes_at(k, min(BUFFER, max(1, source.size - k)))
        if not data:
            raise EOFError(f"the record at {at} is cut off")
        out.append(packer.decompress(data))
        k += len(data) - len(packer.unused_data)
    return b"".join(out), k


def records_in(source: Source, start: int, stop: int):
    """(place, fields, body) of each record that starts in [start, stop)."""
    at = start
    while at < stop:
        window = source.bytes_at(at, min(BUFFER, stop + len(GZIP_MAGIC) - 1 - at, source.size - at))
        found = window.find(GZIP_MAGIC)
        if found < 0:
            at += max(1, len(window) - len(GZIP_MAGIC) + 1)
            continue
        at += found
        if at >= stop:
            return
        head = header_at(source, at)
        if head is None:
            at += 1
            continue
        whole, end = member_at(source, at)
        split = whole.index(b"\r\n\r\n") + 4
        length = int(head[0].get("content-length", 0))
        yield at, head[0], whole[split : split + length]
        at = end


def read_warc(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of the archives in ``files`` (file, size): file, place,
    type, record_id, uri, payload_bytes, payload_digest, refers_to, payload
    (null for revisits).  Ranges of about ``range_bytes`` are read apart, also
    those of one archive."""
    ranges = files.select(
        "file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start")
    )
    ranges = ranges.repartition(tasks_for(ranges))
    out = pa.schema(
        [("file", pa.string()), ("place", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()),
         ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]
    )

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with open_read(r["file"]) as f:
                    some, held = [], 0
                    for place, h, body in records_in(Source(f, r["size"]), r["start"], min(r["start"] + range_bytes, r["size"])):
                        revisit = h.get("warc-type") == "revisit"
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else payload_digest(body)
                        some.append(
                            {"file": r["file"], "place": place, "type": h.get("warc-type"), "record_id": h.get("warc-record-id", "").strip("<>"), "uri": h.get("warc-target-uri"),
                             "payload_bytes": int(h.get("x-payload-length", 0)) if revisit else len(body), "payload_digest": digest,
                             "refers_to": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, "payload": None if revisit else body}
                        )
                        held += len(body)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(some, out)
                            some, held = [], 0
                    if some:
                        yield pa.RecordBatch.from_pylist(some, out)

    return ranges.mapInArrow(
        read, "file string, place long, type string, record_id string, uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    )


def check_count(files: DataFrame, records: DataFrame) -> None:
    """Fail if not as many records were read as the manifest says were written."""
    written, read = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], records.count()
    if written != read:
        raise RuntimeError(f"{written} records were written, {read} were read")


def list_warc(spark: SparkSession, folder: str) -> DataFrame:
    """file and size of the archives in a folder, for :func:`read_warc`."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select(F.col("path").alias("file"), F.col("length").alias("size"))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    files = write_warc(read_table(spark, sf_dir, "pages"))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    records = read_warc(spark, files).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to")
    )
    records = stage(records, "warc-records")
    check_count(files, records)
    return records

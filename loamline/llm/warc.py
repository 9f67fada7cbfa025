"""WARC archives: records with revisits and segments are written, read back and reassembled.

Writing: a page is a `response` record whose block is an HTTP response in chunked transfer framing; a block longer than
`segment_bytes` goes on in `continuation` records. Pages with equal payloads of at least `min_bytes` bytes are stored once, under the
smallest page_id; the others are `revisit` records that refer to it. Archives are gzip files in the shared folder, written by
Spark's text writer: a record is a line whose separator is the blank line that ends a record.

Reading: each archive is parsed by the records' own lengths. Segments are grouped by origin id, ordered by segment number, checked for
gaps and against the total length, joined, and the chunked framing is decoded; payload size and digest come from the decoded bytes.

A null html is an empty payload, a null url has no target URI. A null page_id is larger than all others and never refers to
anything but a smaller one. Rows that repeat page_id and payload are one record written more than once: each is a response
where one of them is. Of tied pages, with one payload, the smallest page_id is the response. Very long pages are as many segments as they need, so no record and no file grows with a page. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped, join_skewed, map_slices, shared_path, small_enough, written

#: A file has at most FILE_RECORDS records, each with a block of SEGMENT bytes at most: 66 MB unpacked.
SEGMENT, CHUNK, FILE_RECORDS = 32 << 10, 8 << 10, 2000
#: Bytes of blocks that a reader hands on at once.
BATCH_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of about `size` bytes that don't split a character."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n" + block.decode()


def page_records(page_id: int | None, url: str | None, html: str, refers_to: int | None, segment: int = SEGMENT) -> list[str]:
    """The records of one page, each without the blank line after it."""
    payload = html.encode()
    digest = _digest(payload)
    name = lambda i: f"<urn:page:{'' if i is None else i}:{digest}>"
    uri = re.sub(r"[\r\n]+", "", url) if url is not None else None
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    own = [("WARC-Page-ID", page_id)]
    if refers_to is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(page_id)), *shared, *own, *more], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")]
    chunks = [b"%x\r\n%s\r\n" % (len(c), c) for c in _cuts(payload, CHUNK)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + b"".join(chunks) + b"0\r\n\r\n"
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", name(page_id)), *shared, *own], block)]
    parts = _cuts(block, segment)
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", name(page_id)), *shared, *own, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name(page_id)[:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name(page_id)), ("WARC-Segment-Number", k)]
        out.append(_record([*fields, ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)], part))
    return out


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Write (page_id, url, html) rows as gzip archives below `path`."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(payload).alias("digest"))
    same = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_bytes)
    same = written(same.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "payloads")
    rows = rows.join(F.broadcast(same.drop("n")), "digest", "left") if small_enough(same) else join_skewed(rows, same, "digest", "n", "left")
    rows = rows.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def records(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [r for row in batch.to_pylist() for r in page_records(row["page_id"], row["url"], row["html"], row["refers_to"], segment)]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    archive = map_slices(rows, "html", records, "value string")
    archive.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def records_of(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of an uncompressed archive, read one after the other."""
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:20]!r}")
        fields = {}
        while (line := archive.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a record's head has no end")
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        length = int(fields["content-length"])
        block = archive.read(length)
        if len(block) != length:
            raise ValueError("a record is cut short")
        yield fields, block
        archive.read(4)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    return records_of(io.BytesIO(data))


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response, its chunked transfer framing undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    if not re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head):
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + size


_FIELDS = "origin string, segment int, type string, page_id long, refers_to string, payload_bytes long, payload_digest string, total long, block binary"
_KINDS = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], _NAMES)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record; only segments still carry their block, what is whole is decoded on the spot."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                data = io.BytesIO(value.as_buffer())
                packed = data.read(2) == b"\x1f\x8b"
                data.seek(0)
                out, held = [], 0
                for f, block in records_of(gzip.GzipFile(fileobj=data) if packed else data):  # unpacked as it is read
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield _rows(out)
                        out, held = [], 0
                    kind, number = f["warc-type"], f.get("warc-segment-number")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    page = int(f["warc-page-id"]) if "warc-page-id" in f else None
                    row = (f.get("warc-segment-origin-id", f["warc-record-id"]), int(number or 0), kind, page, f.get("warc-refers-to"))
                    if number:
                        total = f.get("warc-segment-total-length")
                        out.append((*row, None, None, int(total) if total else None, block))
                    elif kind == "response":
                        payload = http_payload(block)
                        out.append((*row, len(payload), _digest(payload), None, None))
                    else:
                        out.append((*row, None, f.get("warc-payload-digest", "").removeprefix("sha1:"), None, None))
                yield _rows(out)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, _FIELDS)


def reassemble(records: DataFrame) -> DataFrame:
    """Records with each segmented one made whole, decoded and checked."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["origin"]):
            out, groups = [], {}
            for row in table.to_pylist():
                if row["segment"]:
                    groups.setdefault(row["origin"], []).append(row)
                else:
                    out.append(tuple(row.values()))
            for origin, rows in groups.items():
                parts = {r["segment"]: r for r in rows}
                blocks = [parts[k]["block"] for k in sorted(parts)]
                total = max((r["total"] or 0 for r in rows), default=0)
                if sorted(parts) != list(range(1, len(parts) + 1)) or sum(map(len, blocks)) != total:
                    raise ValueError(f"{origin}: segments {sorted(parts)} don't make up {total} bytes")
                payload = http_payload(b"".join(blocks))
                done = (len(payload), _digest(payload), None, None)
                out += [(origin, 0, r["type"], r["page_id"], None, *done) for r in rows if r["segment"] == 1]
            yield _rows(out)

    return records.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(join, _FIELDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page below `path`."""
    rows = written(reassemble(read_records(spark, path)).drop("segment", "total", "block"), "records")
    responses, revisits = rows.where("type = 'response'"), rows.where("type = 'revisit'")
    wanted = revisits.groupBy(F.col("refers_to").alias("origin")).agg(F.count("*").alias("n"))
    found = responses.dropDuplicates(["origin"]).select("origin", F.col("page_id").alias("first_id"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    found = written(wanted.join(found, "origin"), "referred")
    resolved = join_skewed(revisits.select("page_id", F.col("refers_to").alias("origin"), "type"), found, "origin", "n", "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        resolved.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("first_id").alias("refers_to"))
    )


def archived_pages(pages: DataFrame, min_bytes: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, min_bytes, segment)
    return read_archives(spark, path)

"""WARC: an index first, then coalesced byte-range reads.

`write` makes one gzip-compressed WARC/1.1 file per task, each record a gzip
member of its own, and returns the index: file, offset, length, url, digest and
the record's identity.  `select` picks index rows with DataFrame filters, and
`read` fetches them: the ranges are sorted by file and offset, neighbours with
small gaps are joined into one read, and the reads are dealt out by bytes.  Only
ranges of the selected records are ever opened.

A response holds an HTTP head and the payload, a revisit the head alone.  Record ids are
made from file name and number, so they are unique whatever the page ids; those stand in
``X-Page-ID`` and ``X-Refers-To-Page-ID``.

Payloads that are equal are stored once: of each group the record with the
smallest page_id is the response, the others are revisits without payload.

Defined results
---------------
* null payload: empty; null url: empty target;
* several rows with the smallest page_id of a group: all of them are responses;
* groups in which every page_id is null: all responses;
* an empty table: no files, an empty index; extra columns are ignored;
* payloads are whole, of any length that fits a row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_counted, parts_of
from .files import Writer, open_store

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long, payload_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"


def dedup_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Columns page_id, url, payload, sha1, record_type, refers_to; groups are summed to one row before they meet."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    # Few payloads have copies.  Those on many pages are sent to the pages, which stay where they are; the firsts of the others meet their pages in an exchange.
    met = join_counted(rows, first, "sha1", rows.count(), "copies", "left")
    is_revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.octet_length("payload") >= least_bytes)
    return met.select(
        "page_id",
        "url",
        "payload",
        "sha1",
        F.when(is_revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(is_revisit, F.col("first_id")).alias("refers_to"),
    )


HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _header(kind: str, record: str, date: str, page_id: int | None, url: str, digest: str, refers: int | None, size: int, body: int) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{record}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {body}",
    ]
    if refers is not None:
        lines[5:5] = [f"X-Refers-To-Page-ID: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write(records: DataFrame, folder: str, level: int = 6, date: str | None = None) -> DataFrame:
    """Writes the records of `dedup_records`; the returned index is lazy, so write it before it is read twice.

    ``date``: the records' time, as in 2024-01-31T12:00:00Z; now if it isn't given.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        batch = next(batches, None)
        if batch is None:
            return
        number = 0
        with Writer(name) as out:
            while batch is not None:
                rows = []
                for r in batch.to_pylist():
                    whole = r["payload"] or b""
                    digest = base64.b32encode(hashlib.sha1(whole).digest()).decode()
                    body = HTTP_HEAD if r["record_type"] == "revisit" else HTTP_HEAD + whole
                    record, number = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{number}")), number + 1
                    c = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = c.compress(_header(r["record_type"], record, date, r["page_id"], r["url"], digest, r["refers_to"], len(whole), len(body)) + body + b"\r\n\r\n") + c.flush()
                    rows.append({"file": name, "offset": out.append(data), "length": len(data), "url": r["url"], "digest": digest, "page_id": r["page_id"], "record_type": r["record_type"], "refers_to": r["refers_to"], "payload_bytes": len(whole)})
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_ARROW)
                batch = next(batches, None)

    return records.mapInArrow(run, INDEX)


_INDEX_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())])
_RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def coalesce_ranges(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """Rows (file, start, end, members [(offset, length)]): sorted ranges, joined where the gap is small.

    A file is cut into stretches of ``most`` bytes by offset, and ranges are joined
    within a stretch, so that no task sorts a whole archive and no read grows without bound.
    """
    cut = index.select("file", "offset", "length", F.expr(f"offset div {most}").alias("stretch"))
    w = Window.partitionBy("file", "stretch").orderBy("offset")
    far = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(w) > gap
    runs = cut.withColumn("far", F.coalesce(far.cast("int"), F.lit(0))).withColumn("run", F.sum("far").over(w))
    return runs.groupBy("file", "stretch", "run").agg(
        F.min("offset").alias("start"),
        F.max(F.col("offset") + F.col("length")).alias("end"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("members"),
    ).select("file", "start", "end", "members")


def parse_record(data: bytes) -> dict:
    head, _, rest = zlib.decompress(data, 47).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID", "")
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["X-Payload-Length"])
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of page {page} doesn't match its digest")
    return {"page_id": int(page) if page else None, "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": int(refers) if refers else None, "digest": digest, "payload_bytes": size, "payload": payload}


def read(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20, with_payload: bool = True, task_bytes: int = 32 << 20) -> DataFrame:
    """The records of the given index rows, each parsed from its bytes and checked against its digest.  A task reads about ``task_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["file"])
                with store.open_input_file(path) as f:
                    data = f.read_at(row["end"] - row["start"], row["start"])
                rows = []
                for m in row["members"]:
                    at = m["offset"] - row["start"]
                    rows.append(parse_record(data[at : at + m["length"]]))
                    if not with_payload:
                        rows[-1]["payload"] = None
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)

    ranges = coalesce_ranges(index, gap, most).repartition(parts_of(index, "length", task_bytes), "file", "start")
    return ranges.mapInArrow(run, RECORDS)

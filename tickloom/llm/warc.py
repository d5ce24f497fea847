"""WARC archives: writing captures and assembling them again from their records.

A capture is three records: a request, a response (or a revisit, if an equal payload is kept by another page), and
metadata that has the payload's size; request and metadata name the response or revisit in WARC-Concurrent-To. Archives are gzipped files
written by Spark's text writer: its line separator is the two line ends that close a record. They are read back
file by file, parsed by Content-Length, and joined through the concurrent-to identifiers to one nested row a capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

END = "\r\n\r\n"
#: Smallest payload for which equal ones become revisits; bytes of payload in one archive file: usual and most.
LEAST_BYTES, FILE_BYTES, MOST_BYTES = 0, 16 << 20, 1 << 29
#: Bytes of records that a task gathers before it hands them to the writer.
HELD_BYTES = 1 << 21
DATE = "2024-01-01T00:00:00Z"


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, block: str, **more) -> str:
    """Header and block; the writer adds the two closing line ends."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{record_id}>", "WARC-Date": DATE, "WARC-Target-URI": uri.replace("\r", "%0D").replace("\n", "%0A")}
    fields |= {k.replace("_", "-"): v for k, v in more.items() if v is not None} | {"Content-Length": str(len(block.encode()))}
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n" + block


def captures(pages: DataFrame) -> DataFrame:
    """page_id, row, url, html ('' for null), bytes, and keeper: the row that keeps an equal payload (the largest page_id).

    ``row`` names a capture by its content, so that it stays the same when a task runs again: a hash of id, address and payload, and
    a number among rows that are equal in all three. Rows that repeat a page_id are captures of their own; a null page_id comes out
    as null."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("key"), F.octet_length(html).alias("bytes"))
    rows = rows.withColumn("rid", F.xxhash64("page_id", "url", "key"))
    again = common.written(rows.groupBy("rid").count().where("count > 1").select("rid"), "repeated")
    rows = rows.withColumn("copy", F.lit(0))
    few = again.count()
    if few:
        again = F.broadcast(again) if few <= common.BROADCAST_ROWS else again
        copy = F.row_number().over(Window.partitionBy("rid").orderBy("page_id"))
        rows = rows.join(again, "rid", "left_anti").unionByName(rows.join(again, "rid", "left_semi").withColumn("copy", copy))
    rows = rows.withColumn("row", F.concat_ws(".", F.hex("rid"), F.col("copy").cast("string")))
    best = F.max(F.struct(F.expr("try_cast(page_id as long)").alias("n"), "row", "page_id")).alias("keeper")
    kept = rows.where(F.col("bytes") >= LEAST_BYTES).groupBy("key").agg(best, F.count("*").alias("copies")).where("copies > 1").select("key", F.concat_ws(":", "keeper.row", "keeper.page_id").alias("keeper"))
    return rows.drop("rid", "copy").join(kept, "key", "left")


def records_of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The three records of each capture. However many and large the pages of a batch are, one of them and HELD_BYTES of records
    are held as Python objects."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    for batch in frames:
        out, held = [], 0
        for at in range(batch.num_rows):
            p = {name: batch.column(name)[at].as_py() for name in ("row", "page_id", "url", "html", "keeper")}
            n, uri, html = f"{p['row']}:{p['page_id']}", p["url"], p["html"]
            revisit = p["keeper"] is not None and p["keeper"] != n
            payload = html.encode()
            size, digest = len(payload), payload_digest(payload)
            host = uri.split("/")[2] if uri.count("/") >= 2 else ""
            here = f"capture:{n}"
            out.append(record("request", f"request:{n}", uri, f"GET {uri} HTTP/1.1\r\nHost: {host}\r\n\r\n", WARC_Concurrent_To=f"<urn:{here}>", Content_Type="application/http;msgtype=request"))
            if revisit:
                out.append(record("revisit", here, uri, head, WARC_Payload_Digest=f"sha1:{digest}", WARC_Refers_To=f"<urn:capture:{p['keeper']}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", Content_Type="application/http;msgtype=response"))
            else:
                out.append(record("response", here, uri, head + html, WARC_Payload_Digest=f"sha1:{digest}", Content_Type="application/http;msgtype=response"))
            out.append(record("metadata", f"metadata:{n}", uri, f"payloadBytes: {size}\r\npageId: {n}\r\n", WARC_Concurrent_To=f"<urn:{here}>", Content_Type="application/warc-fields"))
            held += size + 1000
            if held >= HELD_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_archives(pages: DataFrame, path: str) -> None:
    size = pages.select(F.octet_length("html").alias("n")).agg(F.avg("n"), F.max("n")).first()
    # three records a page; by the mean page a file has FILE_BYTES, and however large its pages are no more than MOST_BYTES
    pages_each = max(1, min(10_000, int(FILE_BYTES / max(size[0] or 1, 1)), int(MOST_BYTES / max(size[1] or 1, 1))))
    captures(pages).mapInArrow(records_of, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * pages_each).text(path)


def parse(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header, block) of each record; headers' names in lower case. One gzip stream or several."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        header: dict = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            header[name.strip().lower()] = value.strip()
        yield header, stream.read(int(header["content-length"]))


RECORD_SCHEMA = "record_id string, type string, uri string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, true_digest string, fields map<string,string>"


def read_records(spark, path: str) -> DataFrame:
    """One row for each record of the archives under ``path``. Payloads are measured and hashed, not kept."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in frames:
            for data in batch.column(0):
                rows: list = [[] for _ in range(9)]
                for h, block in parse(data.as_py()):
                    t = h["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2] if t == "response" else b""
                    fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x) if t == "metadata" else {}
                    strip = lambda v: v[5:-1] if v else None
                    for col, v in zip(rows, (strip(h["warc-record-id"]), t, h.get("warc-target-uri"), strip(h.get("warc-concurrent-to")), strip(h.get("warc-refers-to")), (h.get("warc-payload-digest") or "").partition(":")[2] or None, len(payload) if t == "response" else None, payload_digest(payload) if t == "response" else None, list(fields.items()))):
                        col.append(v)
                    if len(rows[0]) >= 5000:
                        yield batch_of(rows, kind)
                        rows = [[] for _ in range(9)]
                yield batch_of(rows, kind)

    def batch_of(rows, kind):
        types = [pa.string()] * 6 + [pa.int64(), pa.string(), kind]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["record_id", "type", "uri", "concurrent_to", "refers_to", "payload_digest", "payload_bytes", "true_digest", "fields"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: capture_id, record, request, metadata (null if missing)."""
    whole = F.struct("record_id", "type", "uri", "refers_to", "payload_digest", "payload_bytes", "true_digest", "fields")
    main = F.when(F.col("type").isin("response", "revisit"), whole)
    r = records.withColumn("capture_id", F.when(main.isNotNull(), F.col("record_id")).otherwise(F.col("concurrent_to"))).where("capture_id is not null")
    pick = lambda t: F.first(F.when(F.col("type") == t, whole), ignorenulls=True)
    return r.groupBy("capture_id").agg(F.first(main, ignorenulls=True).alias("record"), pick("request").alias("request"), pick("metadata").alias("metadata")).where("record is not null")


def op7(spark, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), path)
    rows = assemble(read_records(spark, path))
    number = lambda c: F.nullif(F.element_at(F.split(c, ":"), -1), F.lit("")).cast("long")
    return rows.select(
        number(F.col("capture_id")).alias("page_id"),
        F.coalesce(F.col("record.payload_bytes"), F.col("metadata.fields")["payloadBytes"].cast("long")).alias("payload_bytes"),
        F.coalesce(F.col("record.true_digest"), F.col("record.payload_digest")).alias("payload_digest"),
        F.col("record.type").alias("record_type"),
        number(F.col("record.refers_to")).alias("refers_to"),
    )

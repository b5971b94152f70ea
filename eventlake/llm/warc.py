"""WARC archives: a writer on DataFrame functions and a reader that trusts only record chains.

Writer. Every record is one row of bytes that Spark's text sink writes, so files appear
through the job's commit protocol on any store Spark can write to. A payload of at least
``min_revisit_bytes`` bytes that an earlier page (by id) already holds becomes a ``revisit``.

Reader. The magic ``WARC/1.1`` may also occur inside payloads. A task lists every place of a
file that looks like a record with the place of the record that would follow it; pointer jumping
from byte 0 then keeps only what the chain of real records reaches, and only that is read and
hashed. Files are bounded in bytes by the writer, so a task holds a whole one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC = b"WARC/1.1\r\n"
#: Bytes of a file, unless one record alone has more; the reader takes a file as one row.
FILE_BYTES = 64 << 20
#: Payloads are written by size classes, each four times the one before, so that as many records as fit
#: make a file whatever their sizes; this is the largest payload of the first class.
CLASS_BYTES = 32 << 10
#: Rows of the revisit table up to which it is broadcast (24 bytes each); beyond it is joined by shuffle.
BROADCAST_ROWS = 1_000_000
_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def plan_revisits(pages: DataFrame, id_col: str, payload_col: str, min_revisit_bytes: int) -> DataFrame:
    """(id, refers_to) of the pages whose payload an earlier page has; only digests are shuffled."""
    slim = pages.select(
        F.col(id_col).alias("id"),
        F.sha2(_bytes(payload_col), 256).alias("digest"),
        F.octet_length(_bytes(payload_col)).alias("n"),
    ).filter(F.col("n") >= min_revisit_bytes)
    first = slim.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    return slim.join(first, "digest").filter("id > refers_to").select("id", "refers_to").distinct()


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 100,
    date: str = "2024-01-01T00:00:00Z",
    file_bytes: int = FILE_BYTES,
) -> None:
    """Writes one record per row of ``pages`` below ``path``.

    A null payload is written as an empty one and a null url as an empty target; line breaks in
    urls become spaces. Files hold up to ``file_bytes`` bytes of payload, or one record. Rows that repeat an id each get a record; a row is never its own
    revisit. An empty table gives an archive without records. Further columns are not read.
    """
    spark = pages.sparkSession
    revisits = plan_revisits(pages, id_col, payload_col, min_revisit_bytes).withColumnRenamed("id", "__id")
    few = revisits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    body = _bytes(payload_col)
    rows = pages.select(
        F.col(id_col).alias("__id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\\r\\n]", " ").alias("__url"),
        body.alias("__body"),
        F.octet_length(body).alias("__n"),
        F.sha2(body, 256).alias("__digest"),
    ).join(F.broadcast(revisits) if few else revisits, "__id", "left")
    is_revisit = F.col("refers_to").isNotNull()
    id_text = F.coalesce(F.col("__id").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("__n").cast("string"), F.lit("\r\n\r\n"))
    block_length = F.when(is_revisit, F.length(http)).otherwise(F.length(http) + F.col("__n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), id_text,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("__url"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha256:"), F.col("__digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("__n").cast("string"),
        F.when(is_revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), block_length.cast("string"), F.lit("\r\n\r\n"), http,
    )
    # The text sink ends each row with a line feed, which is the last byte of the record.
    record = F.concat(head.cast("binary"), F.when(is_revisit, F.lit(b"")).otherwise(F.col("__body")), F.lit(b"\r\n\r"))
    size = lambda n: F.when(n <= CLASS_BYTES, 0).otherwise(F.ceil(F.log(4.0, n / CLASS_BYTES))).cast("int")
    held = pages.select(size(F.octet_length(body)).alias("size")).distinct().collect()  # a few numbers
    for k in sorted({r["size"] for r in held} | {0}):
        (
            rows.filter(size(F.col("__n")) == k)
            .select(record.cast("string").alias("value"))
            .write.option("maxRecordsPerFile", str(max(1, file_bytes // (CLASS_BYTES * 4**k))))
            .option("compression", "none")
            .text(f"{path}/size={k}")
        )


def _bytes(payload_col: str) -> Column:
    return F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))


RECORD = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("next", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("declared_digest", T.StringType()),
        T.StructField("declared_length", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_length", T.LongType()),
    ]
)


def parse_head(data: bytes, start: int) -> tuple[dict, int, int] | None:
    """(fields, block, next) of the record that would begin at ``start``, or None where header or length cannot hold."""
    head_end = data.find(b"\r\n\r\n", start)
    if head_end < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(data, start + len(MAGIC), head_end + 2)}
    try:
        length = int(fields[b"content-length"])
    except (KeyError, ValueError):
        return None
    block, following = head_end + 4, head_end + 4 + length + 4
    if length < 0 or following > len(data) or data[following - 4 : following] != b"\r\n\r\n":
        return None
    return fields, block, following


def parse_record(data: bytes, start: int) -> dict:
    """The record that begins at ``start``, its payload hashed."""
    fields, block, following = parse_head(data, start)
    text = lambda k: fields.get(k, b"").decode("utf-8", "replace")
    http_end = data.find(b"\r\n\r\n", block, following - 4)
    body = memoryview(data)[http_end + 4 if http_end >= 0 else block : following - 4]
    declared = text(b"x-payload-length")
    return {
        "start": start, "next": following, "record_type": text(b"warc-type"), "record_id": text(b"warc-record-id"),
        "target_uri": text(b"warc-target-uri"), "refers_to": text(b"warc-refers-to"),
        "declared_digest": text(b"warc-payload-digest"), "declared_length": int(declared) if declared.isdigit() else None,
        "payload_digest": hashlib.sha256(body).hexdigest(), "payload_length": len(body),
    }


def links(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, next) of every place that looks like a whole record."""
    start, following, at = [], [], data.find(MAGIC)
    while at >= 0:
        if (found := parse_head(data, at)) is not None:
            start.append(at)
            following.append(found[2])
        at = data.find(MAGIC, at + 1)
    return np.array(start, np.int64), np.array(following, np.int64)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in RECORD])
    for batch in batches:
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = content.as_buffer().to_pybytes()
            start, following = links(data)
            chain = np.sort(start[reachable(start, following)]).tolist()
            for i in range(0, len(chain), 2000):
                yield pa.RecordBatch.from_pylist([{"file": name} | parse_record(data, at) for at in chain[i : i + 2000]], schema=schema)


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = content.as_buffer().to_pybytes()
            start, following = links(data)
            on = reachable(start, following)
            row = {"file": name, "records": int(on.sum()), "rejected": int((~on).sum()), "reached": int(following[on].max(initial=0)), "bytes": len(data)}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("file", pa.string()), *((c, pa.int64()) for c in list(row)[1:])]))


def reachable(start: np.ndarray, following: np.ndarray, roots: tuple[int, ...] = (0,)) -> np.ndarray:
    """Which places the chains from ``roots`` visit, by pointer jumping.

    Round k marks what lies 2^k steps behind a marked place and doubles every pointer, so the
    number of rounds is the logarithm of the longest chain.
    """
    order = np.argsort(start, kind="stable")
    places = start[order]
    n = len(places)
    if not n:
        return np.zeros(0, bool)
    at = np.searchsorted(places, following[order])
    hit = (at < n) & (places[np.minimum(at, n - 1)] == following[order])
    jump = np.append(np.where(hit, at, n), n)  # n: past the end
    marked = np.append(np.isin(places, roots), False)
    while (jump[marked] != n).any():
        marked[jump[marked]] = True
        marked[n] = False
        jump = jump[jump]
    out = np.zeros(n, bool)
    out[order] = marked[:n]
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``, chain-verified, one row each.

    A file that does not begin with a record yields nothing; after a damaged record the rest of its
    file is not reached: ``reached`` tells of both. Members compressed by gzip are not opened.
    """
    return _files(spark, path).mapInArrow(_records, RECORD)


def reached(spark: SparkSession, path: str) -> DataFrame:
    """(file, records, rejected, reached, bytes): how far each file's chain goes.

    ``rejected`` places look like records and are not on the chain; a file is whole if ``reached`` equals ``bytes``.
    """
    return _files(spark, path).mapInArrow(_reached, "file string, records long, rejected long, reached long, bytes long")

"""WARC: revisit resolution, archive writing and reading.

Headers (id, digest, length) are shuffled by payload digest; of the records that share a payload of at least
``min_bytes`` bytes the one with the largest id stays a response, the others become revisits that refer to it.
Payloads are shuffled once, by record id, to meet their headers. Archives are written by Spark's own writer
(``lineSep`` ends a record with CRLF CRLF), so tasks can be lost and run again, and are gzipped WARC/1.1. They
are read back record by record by their Content-Length.

Null payloads are empty. Records below ``min_bytes`` are all responses. Where several rows share both payload
and the largest id, all of them are responses. A null id counts as smaller than any other; if all ids of a
payload are null, all rows are responses. Extra columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm.common import materialise, shared_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_bytes long, payload string"


def resolve_revisits(records: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``records`` (id, url, payload) with payload_bytes, payload_digest, record_type and refers_to."""
    headed = records.select("id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    headed = headed.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.encode("payload", "UTF-8")))
    heads = headed.where(F.col("payload_bytes") >= min_bytes).select("id", "payload_digest")
    # Only payloads that occur again leave this aggregate; it is combined before the shuffle, so one payload may hold any share of the rows.
    originals = heads.groupBy("payload_digest").agg(F.max("id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").drop("n")
    revisits = (
        heads.join(originals, "payload_digest").where(F.col("id").isNull() | (F.col("id") < F.col("original")))
        .groupBy(F.col("id").alias("r_id"), F.col("payload_digest").alias("r_digest")).agg(F.first("original").alias("refers_to"))
    )
    on = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest"))
    return headed.join(revisits, on, "left").select(
        "id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to",
    )


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record_id(page_id: Column, kind: Column, digest: Column) -> Column:
    h = F.sha1(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), kind, digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(h, 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def warc_record(date: str = "2024-01-01T00:00:00Z") -> Column:
    """The text of one record, without the CRLF CRLF after it, from the columns of ``resolve_revisits``."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", _record_id(F.col("id"), F.col("record_type"), F.col("payload_digest"))),
        _field("WARC-Date", F.lit(date)),
        # base64 keeps any url whole, whatever control characters it holds
        F.coalesce(_field("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")), F.lit("")),
        F.coalesce(_field("X-Source-Url-Base64", F.translate(F.base64(F.encode("url", "UTF-8")), "\r\n", "")), F.lit("")),
        F.coalesce(_field("X-Page-Id", F.col("id").cast("string")), F.lit("")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            _field("WARC-Profile", F.lit(PROFILE)),
            _field("WARC-Refers-To", _record_id(F.col("refers_to"), F.lit("response"), F.col("payload_digest"))),
            _field("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        )).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, block)


def write_warc(resolved: DataFrame, path: str, records_per_file: int = 5_000) -> None:
    """Writes archives under ``path``. A file is what one task reads back, so files are kept small by the task's share and ``records_per_file``."""
    text = resolved.select(warc_record().alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and block of each record of an archive."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield head, view[start:stop]
        at = stop + 4


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_bytes", pa.int64()), ("payload", pa.string())]
        for b in batches:
            for content in b.column("content"):
                rows: list[tuple] = []
                data = bytes(content.as_buffer())
                for head, block in parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    whole = bytes(block)
                    http, _, payload = whole.partition(b"\r\n\r\n")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
                    url = base64.b64decode(head["X-Source-Url-Base64"]).decode() if "X-Source-Url-Base64" in head else None
                    rows.append((
                        int(head["X-Page-Id"]) if "X-Page-Id" in head else None, url, head["WARC-Type"],
                        int(head["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in head else None,
                        size, digest, len(whole), payload.decode() if with_payload and head["WARC-Type"] == "response" else None,
                    ))
                for k in range(0, len(rows), 2000):
                    part = rows[k : k + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record of the archives under ``path``; each file is read whole by one task, response payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read(with_payload), READ_SCHEMA)


def deduplicated_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> str:
    """Writes ``pages`` as deduplicated archives to a new shared folder and returns its path."""
    records = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    path = shared_dir(pages.sparkSession, "warc")
    write_warc(resolve_revisits(records, min_bytes), path)
    return path


def restore_payloads(records: DataFrame) -> DataFrame:
    """Gives revisits the payload of the response they refer to (the archive's round trip)."""
    responses = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload").alias("original"))
    return records.join(responses, ["refers_to", "payload_digest"], "left").withColumn("payload", F.coalesce("payload", "original")).drop("original")

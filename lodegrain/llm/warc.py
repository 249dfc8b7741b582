"""WARC archives without repeated payloads.

Only headers (payload digest, id, size) are shuffled to find equal payloads; payloads that occur once
never move. Every record is then written with fresh headers: the record of the largest id of a group
of equal payloads as response, the others as revisits that refer to it.

Archives are written by Spark's text writer, whose line separator is the end of a WARC record, so any
file system that Spark writes to will do. Compressed files hold all their records in one gzip member,
and are read whole, so they are cut by bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, small_join

END = "\r\n\r\n"
#: Bytes of payloads in a file, about, and the bounds of the classes of sizes that are written apart.
FILE_BYTES, SIZES = 64 << 20, (32 << 10, 1 << 20, 64 << 20)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _headed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )


def resolve_revisits(pages: DataFrame, scratch: Scratch, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, and refers_to: the response's id for revisits, else null.

    Null html counts as empty, a null page_id as lower than any other. Rows that tie on the largest
    page_id are all responses, as are all rows of a group without any page_id.
    """
    rows = _headed(pages)
    groups = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).filter("n > 1 and keeper is not null")
    groups = scratch.keep(groups.select("digest", "keeper"), "groups")
    # 48 bytes a group of equal payloads; beyond 200,000 groups pages and groups are joined by shuffle
    found = small_join(rows, groups, ["digest"], "left", groups.count())
    is_revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return found.withColumn("refers_to", F.when(is_revisit, F.col("keeper"))).drop("keeper")


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def record_text(date: str) -> Column:
    """A WARC record without the two line ends that close it, from the columns of resolve_revisits."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.coalesce(_id(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", _id(F.col("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit("\r\n"), block)


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 2000, compress: bool = True, file_bytes: int = FILE_BYTES) -> None:
    """Write pages (page_id, url, html) as deduplicated WARC files below path, which must not exist.

    A file holds records_per_file records and about file_bytes bytes at most, or one record: pages of
    like size are written together. Null html is an empty payload;
    records of a null page_id have ids of their own. Repeated rows are records each. Other columns of
    pages are not read; an empty table gives no record.
    """
    scratch = Scratch(pages.sparkSession, "warc-headers")
    rows = resolve_revisits(pages, scratch)
    biggest = _headed(pages).agg(F.coalesce(F.max("payload_bytes"), F.lit(0))).first()[0]
    for low, high in zip((0, *SIZES), (*SIZES, None)):
        if low > biggest:
            break
        own = rows.filter((F.col("payload_bytes") >= low) & (F.lit(True) if high is None else F.col("payload_bytes") < high))
        most = min(records_per_file, max(1, file_bytes // high)) if high else 1
        writer = own.select(record_text(date).alias("value")).write.mode("append" if low else "error").option("lineSep", END).option("maxRecordsPerFile", most)
        writer.option("compression", "gzip" if compress else "none").text(path)
    scratch.release()


def _inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        z = zlib.decompressobj(31)
        for i in range(0, len(data), step):
            if out := z.decompress(data[i : i + step]):
                yield out
            if z.eof:
                data = z.unused_data + data[i + step :]
                break
        else:
            return


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file; holds one record at a time."""
    source, buffer = _inflate(data), bytearray()

    def more() -> bool:
        chunk = next(source, None)
        if chunk is not None:
            buffer.extend(chunk)
        return chunk is not None

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        lines = bytes(buffer[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        while len(buffer) < stop + 4:
            if not more():
                raise ValueError("the last record is cut off")
        block = bytes(buffer[end + 4 : stop])
        del buffer[: stop + 4]
        yield head, block


def _described(head: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(x[10:-1]) if (x := head.get(name, "")).startswith("<urn:page:") else None
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    else:
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
    return number("warc-record-id"), size, digest, head["warc-type"], number("warc-refers-to")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for content in batch.column(0):
            for head, block in records(content.as_py()):
                rows.append(_described(head, block))
                if len(rows) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives below path; a response whose payload lacks its digest raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return map_arrow(files.select("content"), _read, SCHEMA)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'warc').root}/archives"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path)

"""WARC archives: revisits resolved by payload digest, archives written with fresh headers and read back.

Only headers are shuffled by digest.  Payloads stay where they are read, unless
there are more revisits than may be broadcast; then those of revisit size are
shuffled once.

An archive has a gzip member for each record, so that records can be read one
by one, and holds about ``ARCHIVE_BYTES``.  It is packed in a task and written
by Spark's own writer as a row of its own, so archives can lie wherever Spark
can write, and a lost task leaves no half-written file.  The writer ends a row
with a separator; here that is an empty gzip member.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, join_few

MIN_REVISIT_BYTES = 1000  # smaller payloads are never revisits
ARCHIVE_BYTES = 16 << 20  # compressed
PIECE = 1 << 16  # compressed bytes looked at in one step
BROADCAST_REVISITS = 200_000  # some 80 bytes each; more are joined by a shuffle of the payloads of revisit size
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HEADER = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, target_uri string"


def resolve(pages: DataFrame, html: str = "html", id_column: str = "page_id", url: str = "url", min_bytes: int = MIN_REVISIT_BYTES, broadcast_rows: int = BROADCAST_REVISITS) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to for every row.

    Of equal payloads of ``min_bytes`` or more, rows with the largest page_id
    are responses and the others revisit it; all smaller ones are responses.  A
    null html is an empty payload.  A row without page_id revisits like any
    other, but leads only where all its copies lack one; repeated rows that
    lead are all responses.  Other columns, whatever their names, aren't looked
    at; no pages give no records.  Up to ``broadcast_rows`` revisits go to all tasks.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    records = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.col("payload").cast("binary")).alias("payload_digest")
    )
    large = F.col("payload_bytes") >= min_bytes
    headers = cut(records.where(large).select("page_id", F.unhex("payload_digest").alias("digest")), "warc-digests")
    first = cut(headers.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"), "warc-originals")
    revisits = join_few(headers, first, ["digest"], ["page_id"]).where(~F.col("first").eqNullSafe(F.col("page_id"))).distinct()
    revisits = cut(revisits.select(F.col("page_id").alias("id"), F.lower(F.hex("digest")).alias("of"), "first"), "warc-revisits")
    same = records["page_id"].eqNullSafe(revisits["id"]) & (records["payload_digest"] == revisits["of"])
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("first").alias("refers_to")]
    if revisits.count() <= broadcast_rows:
        return records.join(F.broadcast(revisits), same & large, "left").select(*columns)
    met = records.where(large).join(revisits.hint("shuffle_merge"), same, "left").select(*columns)
    small = records.where(~large).select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return met.union(small)


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def record_text(date: str = DATE) -> Column:
    """A whole record, without the two line ends that close it, from the columns of ``resolve``."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    response = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(response, F.concat(http, F.col("payload"))).otherwise(http)
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uri(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(response, F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _uri(F.col("refers_to"))))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(resolved: DataFrame, path: str, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the records as archives in the folder ``path``, which all executors see.

    An archive is closed once it holds ``archive_bytes``, so it is larger by one record at most.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        archive = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
        for batch in batches:
            for record in batch.column(0):
                held.append(gzip.compress(record.as_buffer().to_pybytes() + b"\r\n\r\n", mtime=0))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    archives = resolved.select(record_text(date).cast("binary").alias("record")).mapInArrow(packed, "archive binary").select(F.col("archive").cast("string").alias("value"))
    separator = gzip.compress(b"", mtime=0).decode("latin-1")
    archives.write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", 1).text(path)


def members(data: memoryview) -> Iterator[bytes]:
    """What each member of a gzip file holds, one at a time."""
    at = 0
    while at < len(data):
        stream, held = zlib.decompressobj(31), []
        while not stream.eof:
            piece = data[at : at + PIECE]
            if not len(piece):
                raise ValueError("an archive ends within a record")
            held.append(stream.decompress(piece))
            at += len(piece) - len(stream.unused_data)
        yield b"".join(held)


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("an archive ends within a record")
        yield fields, block


def _page(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all records in ``path``; a response's digest and size are those of the payload read.

    A response whose payload doesn't have the digest in its header is an error.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _HEADER.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for member in members(memoryview(content.as_buffer())):
                    for fields, block in records(io.BytesIO(member)):
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        size = None
                        if fields["warc-type"] == "response":
                            payload = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
                            size = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have its digest")
                        rows.append((_page(fields["warc-record-id"]), fields["warc-type"], digest, size, _page(fields.get("warc-refers-to")), fields.get("warc-target-uri")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, _HEADER)


def join_revisits(headers: DataFrame) -> DataFrame:
    """The headers, with each revisit's payload_bytes taken from the response that it refers to."""
    revisits = headers.where("record_type = 'revisit'")
    wanted = revisits.groupBy("payload_digest").agg(F.count("*").alias("n"))
    originals = headers.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("bytes"))
    found = join_few(revisits, cut(wanted.join(originals, "payload_digest", "left"), "warc-sizes"), ["payload_digest"], ["page_id"], "left")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return headers.where("record_type <> 'revisit'").select(*columns).union(found.select("page_id", F.col("bytes"), *columns[2:]))


def rewrite(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` to deduplicated archives in ``path`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    write_archives(resolve(pages), path)
    return join_revisits(cut(read_archives(pages.sparkSession, path), "warc-headers"))

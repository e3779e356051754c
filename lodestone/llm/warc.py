"""Operator 6, WARC writing and a splittable reader.

Writing: every page becomes one gzip member, a response record or, where an earlier page has the same payload, a
revisit record that refers to it. A task writes its partition to one file in the shared folder under a name of its own;
only files that finished tasks report are read.

Reading: files are cut into byte ranges. A task looks for gzip magic in its range, takes a candidate for a member
only if it inflates to a WARC version line and header block (and, at the first, if what follows it is the file's end
or another such member), and owns the records whose members start inside its range; the last may end beyond it. A damaged or cut
member is an error, not a gap: members must follow one another to the file's end, and the records read are counted
against those written.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_path, materialize, table

LEAST_REVISIT = 100
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
LEVEL = 3
MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def planned(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses) of every row of pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    first = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    known = rows.join(first, "digest", "left")
    return known.select("page_id", "url", "html", "digest", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    name = "none" if page_id is None else str(page_id)
    body = HTTP + (html.encode() if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        *([] if url is None else [f"WARC-Target-URI: {' '.join(url.split())}"]),
        "WARC-Date: 2024-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        f"Content-Length: {len(body)}",
    ]
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + deflate.flush()


def write_warc(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html) to folder; return path, bytes, records of the files. Null html is an empty payload.

    Payloads of at least `least` bytes that are equal are stored once, under the smallest page_id; rows that repeat
    that id are responses too, rows without an id revisit it. An empty table gives no file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, records = None, 0, 0
        files, at = pafs.FileSystem.from_uri(folder)
        path = f"{at}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    files.create_dir(at, recursive=True)
                    out = files.open_output_stream(path, compression=None)
                size += out.write(member := record(*row)) or len(member)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([files.get_file_info(path).size]), pa.array([records])], ["path", "bytes", "records"])

    return materialize(planned(pages, least).mapInArrow(write, "path string, bytes long, records long"), "warc-files")


class Damaged(ValueError):
    """A file whose members don't follow one another to its end."""


class Members:
    """Walks the gzip members of a file from a byte position on."""

    def __init__(self, file: pa.NativeFile, size: int) -> None:
        self.file, self.size = file, size

    def at(self, start: int) -> tuple[bytes, int] | None:
        """(content, end) of the member that starts at start, or None if there is no WARC record."""
        inflate, content, position = zlib.decompressobj(31), [], start
        known = 0
        try:
            while not inflate.eof:
                self.file.seek(position)
                data = self.file.read(READ_BYTES if position > start else 1 << 14)
                if not data:
                    return None
                content.append(inflate.decompress(data))
                known += len(content[-1])
                position += len(data)
                if known >= 8 and not (b"".join(content) if len(content) > 1 and len(content[0]) < 8 else content[0]).startswith(b"WARC/1."):
                    return None
        except zlib.error:
            return None
        whole = b"".join(content)
        if not whole.startswith(b"WARC/1.") or b"\r\n\r\n" not in whole:
            return None
        return whole, position - len(inflate.unused_data)

    def begins(self, start: int) -> bool:
        """Whether a member that opens with a WARC version line starts at start; reads its first bytes only."""
        self.file.seek(start)
        try:
            return zlib.decompressobj(31).decompress(self.file.read(1 << 12), 64).startswith(b"WARC/1.")
        except zlib.error:
            return False

    def owned(self, start: int, end: int, strict: bool = False) -> Iterator[bytes]:
        """The members that start in the range. strict: raise Damaged where none follows on the last, or one can't be read."""
        if strict and start == 0 and self.size and not self.begins(0):
            raise Damaged("no WARC record at the file's start")
        position = self.first(start, end, strict)
        while position is not None and position < end:
            found = self.at(position)
            if found is None:
                if strict:
                    raise Damaged(f"the record at byte {position} can't be read")
                position = self.first(position + 1, end)
                continue
            yield found[0]
            position = found[1]
            if strict and position < self.size and not self.begins(position):
                raise Damaged(f"no WARC record at byte {position}")

    def first(self, start: int, end: int, strict: bool = False) -> int | None:
        """The first member that starts in the range. strict: raise Damaged if one begins but can't be read to its end."""
        position, tail = start, b""
        while position < end:
            self.file.seek(position)
            data = self.file.read(min(READ_BYTES, self.size - position))
            if not data:
                return None
            at = data.find(MAGIC)
            while at >= 0 and position + at < end:
                found = self.at(position + at) if self.begins(position + at) else None
                if strict and found is None and self.begins(position + at):
                    raise Damaged(f"the record at byte {position + at} can't be read")
                if found and (found[1] >= self.size or self.begins(found[1])):
                    return position + at
                at = data.find(MAGIC, at + 1)
            position += max(1, len(data) - len(MAGIC) + 1) if position + len(data) < self.size else len(data)
        return None


def parsed(content: bytes) -> tuple:
    """page_id, url, type, refers_to, digest, bytes, payload of a record; for a revisit the last two are None."""
    head, _, body = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    page = lambda x: None if x is None or x == "<urn:page:none>" else int(x[10:-1])
    name, url, refers = page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), page(fields.get("WARC-Refers-To"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "revisit":
        return name, url, "revisit", refers, digest, None, None
    payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    if (found := hashlib.sha256(payload).hexdigest()) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} has digest {found}, not {digest}")
    return name, url, "response", None, digest, len(payload), payload


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES, strict: bool = True) -> DataFrame:
    """The records of files (path, bytes), as in RECORDS. A revisit has no payload of its own.

    A damaged or cut member fails the read; with strict off it is left out and the reader goes on at the next.
    """
    spark = files.sparkSession
    root = files.select("path", "bytes")
    ranges = root.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    shared = fresh_path(spark, "x")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(shared)
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as file:
                    kept, held = [], 0
                    for content in Members(file, size).owned(start, min(size, start + range_bytes), strict):
                        kept.append(parsed(content))
                        held += len(content)
                        if held >= READ_BYTES * 4:
                            yield as_batch(kept)
                            kept, held = [], 0
                    if kept:
                        yield as_batch(kept)

    return ranges.mapInArrow(read, RECORDS)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload size of what they refer to."""
    sizes = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("size"))
    joined = records.join(sizes, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("digest")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    records = materialize(read_warc(files).drop("payload", "url"), "warc-records")
    written, read = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], records.count()
    if written != read:
        raise Damaged(f"{written} records were written and {read} read")
    return resolved(records)


QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
             min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM d"""
}

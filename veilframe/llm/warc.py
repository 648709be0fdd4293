"""WARC archives: writing, normalising monolithic gzip files, and reading them back.

1. ``write_archives``: one record per page, written by Spark's text writer. A record's closing
   blank lines are the line separator, and a file is one gzip stream over all its records.
2. ``normalise``: every such stream is inflated once, by Spark's text reader, which hands it on
   piece by piece; each record becomes a gzip member of its own, and a sidecar index gets every
   member's offset and length. A stream of any length becomes archives of bounded size.
3. ``read_archives``: members are found, parsed and checked against their digests, and their
   places against the index.

Everything is written through Spark into the given folder, so any store will do, and a lost
task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import materialise
from veilframe.session import shared_dir

#: Documented parameters: records of a stream at most, and of streams with larger pages: up to
#: SMALL_PAGE bytes, FEWER times that, and so on, each with FEWER times fewer records; bytes of a
#: normalised archive beyond its last record; equal payloads from this size on are revisits; and the
#: level of the members.
RECORDS_PER_ARCHIVE = 2_000
SMALL_PAGE, FEWER, SIZE_CLASSES = 1 << 16, 16, 4
ARCHIVE_BYTES = 1 << 26
MIN_REVISIT_BYTES = 0
LEVEL = 6
#: Digests of repeated payloads are broadcast up to this count (about 8 MB).
BROADCAST_DIGESTS = 100_000
END = "\r\n\r\n"
CHUNK = 1 << 16


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as upper-case base32 without a prefix: five hex digits are four base32 digits."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        F.md5(F.concat(F.lit("page "), page_id.cast("string")).cast("binary")),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One text ``record``, and the ``size`` of the payload, per row of ``pages(page_id, url, html)``;
    without the record's end.

    Of equal payloads of at least MIN_REVISIT_BYTES the largest page_id is the response; a
    row that repeats this id is one, too. Null html is an empty payload, a null url an empty
    target; blanks and control characters of a url are escaped.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn(
        "size", F.octet_length("html").cast("long"))
    repeated = materialise(
        rows.filter(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest", "size")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
        .select(F.col("digest").alias("r_digest"), F.col("size").alias("r_size"), "first_id"))
    small = repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(repeated) if small else repeated,
                     (F.col("digest") == F.col("r_digest")) & (F.col("size") == F.col("r_size")),
                     "left")
    revisit = F.col("r_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(_urn(F.col("page_id")), F.lit("<urn:page:none>"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20\\x7f]+", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"),
            line("WARC-Refers-To", _urn(F.col("first_id"))),
            line("X-Refers-To-Page", F.col("first_id").cast("string")))).otherwise(""),
        F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return rows.select(F.concat(head, block).alias("record"), "size")


def size_class(size: Column) -> Column:
    """0 for pages up to SMALL_PAGE bytes, and one more for each step of FEWER."""
    limits = [SMALL_PAGE * FEWER ** k for k in range(SIZE_CLASSES - 1)]
    return sum(((F.coalesce(size, F.lit(0)) > limit).cast("int") for limit in limits), F.lit(0))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Archives of at most RECORDS_PER_ARCHIVE records, each one gzip stream, below ``folder``.

    Larger pages go to streams of fewer records (see SMALL_PAGE), so a stream of several records
    is bounded in bytes, too.
    """
    found = pages.select(size_class(F.octet_length("html")).alias("k")).distinct().collect()
    made = records(pages)
    for k in sorted(r["k"] for r in found) or [0]:
        (made.filter(size_class(F.col("size")) == k).select("record")
         .write.option("lineSep", END).option("compression", "gzip")
         .option("maxRecordsPerFile", max(RECORDS_PER_ARCHIVE // FEWER ** k, 1))
         .text(f"{folder}/size={k}"))


def split_stream(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a WARC byte stream, each with its end; only one is held at a time."""
    buffer = bytearray()
    need = None
    end = END.encode()
    for piece in pieces:
        buffer += piece
        while True:
            if need is None:
                at = buffer.find(end)
                if at < 0:
                    break
                need = at + len(end) + int(header(bytes(buffer[:at]))["content-length"]) + len(end)
            if len(buffer) < need:
                break
            if buffer[need - len(end):need] != end:
                raise ValueError("a record does not end where its length says")
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("the archive ends inside a record")


def header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.split(":", 1) for line in lines[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def member(record: bytes) -> bytes:
    stream = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return stream.compress(record) + stream.flush()


def _warcinfo(name: str) -> bytes:
    body = f"software: veilframe\r\nformat: WARC File Format 1.0\r\nfilename: {name}\r\n".encode()
    urn = uuid.uuid5(uuid.NAMESPACE_URL, name)
    return (f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{urn}>\r\n"
            f"WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Filename: {name}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
            ).encode() + body + END.encode()


def rewrite(name: str, pieces: Iterator[bytes], most: int) -> Iterator[tuple[str, bytes, str]]:
    """Archives made of members, from the pieces of one stream: name, content and index.

    The index gives offset, length, type and id per line. An archive is handed on once it has
    ``most`` bytes, so never more than that and a record is held.
    """
    out, index, number = bytearray(), [], 0
    for record in split_stream(pieces):
        if not index:
            own = f"{name}-{number:05d}"
            out = bytearray(member(_warcinfo(own)))
        head = header(record[:record.find(END.encode())])
        part = member(record)
        index.append(f"{len(out)}\t{len(part)}\t{head['warc-type']}\t{head['warc-record-id']}\n")
        out += part
        if len(out) >= most:
            yield own, bytes(out), "".join(index)
            index, number = [], number + 1
    if index:
        yield own, bytes(out), "".join(index)


def normalise(spark: SparkSession, source: str, folder: str, most: int = ARCHIVE_BYTES) -> None:
    """Rewrite the streams in ``source`` to ``folder/archive=NAME/kind=warc`` with sidecars in
    ``kind=index``.

    A gzip file is not split, so one task reads its records in their order. The text reader takes
    the bytes between two ends of records as a line and leaves them as they are, in any encoding.

    A gzip member ends with the high byte of its length, which is zero for records below
    16 MiB; where it is not, an empty member follows. So every archive ends with a zero
    byte, and that is the writer's line separator.
    """
    def run(batches):
        def lines():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1), strict=True)

        for path, of_file in groupby(lines(), lambda line: line[0]):
            stem = path.rsplit("/", 1)[1].split(".")[0]
            pieces = (value.as_py() + END.encode() for _, value in of_file)
            for name, data, index in rewrite(stem, pieces, most):
                data = data if data.endswith(b"\x00") else data + member(b"")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * 2), pa.array(["warc", "index"]),
                     pa.array([data[:-1], index.encode()], pa.binary())],
                    names=["archive", "kind", "data"])

    files = (spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz")
             .option("recursiveFileLookup", "true").text(source))
    done = files.select(F.col("_metadata.file_path").alias("path"),
                        F.col("value").cast("binary").alias("piece")).mapInArrow(
        run, "archive string, kind string, data binary")
    (done.select("archive", "kind", F.col("data").cast("string").alias("value"))
     .write.partitionBy("archive", "kind").option("lineSep", "\x00").text(folder))


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member; empty ones are padding."""
    at = 0
    while at < len(data):
        stream = zlib.decompressobj(31)
        out, begin = bytearray(), at
        while not stream.eof:
            if at >= len(data):
                raise ValueError("the last member is cut off")
            step = data[at:at + CHUNK]
            out += stream.decompress(step)
            at += len(step)
        at -= len(stream.unused_data)
        if out:
            yield begin, at - begin, bytes(out)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header and HTTP payload of a record."""
    split = record.find(END.encode())
    head = header(record[:split])
    block = record[split + 4:split + 4 + int(head["content-length"])]
    return head, block[block.find(END.encode()) + 4:]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to,
    and whether the sidecar index has the record at its place."""
    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
                 pa.string(), pa.int64()]
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for offset, length, record in members(content.as_py()):
                    head, payload = parse(record)
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    size = int(head["x-payload-length"])
                    if head["warc-type"] == "response":
                        size = len(payload)
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != digest:
                            raise ValueError(f"digest of the record at {offset} does not hold")
                    rows.append((archive.as_py(), offset, length,
                                 int(head["x-page-id"]) if "x-page-id" in head else None, size,
                                 digest, head["warc-type"],
                                 int(head["x-refers-to-page"]) if "x-refers-to-page" in head else None))
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    names=["archive", "offset", "length", "page_id", "payload_bytes",
                           "payload_digest", "record_type", "refers_to"])

    files = (spark.read.format("binaryFile")
             .schema("path string, modificationTime timestamp, length bigint, content binary, "
                     "archive string, kind string").load(folder))
    found = files.filter("kind = 'warc'").select("archive", "content").mapInArrow(
        run, "archive string, offset bigint, length bigint, page_id bigint, payload_bytes bigint, "
             "payload_digest string, record_type string, refers_to bigint")
    index = (spark.read.schema("value string, archive string, kind string").text(folder)
             .filter("kind = 'index'").withColumn("at", F.split(F.rtrim("value"), "\t"))
             .filter(F.size("at") >= 4)
             .select(F.col("archive").alias("i_archive"),
                     F.col("at")[0].cast("long").alias("i_offset"),
                     F.col("at")[1].cast("long").alias("i_length")))
    joined = found.join(index, (F.col("archive") == F.col("i_archive"))
                        & (F.col("offset") == F.col("i_offset")), "left")
    return joined.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive",
        "offset", (F.col("i_length").isNotNull() & (F.col("i_length") == F.col("length"))).alias("indexed"))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages``, normalise the archives and read them back from a folder (a new one
    in the shared folder by default). An empty table gives an empty result."""
    spark = pages.sparkSession
    base = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{base}/streams")
    if pages.limit(1).count() == 0:
        return spark.createDataFrame(
            [], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
                "refers_to bigint, archive string, offset bigint, indexed boolean")
    normalise(spark, f"{base}/streams", f"{base}/members")
    return read_archives(spark, f"{base}/members")


def _base32(h: str) -> str:
    """SQL of 40 hexadecimal digits in base 32: five digits give four characters."""
    parts = []
    for k in range(8):
        number = f"CAST('0x' || substr({h}, {5 * k + 1}, 5) AS BIGINT)"
        parts += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({number} // {32 ** e} % 32 AS INTEGER) + 1, 1)"
                  for e in (3, 2, 1, 0)]
    return " || ".join(parts)


#: The same rows for DuckDB; every record is at its place in the index.
SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY n, h) AS kept FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_base32('h')} AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to, true AS indexed
FROM g"""

"""WARC archives: records in gzip members, revisits of equal payloads, and a reader that salvages damaged files.

A file is a sequence of gzip members, a record each. Spark's text writer makes the files, so they are committed once and
may lie in any file system: a member ends with the high byte of its length, which is 0, so each row is a member without
that byte and the line separator is that byte.

The reader checks every member (gzip checksum, version line, Content-Length, payload digest). After a failed check it
searches for the next place from which a record can be read whole, gzip member or bare version line, goes on there, and
logs the bytes between as a gap.

Every record has the same WARC-Date, a parameter, so that equal pages make equal archives.

Cases: null and empty html have an empty payload; payloads under `least` bytes are never revisits; rows equal in page_id
and payload get equal records; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small_batches, staged

VERSION = b"WARC/1.0\r\n"
#: Payloads of fewer bytes are always responses.
LEAST_BYTES = 100
#: Rows of a file at most, and bytes of html that a file gets on average.
FILE_ROWS, FILE_BYTES = 20_000, 24 << 20
#: The level of the gzip members.
LEVEL = 3
SALTS = 16
#: Bytes that the reader hands to the decompressor at once; what it has read beyond a member's end is at most this.
SLICE = 1 << 14
DATE = "2000-01-01T00:00:00Z"


def encode_record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    lines = [*headers, ("Content-Length", str(len(payload)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + payload + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A member whose last byte is 0: one of 16 MiB or more, whose length would not end so, is followed by an empty one."""
    pack = lambda x: (c := zlib.compressobj(LEVEL, zlib.DEFLATED, 31)).compress(x) + c.flush()
    member = pack(data)
    return member if member[-1] == 0 else member + pack(b"")


def decide(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, payload_bytes, row, refers_to): refers_to is the response's page_id for revisits, else null.

    Groups of equal payloads are summed up map-side; only those of more than one row are joined back, salted."""
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    groups = keys.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(groups, ["digest", "salt"], "left")
    return found.select("page_id", "digest", "payload_bytes", "first")


def write_warc(pages: DataFrame, path: str, least: int = LEAST_BYTES, date: str = DATE) -> None:
    """Writes a record for every row of pages (page_id, url, html) under path, dealt to files by page_id."""
    spark = pages.sparkSession
    rows, size = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    files = max(1, -(-int(size) // FILE_BYTES), -(-rows // FILE_ROWS))
    bodies = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    bodies = bodies.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).repartition(files, "page_id", "digest")  # texts are shuffled once, into the files
    later = staged(decide(pages, least).where("first < page_id").groupBy("page_id", "digest").agg(F.min("first").alias("refers_to")), "revisits")
    if later.isEmpty():  # a join that the planner drops halfway would shuffle the texts again
        dealt = bodies.withColumn("refers_to", F.lit(None).cast("long"))
    else:
        dealt = bodies.join(later.hint("shuffle_hash"), ["page_id", "digest"], "left")
    dealt = dealt.select("page_id", "url", "digest", "html", "refers_to")

    def records(batches):
        for batch in batches:
            out = []
            for page_id, url, digest, html, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                body, number, first = html.as_py().encode("utf-8", "surrogatepass"), page_id.as_py(), refers_to.as_py()
                headers = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{number}>"), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url.as_py() or "")), ("WARC-Payload-Digest", f"sha256:{digest.as_py()}"), ("X-Payload-Length", str(len(body)))]
                if first is not None:
                    headers += [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
                    body = b""
                out.append(gzip_member(encode_record(headers, body))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    small_batches(spark)
    dealt.mapInArrow(records, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_ROWS).text(path)


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record that begins at `at`; ValueError if a check fails."""
    if not data.startswith(VERSION, at) or (end := data.find(b"\r\n\r\n", at)) < 0:
        raise ValueError("no version line or no end of the headers")
    try:
        headers = dict(x.split(": ", 1) for x in data[at + len(VERSION) : end].decode().split("\r\n"))
        length = int(headers["Content-Length"])
    except (KeyError, ValueError, UnicodeDecodeError) as error:
        raise ValueError("damaged headers") from error
    payload = data[end + 4 : end + 4 + length]
    if length < 0 or len(payload) != length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
        raise ValueError("damaged length")
    digest = headers.get("WARC-Payload-Digest", "")
    if headers.get("WARC-Type") != "revisit" and digest.startswith("sha256:") and digest[7:] != hashlib.sha256(payload).hexdigest():
        raise ValueError("damaged payload")
    return headers, payload, end + 8 + length


def inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """(plain bytes, end) of the gzip member that begins at `at`, None if it is damaged; reads little beyond it."""
    z, parts, view = zlib.decompressobj(31), [], memoryview(data)
    while not z.eof:
        if at >= len(data):
            return None
        try:
            parts.append(z.decompress(view[at : at + SLICE]))
        except zlib.error:
            return None
        at = min(at + SLICE, len(data))
    return b"".join(parts), at - len(z.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """(start, end, headers, payload) of every record that can be read whole; headers None for a quarantined gap."""

    def read(at: int):
        if data.startswith(b"\x1f\x8b\x08", at):
            member = inflate(data, at)
            if not member:
                return None
            plain, end = member
            if not plain:
                return end, None, b""  # an empty member carries nothing
            try:
                headers, payload, used = parse_record(plain)
            except ValueError:
                return None
            return (end, headers, payload) if used == len(plain) else None
        try:
            headers, payload, end = parse_record(data, at)
        except ValueError:
            return None
        return end, headers, payload

    mark, at, gap = re.compile(rb"\x1f\x8b\x08|WARC/1\.0\r\n"), 0, None
    while at < len(data):
        found = read(at)
        if found:
            if gap is not None:
                yield gap, at, None, data[gap:at]
                gap = None
            if found[1] is not None:
                yield at, found[0], found[1], found[2]
            at = found[0]
        else:
            gap = at if gap is None else gap
            following = mark.search(data, at + 1)
            at = following.start() if following else len(data)
    if gap is not None:
        yield gap, len(data), None, data[gap:]


RECORD = "file string, start long, end long, is_gap boolean, headers map<string,string>, payload binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every record and of every gap (is_gap; payload: its bytes); a file is read by one task and has a bounded size."""

    def parse(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for start, end, headers, payload in salvage(content.as_py()):
                    rows.append((file.as_py(), start, end, headers is None, list((headers or {}).items()), payload))
                    held += len(payload)
                    if held > 4 << 20:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds)

    small_batches(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content").mapInArrow(parse, RECORD)


def _batch(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "start", "end", "is_gap", "headers", "payload"])


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages into archives in the shared folder and reads them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)

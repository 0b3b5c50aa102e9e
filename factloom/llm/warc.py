"""WARC archives: a native sink, and a reader that verifies record boundaries as a chain.

Writing: one record a row as text with CRLF ends, by Spark's own committed writer.  Of rows with
equal payloads the one with the largest id is the response, the others revisit it.

Reading: a file is cut into ranges.  A task looks for record magic in its range and takes each
place with a readable header as a candidate with its successor, the offset just behind the record.
Candidates are followed inside their range; what is left is a pointer from each to where its chain
leaves the range.  Pointer jumping from each file's start then doubles the pointers' reach every
round and keeps what it meets: the one true entry of each range.  Magic inside payloads is never
reached.  A chain that stops before the end of its file is an error.

Cases: a null payload is empty; a null id is written as the highest UUID and read as null, and never
is what others revisit unless it stands alone; rows with the largest id of equal payloads are all
responses; a null url is written as a urn; control characters and blanks of a url become %XX;
payloads and headers of any length are taken whole; an empty table reads as no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.shared import discard, filesystem, saved

MAGIC = b"WARC/1.1\r\n"
RANGE = 8 << 20
#: Ranges that one task takes on a large input, one after the other.
TASK_RANGES = 16
#: What is read at first to find a header's end; longer ones are read on in growing steps.
HEADER = 64 << 10
#: Groups of equal payloads that are broadcast at most (some 100 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "ffffffff-ffff-8fff-8fff-ffffffffffff"


def base32(hex40: Column) -> Column:
    """Base32 of 40 hexadecimal digits."""
    digits = []
    for group in range(4):
        n = F.conv(F.substring(hex40, 10 * group + 1, 10), 16, 10).cast("long")
        digits += [F.lit(ALPHABET).substr((F.shiftright(n, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*digits)


def record_uuid(page_id: Column) -> Column:
    """A UUID of version 8 that holds a long."""
    h = F.lower(F.lpad(F.hex(page_id), 16, "0"))
    part = lambda a, n: F.substring(h, a, n)
    made = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-8"), part(16, 1), F.lit("00-000000000000"))
    return F.coalesce(made, F.lit(NO_ID))


def id_of(uuid: Column) -> Column:
    """The long that ``record_uuid`` has put into a UUID."""
    digits = F.concat(F.substring(uuid, 1, 8), F.substring(uuid, 10, 4), F.substring(uuid, 16, 3), F.substring(uuid, 21, 1))
    # conv gives an unsigned number; half by half it stays inside a long.
    high, low = (F.conv(F.substring(digits, a, 8), 16, 10).cast("long") for a in (1, 9))
    return F.when(uuid != NO_ID, F.shiftleft(high, 32).bitwiseOR(low))


def records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2000-01-01T00:00:00Z", min_bytes: int = 0) -> DataFrame:
    """(record) of every row: a whole WARC record but for its last CRLF."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")})
    same = rows.where(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes").agg(F.max("id").alias("first_id"), F.max_by("url", F.struct("id", "url")).alias("first_url"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n")
    same = saved(same, "equal-payloads")
    same = F.broadcast(same) if same.count() <= BROADCAST_ROWS else same
    rows = rows.join(same, ["sha1", "bytes"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))

    def uri(url: str, page_id: str) -> Column:
        safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
        return F.coalesce(safe, F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("none"))))

    end = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), end, end)
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    refers = F.concat(
        F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:uuid:"), record_uuid(F.col("first_id")), F.lit(">\r\nWARC-Refers-To-Target-URI: "), uri("first_url", "first_id"), F.lit(f"\r\nWARC-Refers-To-Date: {date}\r\n")
    )
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"),
        record_uuid(F.col("id")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        uri("url", "id"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        base32(F.col("sha1")),
        end,
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        end,
        end,
    )
    return rows.withColumn("block", block).select(F.concat(header, "block", end).alias("record"))


def write(df: DataFrame, folder: str, **options) -> None:
    """Archives of every row in ``folder``, one a partition."""
    records(df, **options).write.option("lineSep", "\r\n").option("compression", "none").text(folder)


_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", re.IGNORECASE)


def _header_end(file, data: bytes, base: int, at: int) -> tuple[bytes, int]:
    """(data, where the blank line behind ``at`` stands in it, or -1); data starts at ``base`` and is read on until there is one."""
    since, step = at, HEADER
    while (blank := data.find(b"\r\n\r\n", since)) < 0 and (more := _read(file, base + len(data), step)):
        since, step = max(at, len(data) - 3), 2 * step
        data += more
    return data, blank


def _candidates(file, begin: int, end: int) -> list[tuple[int, int]]:
    """(offset, where its chain leaves the range) of each candidate in [begin, end)."""
    data = _read(file, begin, end - begin + HEADER)
    found, at, blank, length = {}, data.find(MAGIC), -1, None
    while 0 <= at < end - begin:
        # Places before the same blank line share it, and the first length behind them.
        moved = blank < at
        if moved:
            data, blank = _header_end(file, data, begin, at)
            if blank < 0:
                break
        if moved or length and length.start() < at:
            length = _LENGTH.search(data, at, blank + 2)
        if length:
            found[begin + at] = begin + blank + 4 + int(length[1]) + 4
        at = data.find(MAGIC, at + 1)
    for offset in sorted(found, reverse=True):  # successors lie behind, so they are resolved already
        found[offset] = found.get(found[offset], found[offset])
    return list(found.items())


def _read(file, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def chain(ranges: DataFrame) -> DataFrame:
    """(path, entry) of each range's first record on the chain from its file's start."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as file:
                    found = _candidates(file, begin, end)
                if found:
                    at, leaves = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(at, pa.int64()), pa.array(leaves, pa.int64())], names=["path", "at", "leaves"])

    jumps = saved(ranges.select("path", "begin", "end").mapInArrow(find, "path string, at long, leaves long"), "jumps")
    met = ranges.where("begin = 0").select("path", F.lit(0).cast("long").alias("at"))
    met, known = saved(met, "met"), -1
    while (n := met.count()) > known:
        known = n
        before, met = met, saved(met.union(met.join(jumps, ["path", "at"]).select("path", F.col("leaves").alias("at"))).distinct(), "met")
        discard(before)
        further = jumps.select("path", F.col("at").alias("leaves"), F.col("leaves").alias("then"))
        before, jumps = jumps, saved(jumps.join(further, ["path", "leaves"], "left").select("path", "at", F.coalesce("then", "leaves").alias("leaves")), "jumps")
        discard(before)
    return met


RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("http_headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    pairs = (line.partition(b":") for line in lines if b":" in line)
    return list({k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs}.items())


def _walk(file, entry: int, end: int, size: int) -> Iterator[tuple[int, list, list, bytes]]:
    """The records of a chain from ``entry`` up to a range's end."""
    held, base, at = _read(file, entry, max(0, end - entry) + HEADER), entry, entry
    while at < end:
        blank = -1
        if held.startswith(MAGIC, at - base):
            held, blank = _header_end(file, held, base, at - base)
        length = _LENGTH.search(held, at - base, blank + 2) if blank >= 0 else None
        sizes = (blank + 4 - (at - base), int(length[1])) if length else None
        if sizes is None or at + sum(sizes) + 4 > size:
            raise ValueError(f"the chain of records breaks off at {at} of {size}")
        if at - base + sum(sizes) > len(held):
            held, base = _read(file, at, max(sum(sizes), end - at) + HEADER), at
        block_at = at - base + sizes[0]
        block = held[block_at : block_at + sizes[1]]
        head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        headers = _fields(held[at - base : block_at].split(b"\r\n")[1:])
        digest = dict(headers).get("warc-payload-digest", "")
        if dict(headers).get("warc-type") == "response" and digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise ValueError(f"the payload at {at} does not have the digest of its header")
        yield at, headers, _fields(head.split(b"\r\n")[1:]), payload
        at += sum(sizes) + 4


def read(spark: SparkSession, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """Every record of the archives in ``folder``: path, offset, headers (names in lower case), payload."""
    # The payload column isn't read here: this lists paths and lengths.
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("begin"))
    ranges = saved(ranges.withColumn("end", F.least("length", F.col("begin") + range_bytes)), "ranges")
    n, cores = ranges.count(), spark.sparkContext.defaultParallelism
    tasks = max(1, min(n, 4 * cores), -(-n // TASK_RANGES))
    ranges = ranges.repartition(tasks, "path", "begin")
    # The end of a file is met too; it is no entry.
    entries = chain(ranges).withColumn("begin", F.floor(F.col("at") / range_bytes).cast("long") * range_bytes)
    entries = entries.join(ranges, ["path", "begin"]).where("at < length").select("path", "at", "end", "length")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, entry, end, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as file:
                    held, weight = [], 0
                    for record in _walk(file, entry, end, size):
                        held.append((path, *record))
                        weight += len(record[3])
                        if weight > 4 << 20 or len(held) >= 1000:
                            yield _batch(held)
                            held, weight = [], 0
                    if held:
                        yield _batch(held)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        maps = pa.map_(pa.string(), pa.string())
        kinds = (pa.string(), pa.int64(), maps, maps, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORD.names)

    return entries.repartition(tasks, "path", "at").mapInArrow(walk, RECORD)


def pages(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of what ``read`` returns."""
    uuid = lambda name: F.regexp_extract(F.col("headers")[name], "urn:uuid:([0-9a-f-]+)", 1)
    kind = F.col("headers")["warc-type"]
    return found.select(
        id_of(uuid("warc-record-id")).alias("page_id"),
        F.when(kind == "response", F.octet_length("payload")).otherwise(F.col("http_headers")["content-length"].cast("long")).cast("long").alias("payload_bytes"),
        F.substring(F.col("headers")["warc-payload-digest"], 6, 32).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(kind == "revisit", id_of(uuid("warc-refers-to"))).alias("refers_to"),
    )


def _sql_base32() -> str:
    letters = [f"substr('{ALPHABET}', cast((cast('0x' || substr(h, {10 * g + 1}, 10) AS BIGINT) >> {35 - 5 * i}) & 31 AS BIGINT) + 1, 1)" for g in range(4) for i in range(8)]
    return reduce(lambda a, b: f"{a} || {b}", letters)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), d AS (SELECT page_id, sha1(t) AS h, strlen(t) AS n FROM p),
  m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS first_id FROM d)
SELECT page_id, cast(n AS BIGINT) AS payload_bytes, {_sql_base32()} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM m
"""

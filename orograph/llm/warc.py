"""Web archives: writing pages as WARC records, and reading them back from segments.

Archives are written by Spark's text writer, one record a line whose last line feed is the end of the record's closing blank
lines, so they can be in any store that Spark writes to. Files are compressed by gzip; reading takes plain ones too. A payload over ``segment_bytes`` is cut at character borders into a first record and
continuation records, which name the first one as their origin and are numbered from 1. A response's block is an HTTP message with chunked
transfer framing. Reading parses records by their Content-Length, groups the segments of one origin,
orders them by number, verifies the total length, and decodes the chunks.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored, text_of

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
SEGMENT_BYTES = 16 << 10
#: An archive file holds about as many bytes; files are read whole.
FILE_BYTES = 8 << 20
#: Records that a worker holds at once.
SLICE = 128
DATE = "2000-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = ["record_id", "record_type", "page_id", "uri", "digest", "refers_to", "origin", "segment", "total", "block"]


def record(fields: list[tuple[str, str]], block: str) -> str:
    """A record without the line feed that ends it."""
    size = ("Content-Length", str(len(block.encode())))
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, size]) + f"\r\n{block}\r\n\r"


def chunked(payload: str, size: int = 4096) -> str:
    """Chunked transfer framing; chunks are cut between characters, their sizes are in bytes."""
    parts = (payload[i : i + size] for i in range(0, len(payload), size))
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload within chunked framing; extensions of sizes and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError(f"a chunk at byte {at} doesn't end where its size says")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def segments(block: str, size: int) -> list[str]:
    """The block in parts of at most ``size`` bytes (one character at least), cut between characters."""
    data, at, out = block.encode(), 0, []
    while at < len(data):
        end = min(len(data), at + max(4, size))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end].decode())
        at = end
    return out or [""]


def _uri(text: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "about:blank")


def records(page_id, url, html: str, digest: str, keep, place: str, segment_bytes: int) -> Iterator[str]:
    """The records of one page: a revisit if ``keep`` names another row's payload, else a response and its continuations.

    ``place`` is the row's alone within the archive, so its records have ids of their own even where page_ids repeat or are null.
    """
    own = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(place.encode()).digest())}>"
    page = [] if page_id is None else [("X-Page-Id", str(page_id))]
    about = [*page, ("WARC-Target-URI", _uri(url)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if keep is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{keep}>")]
        yield record([*fields, *about, ("Content-Type", "application/http; msgtype=response")], http + "\r\n")
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n{chunked(html)}"
    parts = segments(block, segment_bytes)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *about, ("Content-Type", "application/http; msgtype=response")]
    yield record([*first, ("WARC-Segment-Number", "1")] if len(parts) > 1 else first, parts[0])
    total = len(block.encode())
    for n, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        if n == len(parts):
            fields.append(("WARC-Segment-Total-Length", str(total)))
        yield record(fields, part)


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write an archive of all pages below ``path``.

    Of payloads that are equal (by SHA-256) and have REVISIT_BYTES or more, that with the largest page_id is a response and the others are
    revisits. Rows with null ids are responses, as are all rows that repeat the largest id. Null html is an empty payload.
    """
    html = text_of(pages, "html")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"))
    size, exact = F.octet_length("html"), F.sha2("html", 256)
    keys = rows.where(size >= REVISIT_BYTES).groupBy(exact.alias("exact")).agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    keys = keys.where("n > 1").select("exact", "keep")
    told = rows.withColumn("exact", exact).join(keys, "exact", "left")
    told = told.select("page_id", "url", "html", F.sha1("html").alias("digest"), F.when(F.col("keep") != F.col("page_id"), F.col("keep")).alias("keep"))

    def run(batches):
        done, task = 0, TaskContext.get().partitionId()
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                out = []
                for row in zip(*(c.to_pylist() for c in b.slice(i, SLICE).columns), strict=True):
                    out += records(*row, f"{task}/{done}", segment_bytes)
                    done += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.large_string() if sum(map(len, out)) > 1 << 29 else pa.string())], ["value"])

    archive = told.mapInArrow(run, "value string")
    # A record has at most segment_bytes besides its head, so this bounds the bytes of a file.
    each = max(1, FILE_BYTES // (segment_bytes + 1024))
    archive.write.option("lineSep", "\n").option("maxRecordsPerFile", each).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive's bytes, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its Content-Length says")
        at = end + 8 + n
        own = head["warc-record-id"]
        yield {
            "record_id": own,
            "record_type": head["warc-type"],
            "page_id": head.get("x-page-id"),
            "uri": head.get("warc-target-uri"),
            "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "refers_to": (re.fullmatch(r"<urn:page:(.*)>", head.get("warc-refers-to", "")) or [None, None])[1],
            "origin": head.get("warc-segment-origin-id", own if "warc-segment-number" in head else None),
            "segment": int(head.get("warc-segment-number", 1)),
            "total": int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None,
            "block": block,
        }


_SCHEMA = "record_id string, record_type string, page_id string, uri string, digest string, refers_to string, origin string, segment int, total long, block binary"


def scan(files: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the archives in ``files`` (rows of binaryFile), segments apart.

    With ``payloads`` a record that is no segment has its payload as block, null for a revisit.
    """

    def told(r: dict) -> dict:
        return r | {"block": None if r["record_type"] == "revisit" else payload_of(r["block"])} if payloads and r["origin"] is None else r

    def run(batches):
        kinds = [pa.string()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                found = map(told, parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                while part := list(islice(found, SLICE)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in part], k) for f, k in zip(_FIELDS, kinds, strict=True)], _FIELDS)

    return files.select("content").mapInArrow(run, _SCHEMA)


def reassembled(found: DataFrame) -> DataFrame:
    """One row for each record that has segments: joined by number, their number and total length verified.

    Segments of one origin are one record's bytes, so a group is as large as a record. Fails where a segment is missing or a length is wrong.
    """
    parts = F.array_sort(F.collect_list(F.struct("segment", "block")))
    heads = [F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in _FIELDS[:6]]
    groups = found.where("origin is not null").groupBy("origin").agg(*heads, parts.alias("parts"), F.max("total").alias("total"), F.max("segment").alias("most"))
    # Concatenated through hexadecimal digits: aggregate() starts from a string, and binary parts may end inside a character.
    block = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    joined = groups.select(*_FIELDS[:6], block.alias("block"), "total", "most", F.size("parts").alias("n"), "origin")
    right = (F.col("n") == F.col("most")) & (F.octet_length("block") == F.col("total")) & F.col("record_id").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("segments of "), "origin", F.lit(" don't add up"))).cast("binary")
    return joined.select(*_FIELDS[:6], F.when(F.coalesce(right, F.lit(False)), F.col("block")).otherwise(wrong).alias("block"))


def read(spark, path: str) -> DataFrame:
    """(page_id string, uri, record_type, digest, refers_to, payload binary) of every record; a revisit's payload is null."""
    found = scan(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path), payloads=True)
    columns = ["page_id", "uri", "record_type", "digest", "refers_to"]
    fields = "page_id string, uri string, record_type string, digest string, refers_to string, payload binary"

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                payload = pa.array(map(payload_of, part.column(5).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:5], payload], [*columns, "payload"])

    whole = found.where("origin is null").select(*columns, F.col("block").alias("payload"))
    return whole.unionByName(reassembled(found).select(*columns, "block").mapInArrow(run, fields))


def round_trip(pages: DataFrame, path: str | None = None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write pages to archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is computed from the payload that was read, and must equal the one in its head; a revisit's length is that
    of the response it refers to. Null html is an empty payload, null urls become about:blank, null page_ids stay null. Rows
    that repeat have a record each. Other columns are not looked at. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, segment_bytes)
    kind = pages.schema["page_id"].dataType

    def as_id(c: str) -> Column:
        return F.col(c).cast(kind)

    # Stored, as both sides of the join below need it and it is small without the payloads.
    found = read(spark, path).select(
        as_id("page_id").alias("page_id"), F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"),
        F.col("digest").alias("payload_digest"), "record_type", as_id("refers_to").alias("refers_to"),
    )
    same = F.coalesce((F.col("record_type") == "revisit") | (F.col("sha1") == F.col("payload_digest")), F.lit(False))
    wrong = F.raise_error(F.lit("a payload's digest is not the recorded one"))
    found = stored(found.withColumn("payload_digest", F.when(same, F.col("payload_digest")).otherwise(wrong)), "warc-read")
    sizes = found.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("bytes").alias("_bytes"))
    joined = found.join(sizes, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.select("page_id", F.coalesce("bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH t AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     k AS (SELECT payload_digest, max(page_id) AS keep FROM t WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM t LEFT JOIN k USING (payload_digest)
"""

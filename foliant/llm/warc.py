"""WARC archives: writing with segments, deduplication and chunked framing; reading back by reassembly.

Writing. One record per page: an HTTP response whose body is framed in chunks, with its date and the
page's URL (`urn:page:<id>` where it has none). A record whose block is longer than `segment_bytes` is
cut into segments: the first keeps the record's type and has WARC-Segment-Number 1, the others are
continuation records that name the first one's id, and the last also gives the total length. Of
equal payloads of at least `min_revisit` bytes the one with the smallest page_id is written out, the
others are revisit records that name it (WARC-Refers-To, with its URL and date). Each record is a gzip
member of its own, so that a tool can seek to it. Spark's own text writer makes the files, so they land
wherever the session can write, with a bounded number of records in a file; a member's last byte, the
highest of its length and always 0, is the writer's line separator. Names end in .txt, as Spark gives them.

Reading. Files are parsed by each record's Content-Length; continuation segments are grouped by
origin id, ordered by number, their total length is verified, the HTTP framing is decoded chunk
by chunk, and the payload's digest is verified. Only segmented records are shuffled.

Cases: a null payload is empty; an empty page table gives archives without records and an empty
result; rows with equal page_id and payload are all the response; a null page_id is written without
an id and refers to, or is referred to as, null; payloads may hold anything, record ends included.
A record that fails a check raises with its id. Extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, small_batches, stored

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
#: A record's block has SEGMENT_BYTES at most, so a file has some 34 MB at most.
RECORDS_PER_FILE = 1000
#: So many repeated digests (of some 100 bytes) are broadcast at most.
BROADCAST_DIGESTS = 500_000
CRLF = "\r\n"
#: Of records whose writer gives no other date.
DATE = "2000-01-01T00:00:00Z"
LEVEL = 4


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The body in chunked framing; extensions after a size are ignored."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(framed[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, block: bytes, **fields: str | None) -> bytes:
    """A record without its closing CRLF CRLF."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"Content-Length: {len(block)}"]
    head += [f"{k.replace('_', '-')}: {' '.join(v.split())}" for k, v in fields.items() if v is not None]
    return (CRLF.join(head) + CRLF + CRLF).encode() + block


def member(record: bytes) -> bytes:
    """A record with its end as a gzip member, without the member's last byte, which is 0."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(record + b"\r\n\r\n") + packer.flush()
    if out[-1]:
        raise ValueError("a record of 16 MB or more")
    return out[:-1]


def segments(record_id: str, payload: bytes, page: str | None, digest: str, limit: int, url: str | None = None, date: str = DATE) -> Iterator[bytes]:
    """The records of one response."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    named = {"WARC_Date": date, "WARC_Target_URI": url or f"urn:page:{page}"}
    fields = named | {"WARC_Payload_Digest": f"sha1:{digest}", "X_Page_ID": page, "Content_Type": "application/http; msgtype=response"}
    if len(block) <= limit:
        yield record("response", record_id, block, **fields)
        return
    parts = [block[i : i + limit] for i in range(0, len(block), limit)]
    yield record("response", record_id, parts[0], **fields, WARC_Segment_Number="1")
    for k, part in enumerate(parts[1:], 2):
        own = hashlib.md5(f"{record_id}/{k}".encode()).hexdigest()
        yield record(
            "continuation", str(uuid.UUID(own)), part, **named, WARC_Segment_Origin_ID=f"<urn:uuid:{record_id}>", WARC_Segment_Number=str(k),
            WARC_Segment_Total_Length=str(len(block)) if k == len(parts) else None,
        )


def _id(page: str | None, number: int) -> str:
    return str(uuid.UUID(hashlib.md5(f"{page}/{number}".encode()).hexdigest()))


def _written(limit: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, url, payload, digest, least, number in zip(*(b[k].to_pylist() for k in ("page_id", "url", "payload", "digest", "least", "number"))):
                name = None if page is None else str(page)
                own = _id(name, number)
                if least is None or least["page_id"] is None or least["page_id"] == page:
                    out += map(member, segments(own, payload, name, digest, limit, url, date))
                    continue
                first = str(least["page_id"])
                out.append(member(record(
                    "revisit", own, b"", WARC_Date=date, WARC_Target_URI=url or f"urn:page:{name}", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    WARC_Refers_To=f"<urn:uuid:{_id(first, least['number'])}>", WARC_Refers_To_Target_URI=least["url"] or f"urn:page:{first}", WARC_Refers_To_Date=date,
                    WARC_Payload_Digest=f"sha1:{digest}", X_Page_ID=name, X_Refers_To_Page=first, X_Payload_Length=str(len(payload)),
                )))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return write


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", payload: str = "html", url: str = "url", min_revisit: int = 0, segment_bytes: int = SEGMENT_BYTES, date: str = DATE
) -> None:
    """Writes pages to WARC files under `path`; `date` is that of all records."""
    if segment_bytes >= 1 << 23:
        raise ValueError("segments of 8 MB or more")
    small_batches(pages)
    address = F.col(url).cast("string") if url in pages.columns else F.lit(None).cast("string")
    own = pages.select(F.col(page_id).alias("page_id"), address.alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumns({"sha": F.sha1("payload"), "number": F.monotonically_increasing_id()})
    # the digests that occur under more than one page; one row for each and task before the shuffle
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "number", "url")))
    many = stored(own.where(F.length("payload") >= min_revisit).groupBy("sha").agg(first.alias("least"), F.count("*").alias("n")).where("n > 1").select("sha", "least"), "digests")
    # few repeated digests go to the payloads; else payloads are shuffled, where a common one can be split
    few = F.broadcast(many) if many.count() <= BROADCAST_DIGESTS else many
    rows = own.join(few, "sha", "left").select("page_id", "url", "payload", "least", "number", _digest("payload").alias("digest"))
    # bytes pass through a string column unchanged
    lines = rows.mapInArrow(_written(segment_bytes, date), "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


@F.arrow_udf(T.StringType())
def _digest(payload: pa.Array) -> pa.Array:
    return pa.array([base32_sha1(x) for x in payload.to_pylist()])


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record of a file, gzipped in any members or not."""
    data = content
    if content[:2] == b"\x1f\x8b":
        data = gzip.GzipFile(fileobj=io.BytesIO(content)).read()
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(head["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} does not end after its Content-Length")
        yield head, data[start:stop]
        at = stop + 4


RECORDS = "record_id string, kind string, page_id string, digest string, refers_to string, revisit_bytes long, segment int, origin string, total long, block binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
    number = lambda h, k: int(h[k]) if k in h else None
    for b in batches:
        for content in b.column(0):
            rows, size = [], 0
            for h, block in parse(content.as_py()):
                own = h["warc-record-id"]
                rows.append((own, h["warc-type"], h.get("x-page-id"), h.get("warc-payload-digest", "").removeprefix("sha1:"), h.get("x-refers-to-page"), number(h, "x-payload-length"), number(h, "warc-segment-number"), h.get("warc-segment-origin-id", own), number(h, "warc-segment-total-length"), block))
                size += len(block)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


@F.arrow_udf(T.BinaryType())
def _payload(block: pa.Array, digest: pa.Array, record_id: pa.Array) -> pa.Array:
    """The body of an HTTP response block, its framing undone and its digest verified."""
    out = []
    for x, want, own in zip(block.to_pylist(), digest.to_pylist(), record_id.to_pylist()):
        if x is None:
            out.append(None)
            continue
        head, _, body = x.partition(b"\r\n\r\n")
        if b"transfer-encoding: chunked" in head.lower():
            body = dechunked(body)
        if want and base32_sha1(body) != want:
            raise ValueError(f"{own}: the payload does not have the digest {want}")
        out.append(body)
    return pa.array(out, pa.binary())


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, kind, page_id, digest, refers_to, revisit_bytes, payload (null for revisits)."""
    files = spark.read.format("binaryFile").load(f"{path}/*.txt").select("content")
    rows = files.mapInArrow(_parsed, RECORDS)
    whole = rows.where(F.col("segment").isNull())
    part = rows.where(F.col("segment").isNotNull())
    joined = part.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", F.col("block").cast("string").alias("block")))).alias("parts"),
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("kind", "page_id", "digest")],
    )
    block = F.array_join("parts.block", "").cast("binary")
    gap = F.size("parts") != F.element_at("parts", -1)["segment"]
    joined = joined.withColumn("block", block).withColumn(
        "block",
        F.when(gap | F.col("total").isNull() | (F.length("block") != F.col("total")), F.raise_error(F.concat(F.col("origin"), F.lit(": segments are missing"))).cast("binary")).otherwise(F.col("block")),
    )
    columns = ["record_id", "kind", "page_id", "digest", "refers_to", "revisit_bytes", "block"]
    joined = joined.select(F.col("origin").alias("record_id"), "kind", "page_id", "digest", F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("long").alias("revisit_bytes"), "block")
    all_rows = whole.select(*columns).unionByName(joined)
    body = F.when(F.col("kind") == "revisit", F.lit(None).cast("binary")).otherwise(F.col("block"))
    return all_rows.withColumn("payload", _payload(body, "digest", "record_id")).drop("block")


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Writes the pages to the shared folder and reads the archives back."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **how)
    return read_archives(pages.sparkSession, path)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; the length of a revisit's payload
    comes from the response that it refers to and must agree with the length noted with it."""
    found = stored(records.select("kind", "page_id", "digest", "refers_to", "revisit_bytes", F.length("payload").cast("long").alias("n")), "records")
    responses = found.where("kind = 'response'").groupBy("digest").agg(F.max("n").alias("origin_bytes"))
    seen = found.where("kind = 'revisit'").join(responses, "digest", "left")
    wrong = F.col("origin_bytes").isNull() | (F.col("origin_bytes") != F.col("revisit_bytes"))
    seen = seen.withColumn("n", F.when(wrong, F.raise_error(F.concat(F.lit("no response for "), F.col("digest"))).cast("long")).otherwise(F.col("origin_bytes")))
    every = found.where("kind = 'response'").select("kind", "page_id", "digest", "refers_to", "n").unionByName(seen.select("kind", "page_id", "digest", "refers_to", "n"))
    return every.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"),
    )


def oracle() -> str:
    """The query's result in DuckDB's SQL: base32 from each five hexadecimal digits of the SHA-1."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = " || ".join(f"substr('{alphabet}', CAST(((CAST('0x' || substr(h, {5 * j + 1}, 5) AS BIGINT) >> {shift}) & 31) + 1 AS BIGINT), 1)" for j in range(8) for shift in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {digits} AS payload_digest, CASE WHEN least IS NULL OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least OR (page_id IS NULL AND least IS NOT NULL) THEN least END AS refers_to FROM q"""

"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Written: a response record holds an HTTP response whose body is the payload in chunked transfer framing. Blocks longer
than SEGMENT bytes are cut: the first part stays in the response record, the others become continuation records with
the origin's id, their number and, in the last, the total length. A page whose payload an earlier page has becomes a
revisit record without a body. Files are plain WARC text, gzipped by Spark's writer, in shared storage.

Read: files are parsed record by record. Records that carry a segment number are grouped by origin, put in order of
their numbers, checked to be gapless and to have the total length, then decoded like whole ones: HTTP header off,
chunks joined, payload held against its SHA-256.

Defined cases: a null html is an empty payload; of equal payloads of at least LEAST bytes the one of the smallest
page_id (null last) is the response, as are rows repeated with that very id; line breaks in a url become %0D and %0A; a
null url is left out; an empty table gives no records; other columns are ignored. A damaged archive raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable, few

#: Payloads of fewer bytes are never revisits.
LEAST = 100
SEGMENT, CHUNK = 16 << 10, 4 << 10
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
OUT_BYTES = 4 << 20

PARSED = "record_id string, record_type string, page_id long, uri string, digest string, refers_to_record string, segment int, origin string, total long, block binary"


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload, digest, first: the page to refer to, null for a response."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("key", F.when(F.octet_length("payload") >= least, F.col("digest")))
    firsts = p.filter("key is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # few payloads repeat: where their digests fit, pages with their payloads needn't be dealt by them
    firsts = few(durable(firsts))
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # payloads too short to be compared have keys of their own, not all one
    alone = F.concat(F.lit("-"), F.pmod(F.xxhash64("page_id", "payload"), F.lit(4096)).cast("string"))
    p = p.withColumn("key", F.coalesce("key", alone)).join(firsts, "key", "left")
    return p.select("page_id", "url", F.when(~other, F.col("payload")).alias("payload"), "digest", F.when(other, F.col("first")).alias("first"))


def _record_id(page_id: int | None, digest: str, part: int = 1) -> str:
    h = hashlib.md5(f"{page_id}:{digest}:{part}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = (payload[i : i + size] for i in range(0, len(payload), size))
    return b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in parts) + b"0\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes | None, digest: str, first: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a page."""
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    own = _record_id(page_id, digest)
    fields = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Page-Id", page_id)]
    typed, sha = "WARC-Type", ("WARC-Payload-Digest", f"sha256:{digest}")
    if payload is None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([(typed, "revisit"), *fields, sha, ("WARC-Refers-To", _record_id(first, digest)), ("WARC-Profile", profile)], b"")
        return
    block = HTTP + chunked(payload)
    content = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= segment:
        yield _record([(typed, "response"), *fields, sha, content], block)
        return
    for k, at in enumerate(range(0, len(block), segment), 1):
        part = block[at : at + segment]
        if k == 1:
            yield _record([(typed, "response"), *fields, sha, content, ("WARC-Segment-Number", 1)], part)
        else:
            last = len(block) if at + segment >= len(block) else None
            yield _record([(typed, "continuation"), ("WARC-Record-ID", _record_id(page_id, digest, k)), *fields[1:3], ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", last)], part)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        for row in zip(*batch.columns, strict=True):
            for record in records(*(x.as_py() for x in row)):
                out.append(record[:-2])  # the writer's line separator ends it
                held += len(record)
            if held >= OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    rows = plan(pages, least).mapInArrow(_written, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _inflated(content: bytes) -> Iterator[bytes]:
    """Pieces of at most 1 MB of a file, gzipped (in any number of members) or not."""
    size = 1 << 20
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + size] for i in range(0, len(content), size))
        return
    while content:
        z = zlib.decompressobj(31)
        yield z.decompress(content, size)
        while not z.eof:
            piece = z.decompress(z.unconsumed_tail, size)
            if not piece and not z.eof:
                raise ValueError("a gzip member breaks off")
            yield piece
        content = z.unused_data


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a file."""
    pieces, held, at = _inflated(content), bytearray(), 0

    def fill(upto: int) -> bool:
        nonlocal at
        while len(held) < upto:
            piece = next(pieces, None)
            if piece is None:
                return False
            if at > 1 << 20:
                del held[:at]
                upto, at = upto - at, 0
            held.extend(piece)
        return True

    while fill(at + 1):
        scanned = at
        while (end := held.find(b"\r\n\r\n", max(at, scanned - 3))) < 0:
            ahead = len(held) - at
            if not fill(len(held) + 1):
                raise ValueError("a record's header breaks off")
            scanned = at + ahead
        version, *lines = held[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length, head = int(fields["content-length"]), end + 4 - at
        if not fill(at + head + length + 4):
            raise ValueError("a record's block breaks off")
        block = bytes(held[at + head : at + head + length])
        if held[at + head + length : at + head + length + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        at += head + length + 4
        yield fields, block


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "page_id", "uri", "digest", "refers_to_record", "segment", "origin", "total", "block"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
    number = lambda x: None if x is None else int(x)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)

    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for f, block in parse(content.as_py()):
                rows.append((f["warc-record-id"], f["warc-type"], number(f.get("page-id")), f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to"), number(f.get("warc-segment-number")), f.get("warc-segment-origin-id"), number(f.get("warc-segment-total-length")), block))
                held += len(block) + 300
                if held >= OUT_BYTES:
                    yield flush(rows)
                    rows, held = [], 0
            yield flush(rows)


def parsed(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, continuation records included."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, PARSED)


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size breaks off")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def payload(block: bytes) -> bytes:
    """The body of an HTTP response without transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def joined(parts: list[dict], total: int | None) -> bytes:
    """The block of a record cut into segments."""
    parts = sorted(parts, key=lambda x: x["segment"])
    if [x["segment"] for x in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"segments {[x['segment'] for x in parts][:20]} are not 1 to {len(parts)}")
    block = b"".join(x["block"] for x in parts)
    if total != len(block):
        raise ValueError(f"segments have {len(block)} bytes, not {total}")
    return block


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        for row in batch.to_pylist():
            block = joined(row["parts"], row["total"]) if row["parts"] is not None else row["block"]
            body = payload(block)
            sha = hashlib.sha256(body).hexdigest()
            if row["digest"] not in (None, f"sha256:{sha}"):
                raise ValueError(f"the payload of {row['record_id']} has SHA-256 {sha}, not {row['digest']}")
            out.append((row["record_id"], row["page_id"], row["uri"], body, sha))
            held += len(body)
            if held >= OUT_BYTES:
                yield _pages(out)
                out, held = [], 0
        yield _pages(out)


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["record_id", "page_id", "uri", "payload", "payload_digest"])


def responses(records: DataFrame) -> DataFrame:
    """record_id, page_id, uri, payload, payload_digest of the response records, reassembled and decoded.

    Segments are grouped by the record they belong to, never more than that record's bytes; records repeated in the
    archives (of rows repeated in the table) are told apart by the copies of their segments.
    """
    parts = "array<struct<segment:int,block:binary>>"
    whole = records.filter("record_type = 'response' and segment is null")
    whole = whole.select("record_id", "page_id", "uri", "digest", "total", "block", F.lit(None).cast(parts).alias("parts"))
    cut = records.filter("segment is not null").select(F.coalesce("origin", "record_id").alias("record_id"), "page_id", "uri", "digest", "total", "segment", "block")
    # copies of one segment are equal: one of each, and as many records as there are first segments
    once = cut.groupBy("record_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("page_id"), F.max("uri").alias("uri"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.first("block").alias("block"))
    one = once.groupBy("record_id").agg(F.max("page_id").alias("page_id"), F.max("uri").alias("uri"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.lit(None).cast("binary").alias("block"), F.collect_list(F.struct("segment", "block")).alias("parts"), F.max("n").alias("n"))
    one = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n", "copy")
    return whole.union(one).mapInArrow(_decoded, "record_id string, page_id long, uri string, payload binary, payload_digest string")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """One row a page, all from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's bytes are those of the response it names, which must exist and have the digest it states.
    """
    every = parsed(spark, path)
    own = responses(every).select("record_id", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest")
    named = own.groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("found"))
    again = every.filter("record_type = 'revisit'").select("page_id", F.col("refers_to_record").alias("record_id"), F.substring_index("digest", ":", -1).alias("payload_digest"))
    again = again.join(named, "record_id", "left")
    lost = F.raise_error(F.concat(F.lit("no response with the payload that a revisit names: "), "record_id")).cast("string")
    digest = F.when(F.col("found").eqNullSafe(F.col("payload_digest")), F.col("payload_digest")).otherwise(lost)
    own = own.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return own.union(again.select("page_id", "payload_bytes", digest.alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))

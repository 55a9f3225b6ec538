"""WARC archives of pages: written with segments and revisits, and read back by reassembly.

Each page is a record. A payload travels in chunked transfer framing inside an HTTP response; a block
longer than ``segment_bytes`` is cut into a first record and continuations, which name the first as
their origin and carry their segment number, the last one the total length. Reading groups the
segments by origin, orders them by number, verifies that none is missing and that the lengths add up
to the total, and decodes the chunks. Records that aren't segmented are decoded where they are read.

Archives are gzip files that Spark's text writer makes: a record ends with two line breaks, which is
the writer's line separator. The reader splits at the version line of the next record. The writer
ends a chunk inside any ``WARC/`` of a payload, so that no block holds such a line; should one of
another writer do, its parts are put together again by Content-Length, as a gzip file is read whole
and in order by one task, record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstate.llm import common as C

SEGMENT_BYTES = 1 << 20  # longest block of a record
CHUNK_BYTES = 1 << 16
FILE_RECORDS = 50_000  # pages of an archive file
BROADCAST_ROWS = 100_000  # payloads that several pages share: digest, id and URL, some 200 bytes
DATE = "2024-01-01T00:00:00Z"  # of the capture; the tables have none
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_BATCH_BYTES = 4 << 20


# ---------------------------------------------------------------- framing

def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of ``payload``; no ``WARC/`` of it stays in one chunk."""
    cuts = {m.start() + 2 for m in re.finditer(b"WARC/", payload)} | set(range(size, len(payload), size)) | {len(payload)}
    out, at = io.BytesIO(), 0
    for cut in sorted(cuts):
        if cut > at:
            out.write(b"%x\r\n" % (cut - at))
            out.write(payload[at:cut])
            out.write(b"\r\n")
            at = cut
    out.write(b"0\r\n\r\n")
    return out.getvalue()


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body (extensions and trailers are skipped); None if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(;[^\r\n]*)?", body[at:end]) if end >= 0 else None
        if not size:
            return None
        n, at = int(size[1], 16), end + 2
        if not n:
            return b"".join(out) if body[at:].endswith(b"\r\n") else None
        if body[at + n: at + n + 2] != b"\r\n":
            return None
        out.append(body[at: at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP message: its body without transfer framing; None if it is broken."""
    head, _, body = block.partition(b"\r\n\r\n")
    if re.search(rb"\r\ntransfer-encoding:[ \t]*chunked[ \t]*(\r\n|$)", head, re.IGNORECASE):
        return dechunked(body)
    return body


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, fields: list[tuple[str, object]], block: bytes, date: str = DATE) -> bytes:
    """A record without the two line breaks that end it; fields without a value are left out."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields, ("Content-Length", len(block))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode() + b"\r\n" + block


def records_of(page_id, url, payload: bytes, record_id: str, refers_id, refers_url, segment_bytes: int, chunk_bytes: int, date: str) -> list[bytes]:
    """The records of a page: a revisit, or a response and its continuations."""
    own = [("X-Page-ID", page_id), ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")), ("WARC-Payload-Digest", "sha1:" + digest_of(payload))]
    kind = "application/http; msgtype=response"
    if refers_id is not None:
        more = [("WARC-Refers-To", refers_id), ("WARC-Refers-To-Target-URI", None if refers_url is None else quote(refers_url, safe="!#$%&'()*+,/:;=?@[]~")), ("WARC-Refers-To-Date", date), ("WARC-Profile", PROFILE), ("Content-Type", kind)]
        return [record("revisit", record_id, own + more, _HEAD + b"\r\n", date)]
    block = _HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [record("response", record_id, [*own, ("Content-Type", kind)], block, date)]
    out = [record("response", record_id, [*own, ("Content-Type", kind), ("WARC-Segment-Number", 1)], block[:segment_bytes], date)]
    for n, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        last = at + segment_bytes >= len(block)
        more = [("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if last else None)]
        out.append(record("continuation", f"{record_id[:-1]}:{n}>", more, block[at: at + segment_bytes], date))
    return out


# ---------------------------------------------------------------- writing

def _record_id(page_id, url, digest):
    return F.concat(F.lit("<urn:page:"), F.sha1(F.to_json(F.struct(page_id.alias("p"), url.alias("u"), digest.alias("d")))), F.lit(">"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, date: str = DATE) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``.

    Of pages with equal payloads of ``min_bytes`` or more, that with the smallest id is a response
    and the others are revisits of it. A null html is an empty payload. Rows that repeat the smallest
    id are responses each, and so are all pages of a payload that no id has; other null ids are
    revisits. Ids and URLs that are null have no field. A long page is cut into segments, so that no
    record is longer than ``segment_bytes``. Other columns aren't archived. An empty table makes an
    archive without records."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.col("page_id").alias("by"), F.sha2(html, 256).alias("same"))
    least = F.min(F.when(F.col("by").isNotNull(), F.struct("by", F.col("url").alias("first_url"), F.col("page_id").alias("first_id")))).alias("f")
    shared = rows.where(F.octet_length("html") >= min_bytes).groupBy("same").agg(F.count("*").alias("n"), least).where("n > 1 and f is not null")
    with C.Scratch(spark) as scratch:
        shared = C.table(shared.select("same", "f.by", "f.first_id", "f.first_url"), "warc_shared", scratch).withColumnRenamed("by", "first")
        if shared.count() <= BROADCAST_ROWS:
            shared = F.broadcast(shared)
        joined = rows.join(shared, "same", "left")
        again = F.col("first").isNotNull() & ~F.col("by").eqNullSafe(F.col("first"))
        out = joined.select("page_id", "url", "html", _record_id(F.col("page_id"), F.col("url"), F.col("same")).alias("record_id"), F.when(again, _record_id(F.col("first_id"), F.col("first_url"), F.col("same"))).alias("refers_id"), F.when(again, F.col("first_url")).alias("refers_url"))

        def run(batches):
            from pyspark import TaskContext

            part, held, size, begun = TaskContext.get().partitionId(), [], 0, False
            for batch in batches:
                for i in range(batch.num_rows):
                    if not begun:
                        info = b"software: fleetstate\r\nformat: WARC File Format 1.1\r\n"
                        held.append(record("warcinfo", f"<urn:archive:{part}>", [("Content-Type", "application/warc-fields")], info, date))
                        begun = True
                    r = [c[i].as_py() for c in batch.columns]
                    for x in records_of(r[0], r[1], r[2].encode(), r[3], r[4], r[5], segment_bytes, chunk_bytes, date):
                        held.append(x)
                        size += len(x)
                        if size >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                            held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

        lines = out.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
        lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


# ---------------------------------------------------------------- reading

def _parse(fragments):
    """(fields, block) of the records whose fragments, split at version lines, come in order. A block
    of None is one that ends before its Content-Length."""
    head = block = None

    def done():
        n = int(head.get("content-length", "-1") if head.get("content-length", "").isdigit() else -1)
        return head, block[:n] if 0 <= n <= len(block) else None

    for raw in fragments:
        first = raw.startswith(VERSION)  # of a file
        if first:
            raw = raw[len(VERSION):]
        if head is not None:
            want = head.get("content-length", "")
            if not first and want.isdigit() and len(block) < int(want):  # a version line inside the block
                block += b"\n" + VERSION + raw
                continue
            yield done()
        lines, _, block = raw.partition(b"\r\n\r\n")
        head = {}
        for line in lines.decode("utf-8", "replace").split("\r\n"):
            name, colon, value = line.partition(":")
            if colon:
                head[name.strip().lower()] = value.strip()
    if head is not None:
        yield done()


_FIELDS = ["kind", "record_id", "page_id", "url", "digest", "refers_to"]
RECORD = "kind string, record_id string, page_id string, url string, digest string, refers_to string, payload binary, status string"
_SEGMENT = "origin string, segment int, total long, kind string, record_id string, page_id string, url string, digest string, refers_to string, block binary"


def _common(h: dict) -> list:
    return [h.get("warc-type"), h.get("warc-record-id"), h.get("x-page-id"), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to")]


def _decoded(common: list, block: bytes | None, bad: str | None) -> tuple:
    """A row of RECORD; a response's payload is decoded and compared with its digest."""
    if bad or block is None:
        return (*common, None, bad or "truncated")
    if common[0] == "revisit":
        return (*common, None, "ok")
    payload = payload_of(block)
    if payload is None:
        return (*common, None, "bad_chunks")
    good = common[4] in (None, "sha1:" + digest_of(payload))
    return (*common, payload, "ok" if good else "bad_digest")


def _batches(rows, schema: pa.Schema, blob: int):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + len(r[blob] or b"")
        if size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_STR = [(c, pa.string()) for c in _FIELDS]
_RECORD_ARROW = pa.schema([*_STR, ("payload", pa.binary()), ("status", pa.string())])
_SEGMENT_ARROW = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), *_STR, ("block", pa.binary())])


def _fragments(batches):
    for batch in batches:
        for x in batch.column(0):
            yield x.as_py()


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdigit() and len(text) < 10 else None


def _whole(batches):
    """Records that aren't segments."""
    rows = (_decoded(_common(h), b, None) for h, b in _parse(_fragments(batches)) if "warc-segment-number" not in h and h.get("warc-type") in ("response", "revisit"))
    return _batches(rows, _RECORD_ARROW, 6)


def _segments(batches):
    rows = ((h.get("warc-segment-origin-id") or h.get("warc-record-id"), _number(h["warc-segment-number"]), int(h["warc-segment-total-length"]) if h.get("warc-segment-total-length", "").isdigit() else None, *_common(h), b) for h, b in _parse(_fragments(batches)) if "warc-segment-number" in h)
    return _batches(rows, _SEGMENT_ARROW, 9)


def _joined(origin: str | None, segments) -> list[tuple]:
    """The record that segments in order make. Copies of a segment count once; the record comes as
    often as its first segment did."""
    first = total = problem = None
    parts, copies, seen = [], 0, 0
    for r in segments:
        n = r[1]
        if n == 1:
            copies, first = copies + 1, first or list(r[3:9])
        if n is not None and n == seen:
            continue
        if n != seen + 1:
            problem = problem or "missing_segment"
        elif r[9] is None:
            problem = problem or "truncated"
        seen, total = n or seen, r[2] if r[2] is not None else total
        if not problem:
            parts.append(r[9])
    if not problem and total is None:
        problem = "no_total"
    if not problem and sum(map(len, parts)) != total:
        problem = "bad_length"
    row = _decoded(first or ["response", origin, None, None, None, None], None if problem else b"".join(parts), problem)
    return [row] * max(copies, 1)


def _join(batches):
    """Segments sorted by origin and number, put together; one record at a time is held."""
    rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
    return _batches((x for origin, segments in groupby(rows, lambda r: r[0]) for x in _joined(origin, segments)), _RECORD_ARROW, 6)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n" + VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of the archives under ``path`` (``RECORD``).

    status: ok, or why there is no payload: truncated, missing_segment, no_total, bad_length or
    bad_chunks; bad_digest has the payload as it is. A revisit has none (``resolve``). Only segmented
    records are shuffled."""
    lines = _lines(spark, path)
    parts = lines.mapInArrow(_segments, _SEGMENT)
    joined = parts.repartition(C.shuffle_parts(spark), "origin").sortWithinPartitions("origin", "segment").mapInArrow(_join, RECORD)
    return lines.mapInArrow(_whole, RECORD).unionByName(joined)


def resolve(records: DataFrame, scratch: C.Scratch | None = None) -> DataFrame:
    """``records`` without payload: with payload_bytes, payload_digest (base32) and refers_page, which
    a revisit has from the record that it refers to. One whose record isn't there, or has another
    digest, gets the status no_original or bad_digest."""
    spark = records.sparkSession
    known = [c for c in records.columns if c != "payload"]
    slim = C.table(records.select(*known, F.length("payload").cast("bigint").alias("payload_bytes"), F.when(F.col("payload").isNotNull(), F.unhex(F.sha1("payload"))).alias("sha1")), "warc_records", scratch)
    originals = slim.where("kind = 'response' and status = 'ok'").groupBy("record_id").agg(F.first(F.struct("page_id", "payload_bytes", "sha1", "digest")).alias("o"))
    originals = originals.select(F.col("record_id").alias("o_id"), F.col("o.page_id").alias("o_page"), F.col("o.payload_bytes").alias("o_bytes"), F.col("o.sha1").alias("o_sha1"), F.col("o.digest").alias("o_digest"))
    revisit = slim.where("kind = 'revisit'").drop("payload_bytes", "sha1").join(originals, F.col("refers_to") == F.col("o_id"), "left")
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("o_id").isNull(), "no_original").when(F.col("o_digest") != F.col("digest"), "bad_digest").otherwise("ok")
    revisit = revisit.select(*[status.alias(c) if c == "status" else F.col(c) for c in known], F.col("o_bytes").alias("payload_bytes"), F.col("o_sha1").alias("sha1"), F.col("o_page").alias("refers_page"))
    both = slim.where("kind <> 'revisit'").withColumn("refers_page", F.lit(None).cast("string")).unionByName(revisit)

    @F.pandas_udf("string")
    def base32(x):
        return x.map(lambda b: None if b is None else base64.b32encode(bytes(b)).decode())

    return both.select(*known, "payload_bytes", base32("sha1").alias("payload_digest"), "refers_page")


def file_bytes(records: list[bytes]) -> bytes:
    """An archive of records, as a writer makes that compresses each record by itself."""
    return b"".join(gzip.compress(r + b"\r\n\r\n") for r in records)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC, read the archives back and report on every record."""
    pages = C.read_table(spark, sf_dir, "pages")
    with C.Scratch(spark) as scratch:
        path = C.scratch_path(spark, "warc")
        scratch.paths.append(path)
        write(pages, path)
        of_page = pages.schema["page_id"].dataType
        out = resolve(read(spark, path), scratch)
        return C.table(out.select(F.col("page_id").cast(of_page).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_page").cast(of_page).alias("refers_to"), "status"), "warc_pages")


OP12_SQL = """
with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages),
f as (select *, min(page_id) over (partition by payload) as first from p)
select page_id, strlen(payload) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(hex, cast(i // 4 as int) * 5 + 1, 5) as bigint) >> (15 - 5 * (i % 4))) % 32 as int) + 1, 1)), '') as payload_digest,
  case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from first then first end as refers_to, 'ok' as status
from f"""

"""WARC: framing, segments and revisits by round trip, broken archives by their status."""
import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fleetstate.llm import common as C
from fleetstate.llm import warc as W

SCHEMA = "page_id long, url string, html string, kind string, same string, first string, value string"
own = ("own", "own", "own", "own")


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_chunks_round_trip_and_hold_no_version_line():
    r = random.Random(1)
    alphabet = [b"WARC/1.1\r\n", b"\r\n", b"\n", b"WARC/", b"a", b"0\r\n\r\n", "é".encode(), b"x" * 50]
    for n in range(200):
        payload = b"".join(r.choice(alphabet) for _ in range(n % 40))
        for size in (1, 3, 7, 1 << 16):
            body = W.chunked(payload, size)
            assert b"WARC/" not in body and W.dechunked(body) == payload
    assert W.dechunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc" and W.dechunked(b" 1A \r\n" + b"y" * 26 + b"\r\n0\r\n\r\n") == b"y" * 26
    for broken in (b"", b"3\r\nab", b"3\r\nabcd\r\n0\r\n\r\n", b"g\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"0\r\n"):
        assert W.dechunked(broken) is None
    assert W.payload_of(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody") == b"body" and W.payload_of(b"HTTP/1.1 200 OK\r\nTRANSFER-ENCODING: Chunked\r\n\r\n1\r\nz\r\n0\r\n\r\n") == b"z"


def expected(rows, least=0):
    """page_id, bytes, digest, kind, refers_to of each row, by plain loops."""
    out = []
    for r in rows:
        ids = [x[0] for x in rows if (x[2] or "") == (r[2] or "") and x[0] is not None]
        first = min(ids) if ids and len((r[2] or "").encode()) >= least else r[0]
        out.append((r[0], len((r[2] or "").encode()), b32(r[2]), "response" if r[0] == first else "revisit", None if r[0] == first else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, segment, chunk", [(0, 1 << 20, 1 << 16), (5, 300, 64), (10**9, 100, 1000)])
def test_pages_round_trip(spark, least, segment, chunk):
    long = "".join(random.Random(2).choice("abc\r\n<>é") for _ in range(5000))
    texts = ["", None, "<p>a</p>", long, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "WARC/1.1\r\n" * 30, "\n0\r\n\r\n"]
    rows = [(i, f"http://h/{i} é\r\n", texts[i % len(texts)], *own) for i in range(1, 60)]
    rows += [(None, None, "<p>a</p>", *own), (None, "u", "only without an id", *own), (None, "u", "only without an id", *own), (3, None, "other", *own), (3, None, "other", *own), (70, "u", long, *own), (70, "u", long, *own)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = C.scratch_path(spark, "warc-test")
    W.write(df, path, least, segment, chunk)
    got = W.read(spark, path)
    assert got.where("status <> 'ok'").count() == 0
    out = W.resolve(got).collect()
    assert all(r["status"] == "ok" for r in out)
    number = lambda x: None if x is None else int(x)
    assert sorted(((number(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["kind"], number(r["refers_page"])) for r in out), key=str) == expected(rows, least)
    texts_back = {number(r["page_id"]): bytes(r["payload"]).decode() for r in got.where("kind = 'response' and page_id < 60 and page_id > 3").collect()}
    assert all(texts_back[i] == (t or "") for i, _, t, *_ in rows if i in texts_back)
    # the files are plain WARC: lengths walk from record to record
    spans = 0
    for f in spark.read.format("binaryFile").load(path + "/*.gz").collect():
        data, at = gzip.decompress(bytes(f["content"])), 0
        while at < len(data):
            head = data[at: data.index(b"\r\n\r\n", at)]
            n = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert data[at:].startswith(b"WARC/1.1\r\n") and n <= max(segment, 100)
            at += len(head) + 4 + n
            assert data[at: at + 4] == b"\r\n\r\n"
            at, spans = at + 4, spans + 1
    assert spans >= len(rows)


def test_an_empty_table(spark):
    path = C.scratch_path(spark, "warc-test")
    W.write(spark.createDataFrame([], SCHEMA), path)
    assert W.read(spark, path).count() == 0


def archive(tmp_path, records):
    (tmp_path / "a.warc.gz").write_bytes(W.file_bytes(records))
    return str(tmp_path)


def segments(origin, sizes, total, page="1"):
    block = W._HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + W.chunked(b"z" * 500, 90)
    out, at = [], 0
    for n, size in enumerate(sizes, 1):
        last = n == len(sizes)
        part = block[at:] if last else block[at: at + size]
        at += size
        fields = [("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", (total or len(block)) if last else None)]
        fields += [("X-Page-ID", page), ("WARC-Payload-Digest", "sha1:" + b32("z" * 500))] if n == 1 else [("WARC-Segment-Origin-ID", origin)]
        out.append(W.record("response" if n == 1 else "continuation", origin if n == 1 else f"{origin}-{n}", fields, part))
    return out


def test_segments_come_together_in_any_order(spark, tmp_path):
    parts = [x for i in range(20) for x in segments(f"<o{i}>", [10 + i, 100, 7, 50], None, str(i))]
    random.Random(4).shuffle(parts)
    got = W.read(spark, archive(tmp_path, parts)).collect()
    assert sorted(int(r["page_id"]) for r in got) == list(range(20))
    assert all(r["status"] == "ok" and bytes(r["payload"]) == b"z" * 500 and r["kind"] == "response" for r in got)


def test_what_is_broken_has_a_status(spark, tmp_path):
    whole = lambda i: segments(f"<{i}>", [10, 100, 100], None, i)
    no_chunks = W.record("response", "<e>", [("X-Page-ID", "e")], W._HEAD + b"Transfer-Encoding: chunked\r\n\r\n9\r\nabc")
    wrong = W.record("response", "<f>", [("X-Page-ID", "f"), ("WARC-Payload-Digest", "sha1:" + "A" * 32)], W._HEAD + b"\r\nabc")
    embedded = W.record("response", "<g>", [("X-Page-ID", "g")], W._HEAD + b"\r\nx\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\ntail")
    revisits = [W.record("revisit", f"<r{i}>", [("X-Page-ID", f"r{i}"), ("WARC-Refers-To", to), ("WARC-Payload-Digest", d)], b"") for i, (to, d) in enumerate([("<h>", "sha1:" + b32("abc")), ("<h>", "sha1:x"), ("<nowhere>", "sha1:x")])]
    good = W.record("response", "<h>", [("X-Page-ID", "h"), ("WARC-Payload-Digest", "sha1:" + b32("abc"))], W._HEAD + b"\r\nabc")
    lost_end, lost_middle, lost_first = whole("a")[:2], [whole("b")[0], whole("b")[2]], whole("c")[1:]
    cut = W.record("response", "<z>", [("X-Page-ID", "z"), ("Content-Length", 0)], b"")[:-1].replace(b"Content-Length: 0", b"Content-Length: 900")
    records = [*lost_end, *lost_middle, *lost_first, *segments("<d>", [10, 100, 100], 7, "d"), no_chunks, wrong, embedded, good, *revisits, W.record("metadata", "<m>", [], b"x"), cut]
    got = W.read(spark, archive(tmp_path, records))
    status = {r["page_id"] or r["record_id"]: r["status"] for r in got.collect()}
    assert status == {"a": "no_total", "b": "missing_segment", "<c>": "missing_segment", "d": "bad_length", "e": "bad_chunks", "f": "bad_digest", "g": "ok", "h": "ok", "r0": "ok", "r1": "ok", "r2": "ok", "z": "truncated"}
    assert bytes(got.where("page_id = 'g'").first()["payload"]) == b"x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\ntail"
    again = {r["page_id"]: (r["status"], r["payload_bytes"], r["refers_page"]) for r in W.resolve(got).where("kind = 'revisit'").collect()}
    assert again == {"r0": ("ok", 3, "h"), "r1": ("bad_digest", 3, "h"), "r2": ("no_original", None, None)}


def test_query_on_a_table(spark, tmp_path):
    rows = [(i, f"u{i}", "abc"[i % 3] * (i % 6), *own) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    got = W.op12_warc(spark, str(tmp_path))
    assert got.schema["page_id"].dataType == got.schema["refers_to"].dataType == spark.createDataFrame(rows, SCHEMA).schema["page_id"].dataType
    assert sorted((tuple(r)[:5] for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(rows)
    assert got.where(F.col("status") != "ok").count() == 0

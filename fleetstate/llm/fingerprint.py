"""Document fingerprints: quartile bucket digest.

Byte triplets of a sliding window are hashed into buckets; each bucket's count is coded by the
quartile it falls in among the text's buckets (two bits), and the length by a logarithmic step.
Two digests differ by the sum of their bucket differences plus a bounded length difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstate.llm import common as C

BUCKETS = 256
REACH = 5  # triplets are taken from windows of this many bytes, the newest byte always among them
PAIRS = [(i, j) for i in range(1, REACH) for j in range(i + 1, REACH)]
LENGTH_WEIGHT = 4
SPREAD = 1.25 * BUCKETS  # mean difference of unrelated quartile codes

_rng = np.random.default_rng(505)
_KEYS = _rng.integers(0, 1 << 16, (3, 256), dtype=np.uint16)


def counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Triplet counts, text x bucket. Only triplets within one text count."""
    n = len(offs) - 1
    total = np.zeros(n * BUCKETS, np.int64)
    if len(data) >= 3:
        text = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(offs))
        left = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))  # bytes of the text before this one
        key = [k[data] for k in _KEYS]
        for i, j in PAIRS:
            h = key[0][j:] + key[1][j - i: len(data) - i] * np.uint16(31) + key[2][: len(data) - j]
            h *= np.uint16(40503)
            h ^= h >> np.uint16(7)
            h *= np.uint16(25717)
            ok = left[j:] >= j
            total += np.bincount((text[j:] + (h >> np.uint16(8)))[ok], minlength=len(total))
    return total.reshape(n, BUCKETS)


def digests(texts: list[bytes]) -> np.ndarray:
    """Quartile codes and the length step of each text: uint8, text x (BUCKETS + 1)."""
    out = np.zeros((len(texts), BUCKETS + 1), np.uint8)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= C.SLICE_BYTES):
            size += len(texts[to])
            to += 1
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts[at:to]])])
        c = _counts_of_long(texts[at]) if size > 2 * C.SLICE_BYTES else counts(np.frombuffer(b"".join(texts[at:to]), np.uint8), offs)
        ranked = np.sort(c, axis=1)
        for q in (1, 2, 3):
            out[at:to, :BUCKETS] += c > ranked[:, [q * BUCKETS // 4 - 1]]
        out[at:to, BUCKETS] = np.minimum(np.round(8 * np.log2(np.diff(offs) + 1.0)), 255).astype(np.uint8)
        at = to
    return out


def _counts_of_long(text: bytes) -> np.ndarray:
    """Counts of one long text, in blocks that overlap by a window less a byte."""
    total = np.zeros((1, BUCKETS), np.int64)
    for at in range(0, len(text), C.SLICE_BYTES):
        head = max(0, at - REACH + 1)
        block = np.frombuffer(text[head: at + C.SLICE_BYTES], np.uint8)
        total += counts(block, np.array([0, len(block)]))
        if head:  # triplets wholly in the overlap were counted with the block before
            total -= counts(block[: at - head], np.array([0, at - head]))
    return total


def to_text(d: np.ndarray) -> str:
    """Hex: the length step, then four codes a byte."""
    q = d[:BUCKETS].reshape(-1, 4)
    return bytes([d[BUCKETS], *(q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3])]).hex()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(s), np.uint8)
    q = raw[1:]
    return np.concatenate([np.stack([q >> 6, q >> 4 & 3, q >> 2 & 3, q & 3], 1).reshape(-1), raw[:1]])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 from the difference of unrelated ones on."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    codes = np.abs(a[..., :BUCKETS] - b[..., :BUCKETS]).sum(-1)
    length = np.minimum(np.abs(a[..., BUCKETS] - b[..., BUCKETS]), 16)
    return np.maximum(0.0, 1.0 - (codes + LENGTH_WEIGHT * length) / (SPREAD + LENGTH_WEIGHT * 16))


def edit(text: str, following: str) -> str:
    """The last third replaced by the first as many characters of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _rows(texts: list[str], following: list[str]) -> list[pa.Array]:
    edited = [edit(a, b).encode() for a, b in zip(texts, following, strict=True)]
    n = len(texts)
    d = digests([t.encode() for t in texts] + edited + [following[-1].encode()])
    own, changed = d[:n], d[n: 2 * n]
    after = np.concatenate([own[1:], d[-1:]])
    for i in range(n - 1):
        if texts[i + 1] is not following[i]:
            after[i] = digests([following[i].encode()])[0]
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array(list(map(to_text, own)), pa.string()), pa.array(list(map(to_text, changed)), pa.string()),
            pa.array(likeness(own, changed)), pa.array(likeness(own, after))]


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint each text, its edited text, and compare with the next text by descending doc_id.

    Returns doc_id and ``_COLUMNS``. Null text is empty. Equal ids are ordered by their text, null
    ids come last. A single row is its own next row; an empty table gives no rows. Other columns
    are not read.

    The rows are range-partitioned by id once. Within a partition each row meets the next one as
    they stream by; a partition's last row waits, and is joined with the first row of the next
    partition that has any: two rows a partition.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    ranged = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).repartitionByRange(parts or C.shuffle_parts(spark), order[0]).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("doc_id", kind), T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in _COLUMNS[1:4]), *(T.StructField(c, T.DoubleType()) for c in _COLUMNS[4:])])
    names = [f.name for f in schema.fields]

    def edge(part: int, first: bool, row: pa.RecordBatch, text: str) -> pa.RecordBatch:
        blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), row.column(0), pa.array([text], pa.string()), *blank], names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None  # the last row so far and its text
        for batch in C.slices(batches):
            texts = batch.column(1).to_pylist()
            if held is None:
                yield edge(part, True, batch.slice(0, 1), texts[0])
                ids, own = batch.column(0).slice(0, len(texts) - 1), texts[:-1]
                after = texts[1:]
            else:
                ids = pa.concat_arrays([held[0].column(0), batch.column(0).slice(0, len(texts) - 1)])
                own, after = [held[1], *texts[:-1]], texts
            if own:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.bool_()), ids, pa.nulls(len(own), pa.string()), *_rows(own, after)], names)
            last = batch.slice(batch.num_rows - 1, 1)
            held = (pa.RecordBatch.from_arrays([pa.concat_arrays([last.column(0)])], ["doc_id"]), texts[-1])
        if held:
            yield edge(part, False, held[0], held[1])

    found = C.cut(ranged.mapInArrow(stream, schema))
    edges = found.where("part is not null")
    heads = edges.where("first").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    used = edges.where("first").select("part")
    follow = used.withColumn("next_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    waiting = edges.where("not first").select("part", "doc_id", "text").join(follow, "part").join(heads, "next_part").select("doc_id", "text", "following")

    def pair(batches):
        for batch in C.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(_first, zip(*[_rows([a], [b]) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], strict=True))], ["doc_id", *_COLUMNS])

    done = waiting.mapInArrow(pair, T.StructType([f for f in schema.fields if f.name not in ("part", "first", "text")]))
    return found.where("part is null").select("doc_id", *_COLUMNS).unionByName(done)


def _first(arrays: tuple[pa.Array, ...]) -> pa.Array:
    return pa.concat_arrays(list(arrays))


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(C.read_table(spark, sf_dir, "documents"))

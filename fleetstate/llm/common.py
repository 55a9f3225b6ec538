"""Helpers shared by the operators: table reading, Arrow text buffers, vectorised word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstate.session import ensure_checkpoint_dir

SLICE_BYTES = 2 << 20  # text handled at once by the vectorised passes; bounds their memory

# White space of the word rule [^\x20\x09-\x0D]+.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id gives 0."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(0))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session: the one place where lineage is cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``budget`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        offs = offsets_of(col)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + budget, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def offsets_of(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    buf = col.buffers()[1]
    if buf is None or len(col) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(buf, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each text begins (nulls are empty)."""
    if col.null_count:
        col = col.fill_null("")
    offs = offsets_of(col)
    data = col.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offs[0]:offs[-1]]
    return data, offs - offs[0]


_rng = np.random.default_rng(20240229)
BYTE_KEYS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C17 | 3)  # 3 modulo 4: swapped neighbours keep 63 bits apart
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** i modulo 2**64 for i below n at least."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 256), BASE))])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


LONG_BYTES = 16 << 20  # a single text beyond this is hashed in stretches cut at white space


def hash_words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word ``[^\\x20\\x09-\\x0D]+``, and where each text's words begin."""
    if len(offs) != 2 or len(data) <= LONG_BYTES:
        return _hash_words(data, offs, lower)
    spaces = np.flatnonzero(_IS_SPACE[data])
    parts, at = [], 0
    while at < len(data):
        i = np.searchsorted(spaces, at + LONG_BYTES)
        to = int(spaces[i]) if i < len(spaces) else len(data)
        parts.append(_hash_words(data[at:to], np.array([0, to - at]), lower)[0])
        at = to
    words = np.concatenate(parts)
    return words, np.array([0, len(words)])


def _hash_words(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    if lower:
        data = LOWER[data]
    solid = ~_IS_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    firsts = offs[:-1][offs[:-1] < offs[1:]]
    start[firsts] = solid[firsts]
    at = np.flatnonzero(start)
    words_before = np.searchsorted(at, offs)
    if not len(at):
        return np.zeros(0, np.uint64), words_before
    size = np.diff(np.append(at, len(data)))
    place = np.arange(at[0], len(data)) - np.repeat(at, size)
    part = BYTE_KEYS[data[at[0]:]]
    part[~solid[at[0]:]] = 0
    part *= powers(int(size.max()) + 1)[place]
    return mix(np.add.reduceat(part, at - at[0])), words_before


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (shorter than k: none)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        out = out * BASE + words[i: len(words) - k + 1 + i]
    return mix(out)


def large(x) -> pa.Array:
    return pa.array(x)


class Scratch:
    """Tables that an operator needs only while it makes its result; they go with the block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(df: DataFrame, name: str, scratch: Scratch | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back, where a result is used
    more than once and would cost more to make again than to keep. The folder goes with ``scratch``,
    or when the application ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if scratch:
        scratch.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def offsets_of_list(col: pa.Array) -> np.ndarray:
    """Where each list's values begin in ``flatten()`` of a list column without nulls."""
    offs = np.asarray(col.offsets)
    return offs - offs[0]

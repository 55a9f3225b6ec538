"""Texts packed into blocks, for operators whose texts ask the whole corpus about what they contain.

A block is a row with many texts, compressed. It asks once for each distinct item it has, so that
what moves between tasks is items per block, never occurrences; the answers meet the block again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetstate.llm import common as C

BLOCK_BYTES = 32 << 20
LOOKED_UP = 1 << 18  # keys at once


def blocks(df: DataFrame, keep: list[str], block_bytes: int = BLOCK_BYTES, scratch: C.Scratch | None = None) -> DataFrame:
    """block, a list of each column of ``keep``, sizes and bytes (zstd) of ``text``: some
    ``block_bytes`` of text a row. Written once, so that a block is the same wherever it is read."""
    fields = [df.schema[c] for c in keep]
    names = ["block", *keep, "sizes", "bytes"]
    schema = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("bytes", T.BinaryType())])

    def run(batches):
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        held: list = []
        size = 0

        def out():
            cols = [pa.concat_arrays([x[0][i] for x in held]) for i in range(len(keep))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols]
            raw = b"".join(x[2].tobytes() for x in held)
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + nth], pa.int64()), *lists, pa.array([np.concatenate([x[1] for x in held])], pa.list_(pa.int64())), pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())], names)

        for batch in C.slices(batches):
            data, offs = C.text_bytes(batch.column(len(keep)))
            held.append((batch.columns[: len(keep)], np.diff(offs), data))
            size += len(data)
            if size >= block_bytes:
                yield out()
                held, size, nth = [], 0, nth + 1
        if held:
            yield out()

    return C.table(df.select(*keep, "text").mapInArrow(run, schema), "blocks", scratch)


def parts(sizes: list[int], blob: bytes):
    """The texts of a block in slices: number of the first and end, their bytes, their offsets."""
    sizes = np.asarray(sizes, np.int64)
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=int(sizes.sum()), codec="zstd", asbytes=True), np.uint8) if sizes.sum() else np.zeros(0, np.uint8)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + C.SLICE_BYTES, side="right")) - 1)
        yield at, to, raw[offs[at]: offs[to]], offs[at: to + 1] - offs[at]
        at = to


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pack_numbers(x: np.ndarray, sorted_: bool = False) -> bytes:
    """Non-negative 64-bit integers in few bytes; sorted ones as their differences."""
    if sorted_ and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    planes = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True) if len(x) else b""


def unpack_numbers(blob: bytes, sorted_: bool = False) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n = int.from_bytes(blob[:8], "little")
    x = np.ascontiguousarray(np.frombuffer(pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T).view("<u8").reshape(-1)
    return np.cumsum(x, dtype=np.uint64) if sorted_ else x


class Lookup:
    """Vectorised hash table from 64-bit keys to values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, values.dtype)
        self.used = np.zeros(1 << self.bits, bool)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = ~self.used[slot]
            self.keys[slot[free]] = keys[left[free]]
            self.used[slot[free]] = True
            mine = self.keys[slot] == keys[left]
            self.values[slot[mine]] = values[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(keys), default, self.values.dtype)
        for at in range(0, len(keys), LOOKED_UP):  # what a look-up needs beside its result is bounded
            self._get(keys[at: at + LOOKED_UP], out[at: at + LOOKED_UP])
        return out

    def _get(self, keys: np.ndarray, out: np.ndarray) -> None:
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            hit = self.used[slot] & (self.keys[slot] == keys[left])
            out[left[hit]] = self.values[slot[hit]]
            on = self.used[slot] & ~hit
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)

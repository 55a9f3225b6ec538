"""What a block's passes hold is bounded by its distinct items, not by its slices."""

import tracemalloc

import numpy as np
import pyarrow as pa

from fleetstate.llm import common as C
from fleetstate.llm import ppm
from fleetstate.llm.blocks import Lookup


def test_distinct_items_are_tallied_as_slices_come(monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 1 << 16)
    r = np.random.default_rng(5)
    texts = [bytes(r.choice(np.frombuffer(b"abcdefgh ", np.uint8), 8192)) for _ in range(800)]
    sizes, blob = [len(x) for x in texts], pa.compress(b"".join(texts), codec="zstd", asbytes=True)
    held = np.arange(len(texts)) % 4 == 0
    tracemalloc.start()
    keys, counts = ppm._distinct(sizes, blob, held, ppm.grams)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # about 100 slices, each with nearly all of the 59,000 distinct n-grams, twice: all of them at once are 150 MB
    assert len(keys) > 59_000 and peak < 60 << 20
    g, starts = ppm.grams(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
    u, at = np.unique(g, return_inverse=True)
    assert np.array_equal(keys, u)
    assert np.array_equal(counts, np.bincount(at, np.repeat(~held, np.diff(starts))))


def test_empty_texts_and_blocks():
    g, starts = ppm.grams(np.frombuffer(b"ab", np.uint8), np.array([0, 0, 2, 2]))
    assert starts.tolist() == [0, 1, 4, 5] and [int(x) & 255 for x in g] == [ppm.STOP, 97, 98, ppm.STOP, ppm.STOP]
    keys, counts = ppm._distinct([], b"", np.zeros(0, bool), ppm.grams)
    assert len(keys) == len(counts) == 0


def test_look_ups_need_little_beside_their_result():
    keys = np.arange(1, 1001, dtype=np.uint64)
    table = Lookup(keys, np.arange(1000, dtype=np.float64))
    asked = np.arange(1 << 21, dtype=np.uint64) % np.uint64(2000)
    tracemalloc.start()
    got = table.get(asked, -1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, np.where((asked >= 1) & (asked <= 1000), asked.astype(float) - 1, -1.0))
    assert peak < 2 * got.nbytes

"""Packing of many sources: turns of whole pieces, carried deficits, bounded distance from the shares."""
import collections
import math
import statistics

import pytest

from fleetstate.llm import packing
from tests.llm.conftest import SCHEMA, doc
from tests.llm.test_layout import check_pieces

ROWS = [doc(1000 * s + i, "word " * (20 + 60 * (s == 0)), source=f"s{s:03}") for s in range(100) for i in range(20 if s else 200)] + [doc(10**6 + i, "tiny", source="tiny") for i in range(3)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


def shares(pieces):
    total, window = collections.Counter(), collections.defaultdict(collections.Counter)
    for p in pieces:
        total[p["queue"]] += p["length"]
        window[p["sequence_id"]][p["queue"]] += p["length"]
    return total, window


def off(windows, until, queue, share):
    """How far a run of windows gets from the share at most."""
    ahead, low, high = 0.0, 0.0, 0.0
    size = None
    for k in range(until):
        size = size or sum(windows[k].values())
        ahead += windows[k][queue] - share * size
        low, high = min(low, ahead), max(high, ahead)
    return high - low


def bound(share, window, piece, accounts):
    return 12 * piece + 2 * share * (window + piece * accounts)


def sequential(docs, shares, window, piece):
    """Deficit round-robin with counters that are carried: the pieces (doc, start, size) in their order."""
    level = {q: min(max(math.floor(-math.log2(s)), 0), packing.ACCOUNTS - 1) for q, s in shares.items()}
    queues = collections.defaultdict(list)
    for i, q, n in docs:
        k = max(1, n // piece)
        queues[q] += [(i, n * j // k, n * (j + 1) // k - n * j // k) for j in range(k)]

    def rounds(lines, quantum):
        lines = {q: collections.deque(v) for q, v in lines.items()}
        deficit = dict.fromkeys(lines, 0.0)
        while any(lines.values()):
            for q in sorted(lines):
                deficit[q] += quantum[q]
                while lines[q] and lines[q][0][2] <= deficit[q] + 1e-6:
                    deficit[q] -= lines[q][0][2]
                    yield lines[q].popleft()

    accounts = {}
    for c in set(level.values()):
        mine = {q: queues[q] for q in queues if level[q] == c}
        accounts[c] = list(rounds(mine, {q: shares[q] * 2.0 ** (c + 1) * piece for q in mine}))
    return list(rounds(accounts, {c: window * sum(s for q, s in shares.items() if level[q] == c) for c in accounts}))


@pytest.mark.parametrize("targets", [None, {"a": 0.55, "b": 0.3, "c": 0.1, "d": 0.05}])
def test_order_is_that_of_a_sequential_round_robin(spark, targets):
    rows = [doc(i, "word " * (7 * i % 150), source="aaaaaabbbccd"[i % 12]) for i in range(240)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).coalesce(1).sortWithinPartitions("doc_id"), window=64, piece=16, targets=targets).collect()
    check_pieces(rows, got, 64)
    tokens = {p["doc_id"]: p["doc_tokens"] for p in got}
    source = {r[0]: r[3] for r in rows}
    total = collections.Counter()
    for i, n in tokens.items():
        total[source[i]] += n
    weights = targets or {q: n / sum(total.values()) for q, n in total.items()}
    want = []
    for i, start, size in sequential([(i, source[i], tokens[i]) for i in sorted(tokens)], weights, 64, 16):
        want += [(i, t) for t in range(start, start + size)]
    have = [(p["doc_id"], t) for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])) for t in range(p["start"], p["start"] + p["length"])]
    assert have == want


def test_each_of_many_sources_has_its_share(df):
    got = packing.pack(df, window=512, piece=16).collect()
    check_pieces(ROWS, got, 512)
    total, window = shares(got)
    assert len(total) == 101 and set(total) == {r[3] for r in ROWS}
    size = sum(total.values())
    assert all(off(window, max(window), q, n / size) < bound(n / size, 512, 16, 3) for q, n in total.items())


def test_targets_hold_with_many_sources(df):
    got = packing.pack(df, window=128, targets={"s000": 0.2, "s005": 0.5, "s077": 0.3}, piece=8).collect()
    check_pieces(ROWS, got, 128)
    total, window = shares(got)
    lasts = int(min(total["s000"] / 0.2, total["s005"] / 0.5, total["s077"] / 0.3)) // 128
    assert lasts >= 5
    assert all(off(window, lasts, q, w) < bound(w, 128, 8, 2) for q, w in (("s000", 0.2), ("s005", 0.5), ("s077", 0.3)))
    wanted = [k for k, w in window.items() if set(w) & {"s000", "s005", "s077"}]
    assert max(wanted) <= sum(total[q] for q in ("s000", "s005", "s077")) // 128  # the others come after


def test_documents_stay_in_whole_pieces_with_a_thousand_sources(spark):
    hot = [doc(i, "word " * 1500, source="hot") for i in range(400)]
    rows = hot + [doc(10**4 + i, "word " * 600, source=f"s{i % 1000:04}") for i in range(2000)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(6)).drop("ids").collect()
    assert sum(p["length"] for p in got) == sum({p["doc_id"]: p["doc_tokens"] for p in got}.values())
    assert statistics.median(p["length"] for p in got) >= packing.PIECE
    total, window = shares(got)
    share = total["hot"] / sum(total.values())
    assert 0.3 < share < 0.4 and off(window, max(window), "hot", share) < bound(share, 1024, 256, 2)
    runs = [sum(window[k]["hot"] for k in range(a, a + 16)) / (16 * 1024) for a in range(0, max(window) - 16)]
    assert all(abs(r - share) < 0.1 for r in runs)


def test_five_thousand_sources_of_different_sizes(spark):
    rows = [doc(i, "a b " * (1 + i % 97), source=f"site{i % 5000}") for i in range(10_000)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(6)).drop("ids").collect()
    total, window = shares(got)
    assert len(total) == 5000 and sum(total.values()) == sum({p["doc_id"]: p["doc_tokens"] for p in got}.values())
    assert all(sum(w.values()) == 1024 for k, w in window.items() if k < max(window))

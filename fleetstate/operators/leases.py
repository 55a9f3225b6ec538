"""Leases over time (D6 with D8): claims of an id in order, each lease expiring after a timeout.

A claim wins if no lease is held at its second; the lease then stands until ``timeout`` seconds have
passed (strictly, in whole seconds, as a due record is), after which the next claim wins again. Which
claims win is a chain: after a winner, the next one is the first later claim beyond its expiry. The
successor of every claim is found by a sorted search and chains are followed by pointer doubling, as
in ``cas_chain``; nothing loops over rows.

What a run of claims does is a function of the last lease before it, and such functions compose. So a
hot id is split over range partitions, and only a partition's first run, which may begin under a
lease of an earlier partition, is kept as a function. That lease was taken before the run's first
claim and expires a timeout after it at the latest, so what matters is the first claim of each second
up to there and the next one: a step function of as many steps as a timeout has seconds, at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstate.functions.fold import last_so_far
from fleetstate.operators.cas_chain import _runs
from fleetstate.session import materialize

ORDER = ["ts", "claimant", "seq", "tiebreak"]  # a total order of the claims of an id
NEVER = -(1 << 62)  # time of the last lease where there was none


class _Leases:
    """The claims of a batch in runs, by second ``t``, and the successor of each."""

    def __init__(self, t: np.ndarray, first: np.ndarray, timeout: int):
        self.n, self.t, self.first, self.timeout = len(t), t, first, timeout
        head = np.zeros(self.n, bool)
        head[first] = True
        self.run = np.cumsum(head) - 1
        self.end = np.append(first[1:], self.n)
        self.base = int(t.min()) - 1
        self.width = int(t.max()) - self.base + 1
        self.key = self.run * self.width + (t - self.base)  # ascends over the whole batch
        self.successor = self.find(self.run, t)

    def find(self, run: np.ndarray, last: np.ndarray) -> np.ndarray:
        """First claim of each run that comes after a lease taken at ``last`` has expired, else n."""
        beyond = np.clip(np.maximum(last, NEVER // 2) + self.timeout - self.base, 0, self.width - 1)
        at = np.searchsorted(self.key, run * self.width + beyond, side="right")
        return np.where(at < self.end[run], at, self.n)

    def rounds(self) -> range:
        return range(int((self.end - self.first).max()).bit_length())

    def won(self, entry: np.ndarray) -> np.ndarray:
        on = np.zeros(self.n + 1, bool)
        on[entry] = True
        jump = np.append(self.successor, self.n)
        for _ in self.rounds():
            on[jump[np.flatnonzero(on)]] = True
            jump = jump[jump]
        return on[: self.n]

    def last(self) -> np.ndarray:
        """The last winner of the chain through each claim."""
        at = np.where(self.successor < self.n, self.successor, np.arange(self.n))
        for _ in self.rounds():
            at = at[at]
        return at


class _Run:
    """A border run. ``steps``: (second, last winner), by the second of the claim that wins first; a
    lease that expires after all of them stands on. A run that isn't the first of its chunk starts its
    id, so its first claim wins."""

    def __init__(self, key: tuple, opens: bool):
        self.key, self.opens = key, opens
        self.steps: list[tuple[int, tuple]] = []  # (second, (second of the last winner, claimant, ts))
        self.begin = self.seen = None  # second of the first and the latest claim so far
        self.closed = False  # the first claim beyond the timeout was there

    def _firsts(self, t: np.ndarray, timeout: int) -> list[int]:
        """Rows that may win first."""
        if not self.opens:
            return [] if self.steps else [0]
        if self.closed:
            return []
        new = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        new = new[t[new] > self.seen] if self.seen is not None else new
        inside = t[new] <= (t[0] if self.begin is None else self.begin) + timeout
        self.closed = not inside.all()
        return [*new[inside].tolist(), *new[~inside][:1].tolist()]

    def add(self, part: pa.RecordBatch, timeout: int) -> None:
        t = part.column("t").to_numpy(zero_copy_only=False).astype(np.int64)
        x = _Leases(t, np.zeros(1, np.int64), timeout)
        end = x.last()

        def winner(row: int) -> tuple:
            return int(t[row]), part.column("claimant")[row].as_py(), part.column("ts")[row].value

        exits = np.array([s[1][0] for s in self.steps], np.int64)
        entry = x.find(np.zeros(len(exits), np.int64), exits)
        steps = [(s, winner(int(end[e])) if e < x.n else w) for (s, w), e in zip(self.steps, entry.tolist())]
        steps += [(int(t[r]), winner(int(end[r]))) for r in self._firsts(t, timeout)]
        self.begin, self.seen = t[0] if self.begin is None else self.begin, t[-1]
        self.steps = []
        for s, w in steps:  # neighbours that end alike are one step
            if self.steps and self.steps[-1][1] == w:
                self.steps[-1] = (s, w)
            else:
                self.steps.append((s, w))

    def rows(self) -> list[tuple]:
        return [(*self.key, self.opens, s, *w) for s, w in self.steps]


_NAMES = ["id", "chunk", "open", "until", "at", "claimant", "ts"]
_TYPES = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64()]


def _batch(rows, types, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)


def _borders(timeout: int):
    """First and last run of each chunk of a partition sorted by id, chunk and ORDER."""
    def scan(batches):
        held: _Run | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first, goes_on = _runs(batch, held and held.key)
            ends = np.append(first[1:], batch.num_rows)
            of_run = batch.column("chunk").to_numpy(zero_copy_only=False)[first]
            for r in range(len(first)) if (of_run != of_run[0]).any() else sorted({0, len(first) - 1}):
                a, b = int(first[r]), int(ends[r])
                if not (r == 0 and goes_on):
                    changed = held is None or held.key[1] != of_run[r]
                    if held is not None and (held.opens or changed):
                        yield _batch(held.rows(), _TYPES, _NAMES)
                    held = _Run((batch.column("id")[a].as_py(), int(of_run[r])), changed)
                held.add(batch.slice(a, b - a), timeout)
        if held is not None:
            yield _batch(held.rows(), _TYPES, _NAMES)

    return scan


def _starts(timeout: int):
    """The lease that each border run begins under, from its rows sorted by id, chunk and step."""
    names, types = ["id", "chunk", "at", "claimant", "ts"], [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()]

    def scan(batches):
        rid = chunk = lease = before = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["id"] != rid:
                    rid, chunk, lease = r["id"], None, (NEVER, None, None)
                if r["chunk"] != chunk:
                    chunk, before, taken = r["chunk"], lease, False
                    out.append((rid, chunk, *before))
                if not taken and (not r["open"] or r["until"] > before[0] + timeout):
                    lease, taken = (r["at"], r["claimant"], r["ts"]), True
            if out:
                yield _batch(out, types, names)

    return scan


_OUT = "id string, ts timestamp, claimant string, seq bigint, tiebreak bigint, outcome string, holder string, lease_ts timestamp, expires bigint"


def _walk(timeout: int):
    """Outcome and lease of every claim, from the lease that its run begins under."""
    names = pa.array(["Fail", "Success"])

    def walk(batches):
        held = None  # key, lease
        for batch in batches:
            if not batch.num_rows:
                continue
            first, goes_on = _runs(batch, held and held[0])
            at = pa.array(first)
            t = batch.column("t").to_numpy(zero_copy_only=False).astype(np.int64)
            last, who, when = (batch.column(c).take(at) for c in ("s_at", "s_claimant", "s_ts"))
            if goes_on:
                last, who, when = (pa.concat_arrays([pa.array([v], c.type), c.slice(1)]) for v, c in zip(held[1], (last, who, when)))
            begin = last.to_numpy(zero_copy_only=False).astype(np.int64)
            x = _Leases(t, first, timeout)
            won = x.won(x.find(np.arange(len(first)), begin))
            row = last_so_far(won, first, x.run)
            place = pa.array(np.where(row >= 0, row, x.n + x.run))
            holder = pa.concat_arrays([batch.column("claimant"), who.cast(batch.column("claimant").type)]).take(place)
            lease = pa.concat_arrays([batch.column("ts").cast(pa.int64()), when]).take(place)
            second = np.concatenate([t, begin])[np.where(row >= 0, row, x.n + x.run)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", *ORDER)), names.take(pa.array(won.astype(np.int64))), holder, lease.cast(batch.column("ts").type), pa.array(second + timeout)],
                ["id", *ORDER, "outcome", "holder", "lease_ts", "expires"])
            held = ((batch.column("id")[-1].as_py(), batch.column("chunk")[-1].as_py()), (int(second[-1]), holder[-1].as_py(), lease[-1].as_py()))

    return walk


def lease_history(claims: DataFrame, timeout: int, partitions: int | None = None) -> DataFrame:
    """Every claim (id, ts, claimant, seq, tiebreak) with its outcome and the lease that stands after
    it: holder, lease_ts (when it was taken) and expires (its last second).

    Claims without an id or a time have no place and are left out. Claims at one time are in the order
    of claimant, seq and tiebreak."""
    spark = claims.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["id", *ORDER]
    rows = claims.where("id is not null and ts is not null").select("id", F.col("ts").cast("timestamp").alias("ts"), "claimant", F.col("seq").cast("bigint").alias("seq"), F.col("tiebreak").cast("bigint").alias("tiebreak"))
    rows = rows.withColumn("t", F.unix_seconds("ts")).repartitionByRange(n, *by).withColumn("chunk", F.spark_partition_id())
    rows = materialize(rows)  # both branches must see the same chunks
    borders = rows.sortWithinPartitions("id", "chunk", *ORDER).select("id", "chunk", "t", "claimant", "ts").mapInArrow(
        _borders(timeout), "id string, chunk int, open boolean, until long, at long, claimant string, ts long")
    starts = borders.repartition(n, "id").sortWithinPartitions("id", "chunk", "until").mapInArrow(
        _starts(timeout), "id string, chunk int, at long, claimant string, ts long").select("id", "chunk", F.col("at").alias("s_at"), F.col("claimant").alias("s_claimant"), F.col("ts").alias("s_ts"))
    # two rows a partition at most
    all_ = rows.join(F.broadcast(starts), ["id", "chunk"], "left").withColumn("s_at", F.coalesce("s_at", F.lit(NEVER)))
    return all_.select(*by, "t", "chunk", "s_at", "s_claimant", "s_ts").sortWithinPartitions("id", "chunk", *ORDER).mapInArrow(_walk(timeout), _OUT)

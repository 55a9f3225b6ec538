"""F3 over a stream: waiting for a state while it happens.

A wait (id, wait_id, ts, target, allowed, deadline) is open from its registration until its id
reaches the target state, enters a state that isn't allowed, or its deadline passes. Both sides,
waits and transitions, meet in the state of their id's group. They are applied in event-time order behind a
reorder buffer, so a wait may come before or after the transition that ends it, and the outcome is the
same for any cut into micro-batches and any order within the watermark's delay.

Rules: at registration the id's current state decides at once, if it is the target or isn't allowed.
At one time transitions come before waits, and an event at the deadline itself still counts. Each
registered wait gets one row; those that the watermark hasn't decided stay open.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetstate.streaming.lifecycle import GROUPS, STATEFUL_CONF, ReorderBuffer, group_of, pack, unpack, values

EVENT = ["ts_us", "side", "seq", "kind", "wait_id", "target", "allowed", "deadline_us", "id"]
OUTPUT = "id string, wait_id bigint, target string, status string, at_us bigint, waited_us bigint, state_kind string"
_SEPARATOR = "\n"  # between the names of allowed states


class WaitProcessor(StatefulProcessor):
    """Open waits and the current state of every id of a group."""

    def __init__(self, initial_kind: str | None):
        self.initial_kind = initial_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getValueState("ids", "packed binary")  # by id: state, open waits
        self.buffer = ReorderBuffer(handle, "events")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.buffer.add(list(zip(*(values(pdf, c) for c in EVENT))))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        ready, first = self.buffer.release(watermark)
        ids = unpack(self.ids.get()) or {}
        late = [rid for rid, (_, waits) in ids.items() if rid not in ready and any(w[3] <= watermark * 1000 for w in waits)]
        done: list[tuple] = []
        for rid in [*ready, *late]:
            kind, waits = ids.get(rid, (self.initial_kind, []))
            ids[rid] = self._happen(rid, kind, waits, sorted(ready.get(rid, []), key=lambda e: e[:3]), watermark * 1000, done)
        if ready or late:
            self.ids.update((pack(ids),))
        deadlines = [-(-w[3] // 1000) for _, waits in ids.values() for w in waits]
        self.buffer.wake_at(min(deadlines + ([] if first is None else [first]), default=None))
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    @staticmethod
    def _happen(rid, kind, waits, events, watermark_us: int, done: list[tuple]) -> tuple:
        """State and open waits of an id after its events, in order; waits that end are added to ``done``.
        Open waits of one target and one set of allowed states are judged together, and deadlines stand
        in a heap, so an event costs by these sets and by the waits that it ends, not by the open ones."""
        waiting: dict[tuple, dict] = {}  # by target and allowed states: open waits, by number
        deadlines: list[tuple] = []  # (deadline, number, target and allowed states); ended waits leave theirs behind
        numbers = count()

        def add(w):
            n = next(numbers)
            waiting.setdefault(w[1:3], {})[n] = w
            heappush(deadlines, (w[3], n, w[1:3]))

        def end(w, status, at):
            done.append((rid, w[0], w[1], status, at, at - w[4], kind))

        def expire(until_us):
            while deadlines and deadlines[0][0] <= until_us:
                _, n, what = heappop(deadlines)
                w = waiting.get(what, {}).pop(n, None)
                if w is not None:
                    end(w, "timed_out", w[3])
                    if not waiting[what]:
                        del waiting[what]

        def verdict(target, allowed) -> str | None:
            """How the current state ends a wait, if it does."""
            if kind == target:
                return "reached"
            return "failed" if kind is not None and kind not in (allowed or "").split(_SEPARATOR) else None

        for w in waits:
            add(w)
        for ts_us, side, _, to, wait_id, target, allowed, deadline_us in events:
            expire(ts_us - 1)
            if side == 0:
                kind = to
                for what in list(waiting):
                    status = verdict(*what)
                    if status is not None:
                        for w in waiting.pop(what).values():
                            end(w, status, ts_us)
            else:
                w = (wait_id, target, allowed, deadline_us, ts_us)
                status = verdict(target, allowed)
                if status is None:
                    add(w)
                else:
                    end(w, status, ts_us)
        expire(watermark_us)
        return kind, [w for some in waiting.values() for w in some.values()]

    def close(self) -> None:
        pass


def wait_stream(transitions: DataFrame, waits: DataFrame, watermarks: tuple[str, str], initial_kind: str | None = "WaitToStart",
                groups: int = GROUPS) -> DataFrame:
    """Outcome of every wait: id, wait_id, target, status (reached, failed, timed_out), at_us, waited_us
    and state_kind (the state that decided, or that it was in at the deadline).

    ``transitions``: id, ts, seq, to_kind (applied ones, e.g. of a transition log). ``waits``: id,
    wait_id, ts, target, allowed (array of states that may be passed through), deadline (timestamp);
    one whose deadline is before its registration times out at its deadline, unless its id's state
    decides first. ``watermarks``: how late rows of either stream may come; each has a watermark of its
    own, and the one behind counts. ``initial_kind``: the state of an id before its
    first transition (None: unknown, which decides nothing). Rows without an id or a time, and waits
    without a target or deadline, have no place and are left out. Ids share state in ``groups`` by hash,
    as in ``lifecycle_stream``."""
    spark = transitions.sparkSession
    for k, v in STATEFUL_CONF.items():
        spark.conf.set(k, v)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    time = F.col("ts").cast("timestamp").alias("ts")
    none = lambda t: F.lit(None).cast(t)
    left = transitions.where("id is not null and ts is not null").select(
        "id", time, us("ts").alias("ts_us"), F.lit(0).alias("side"), F.col("seq").cast("bigint").alias("seq"), F.col("to_kind").alias("kind"),
        F.lit(0).cast("bigint").alias("wait_id"), none("string").alias("target"), none("string").alias("allowed"), F.lit(0).cast("bigint").alias("deadline_us"))
    right = waits.where("id is not null and ts is not null and target is not null and deadline is not null").select(
        "id", time, us("ts").alias("ts_us"), F.lit(1).alias("side"), F.col("wait_id").cast("bigint").alias("seq"), none("string").alias("kind"),
        F.col("wait_id").cast("bigint").alias("wait_id"), "target", F.array_join("allowed", _SEPARATOR).alias("allowed"), us("deadline").alias("deadline_us"))
    # by the session's policy for several watermarks the least one counts, so neither source is late for the other
    events = left.withWatermark("ts", watermarks[0]).unionByName(right.withWatermark("ts", watermarks[1]))
    return events.select("*", group_of(groups)).groupBy("group").transformWithStateInPandas(
        statefulProcessor=WaitProcessor(initial_kind), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")

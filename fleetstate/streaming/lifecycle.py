"""Structured Streaming: the lifecycle per id as keyed state (G1), trigger timeouts as event-time
timers (G2), fixed-rate monitor rounds (G3) and streaming ingest (G4).

Rules we set for streams: signals of one id are applied in (ts, seq) order inside a micro-batch;
a signal not newer than the last applied one is dropped and counted; a removed id keeps a
tombstone so later commands are NotFound; with a TTL the tombstone is dropped by an event-time
timer once the watermark passes removal time + TTL (event time keeps drains finite and results
reproducible, unlike a processing-time TTL). Output is append-only: one row
per id per micro-batch (or timer) carrying a ``version`` that rises with event time; the latest
row per id is the current state (``latest_per_id``). A trigger state whose deadline is past at the
time of the next signal is timed out before that signal, whether its timer fired in an earlier
micro-batch or not, so the result doesn't depend on how signals are cut into batches.

With ``reorder`` signals wait in an event-time buffer until the watermark has passed them, so that
any order and any cut into micro-batches within the watermark's delay gives what the batch replay
gives. With ``initial`` a stream starts from existing records, as the batch replay does.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetstate.functions.rules import BUILT_IN, RuleTable, compile_rules
from fleetstate.functions.step import Stepper
from fleetstate.model import Params
from fleetstate.session import ensure_checkpoint_dir, remove_path

STATE_SCHEMA = ("s int, m string, n bigint, last_ts bigint, last_seq bigint, "
                "n_signals bigint, n_applied bigint, n_dropped bigint, version bigint")
OUTPUT_SCHEMA = ("id string, state_kind string, state_message string, next_update_time bigint, "
                 "n_signals bigint, n_applied bigint, n_dropped bigint, version bigint, via string")
GROUPS = 256  # of ids that share one value of state behind a reorder buffer
GROUP_ROWS = 4096  # rows that a group should hold
STATEFUL_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


class LifecycleProcessor(StatefulProcessor):
    """Keyed lifecycle state; input rows: id, ts_us, t (epoch seconds), seq, signal, msg."""

    def __init__(self, p: Params, auto_timeout: bool = False, tombstone_ttl_s: int | None = None, explicit_create: bool = False,
                 rules: RuleTable = BUILT_IN, seeded: bool = False):
        self.p = p
        self.explicit_create = explicit_create
        self.auto_timeout = auto_timeout
        self.tombstone_ttl_s = tombstone_ttl_s
        self.rules = rules
        self.seeded = seeded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lifecycle", STATE_SCHEMA)
        self.tomb = handle.getValueState("tombstone", "n_dropped bigint, expire_s bigint, version bigint")
        self.stepper = Stepper(self.p, self.rules)
        self.signal_index = {s: i for i, s in enumerate(self.rules.signals)}
        self.triggers = self.rules.triggers

    def _load(self):
        if self.state.exists():
            return list(self.state.get())
        return [self.rules.removed if self.seeded else 0, None, None, None, None, 0, 0, 0, 0]

    def _row(self, key, st, via):
        s, m, n, _, _, n_sig, n_app, n_drop, ver = st
        return pd.DataFrame({
            "id": [key], "state_kind": [self.rules.states[s]], "state_message": [m],
            "next_update_time": pd.array([n], dtype="Int64"), "n_signals": [n_sig], "n_applied": [n_app],
            "n_dropped": [n_drop], "version": [ver], "via": [via]})

    def _save(self, st, now_s: int | None = None):
        """Write the state and set its timers."""
        timed = self.auto_timeout or self.tombstone_ttl_s is not None
        if timed:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if st[0] == self.rules.removed and self.tombstone_ttl_s is not None:
            expire = int(now_s) + self.tombstone_ttl_s
            self.state.clear()
            self.tomb.update((st[7], expire, st[8]))
            self.handle.registerTimer(expire * 1000)
            return
        self.state.update(tuple(st))
        if self.auto_timeout and st[0] in self.triggers and st[2] is not None:
            # due is strict in whole seconds: the first second after the deadline
            self.handle.registerTimer((int(st[2]) + 1) * 1000)

    def _time_out(self, s, m, n, t: int):
        """What a trigger state is at second ``t``: back to waiting once its deadline is past."""
        if self.auto_timeout and s in self.triggers and n is not None and int(n) < t:
            s, m, n, _ = self.stepper.step(s, m, n, self.signal_index["TIMEOUT"], None, int(n) + 1)
        return s, m, n

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A record that exists before the stream does; input: state_kind, state_message, next_update_time."""
        for kind, m, n in zip(initialState["state_kind"], initialState["state_message"], initialState["next_update_time"]):
            if kind in self.rules.states:
                self._save([self.rules.states.index(kind), None if pd.isna(m) else m, None if pd.isna(n) else int(n), None, None, 0, 0, 0, 0])

    def _apply(self, st: list, signals, there: bool) -> tuple[list, bool]:
        """The state after signals (ts_us, seq, signal, msg) in order, and whether there is a record;
        ``there``: whether there was one."""
        s, m, n, last_ts, last_seq, n_sig, n_app, n_drop, ver = st
        for ts_us, seq, sig, x_msg in signals:
            t = ts_us // 1_000_000
            if last_ts is not None and (ts_us, seq) <= (last_ts, last_seq):
                n_drop += 1
                continue
            if not there:
                if sig != "CREATE":  # no such record: NotFound
                    n_drop += 1
                    continue
                there, s, m, n = True, 0, None, t
                n_sig, n_app, last_ts, last_seq = n_sig + 1, n_app + 1, ts_us, seq
                continue
            g = self.signal_index.get(sig, -1)
            s, m, n = self._time_out(s, m, n, t)  # as its timer would have, had it come first
            s, m, n, oc = self.stepper.step(s, m, n, g, x_msg, t)
            n_sig += 1
            n_app += oc == "Applied"
            last_ts, last_seq = ts_us, seq
        # versions follow event time, so they rise even after an expired tombstone took the state along
        return [s, m, n, last_ts, last_seq, n_sig, n_app, n_drop, max(ver + 1, last_ts or 0)], there

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (rid,) = key
        signals = sorted((x for pdf in rows for x in _signals(pdf)), key=lambda x: x[:2])
        removed_version = 0
        if self.tomb.exists() and not self.state.exists() and self.explicit_create and any(x[2] == "CREATE" for x in signals):
            removed_version = int(self.tomb.get()[2])
            self.tomb.clear()
        if self.tomb.exists() and not self.state.exists():  # removed earlier: everything is NotFound
            n_drop, expire, ver = self.tomb.get()
            n_drop, ver = int(n_drop) + len(signals), int(ver) + 1
            self.tomb.update((n_drop, expire, ver))
            yield self._row(rid, [self.rules.removed, None, None, None, None, 0, 0, n_drop, ver], "tombstone")
            return
        st = self._load()
        st[8] = max(st[8], removed_version)
        st, there = self._apply(st, signals, not self.explicit_create or self.state.exists())
        if not there:
            return
        self._save(st, None if st[3] is None else st[3] // 1_000_000)
        yield self._row(rid, st, "signals")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (rid,) = key
        fire_s = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if not self.state.exists():
            if self.tomb.exists() and int(self.tomb.get()[1]) == fire_s:
                self.tomb.clear()  # tombstone expired: the id may be created again
            return
        st = self._load()
        if st[0] in self.triggers and st[2] is not None and int(st[2]) + 1 == fire_s:
            s, m, n = self._time_out(st[0], st[1], st[2], fire_s)
            st = [s, m, n] + st[3:8] + [max(st[8] + 1, fire_s * 1_000_000)]
            self._save(st, fire_s)
            yield self._row(rid, st, "timer")

    def close(self) -> None:
        pass


def _signals(pdf: pd.DataFrame) -> list[tuple]:
    """(ts_us, seq, signal, msg) of the rows of a frame."""
    texts = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in ("signal", "msg")]
    return list(zip(pdf["ts_us"].tolist(), pdf["seq"].tolist(), *texts))


class ReorderedProcessor(LifecycleProcessor):
    """Lifecycle states of a group of ids behind an event-time reorder buffer.

    Signals are only appended to the group's buffer when they come, whatever their number and order. A
    timer stands at the earliest of them; once the watermark has passed it, nothing before the
    watermark can come any more, and all signals up to there are applied in order, id by id. So a group
    holds the signals of one watermark delay at most, and its records. Records that the stream starts
    from are kept apart and written once: those of ids without signals are never read again, but for
    the deadlines of trigger states."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stepper = Stepper(self.p, self.rules)
        self.signal_index = {s: i for i, s in enumerate(self.rules.signals)}
        self.triggers = self.rules.triggers
        self.buffer = ReorderBuffer(handle, "signals")
        self.records = handle.getValueState("records", "packed binary")
        self.seeds = handle.getListState("seeds", "packed binary")

    def _due(self, st) -> int | None:
        """When a record's trigger state times out; due is strict in whole seconds."""
        return (int(st[2]) + 1) * 1000 if self.auto_timeout and st[0] in self.triggers and st[2] is not None else None

    def handleInitialState(self, key, initialState, timerValues) -> None:
        kinds = {k: i for i, k in enumerate(self.rules.states)}
        timed, seeds = unpack(self.records.get()) or {}, {}
        for rid, kind, m, n in zip(*(values(initialState, c) for c in ("id", "state_kind", "state_message", "next_update_time"))):
            if kind not in kinds:
                continue
            st = [kinds[kind], m, n, None, None, 0, 0, 0, 0]
            timed.pop(rid, None)
            if self._due(st) is None:
                seeds[rid] = (kinds[kind], m, n)
            else:
                timed[rid] = st
        if seeds:
            self.seeds.appendValue((pack(seeds),))
        if timed:
            self.records.update((pack(timed),))
            self.buffer.wake(min(map(self._due, timed.values())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.buffer.add(list(zip(*(values(pdf, c) for c in ("ts_us", "seq", "signal", "msg", "id")))))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        ready, first = self.buffer.release(watermark)
        records = unpack(self.records.get()) or {}
        if any(rid not in records for rid in ready):
            for (packed,) in self.seeds.get():
                records.update((rid, [*x, None, None, 0, 0, 0, 0]) for rid, x in unpack(packed).items() if rid in ready and rid not in records)
        out = []
        timed = [rid for rid, st in records.items() if rid not in ready and self._due(st) is not None and self._due(st) <= watermark]
        for rid in [*ready, *timed]:
            st, via = records.get(rid), "signals"
            if rid in ready:
                there = not self.explicit_create or st is not None
                st, there = self._apply(st or [self.rules.removed if self.seeded else 0, None, None, None, None, 0, 0, 0, 0], sorted(set(ready[rid]), key=lambda x: x[:2]), there)
                if not there:
                    continue
            if self._due(st) is not None and self._due(st) <= watermark:
                s, m, n = self._time_out(st[0], st[1], st[2], int(st[2]) + 1)
                st, via = [s, m, n] + st[3:8] + [max(st[8] + 1, (int(st[2]) + 1) * 1_000_000)], "timer"
            records[rid] = st
            out.append((rid, self.rules.states[st[0]], st[1], st[2], *st[5:9], via))
        if out:
            self.records.update((pack(records),))
        self.buffer.wake_at(min([x for x in (first, *map(self._due, records.values())) if x is not None], default=None))
        if out:
            done = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT_SCHEMA.split(", ")])
            yield done.astype({"next_update_time": "Int64"})


def values(pdf: pd.DataFrame, column: str) -> list:
    """A column as Python values, nulls as None; whole numbers stay whole beside nulls."""
    c = pdf[column]
    whole = pd.api.types.is_float_dtype(c)
    return [None if n else int(x) if whole else x for x, n in zip(c.tolist(), c.isna().tolist())]


def pack(what) -> bytes:
    return pickle.dumps(what, pickle.HIGHEST_PROTOCOL)


def unpack(row):
    """What a state's value (a row of one binary column, or its bytes) holds; None: nothing."""
    return None if row is None else pickle.loads(row[0] if isinstance(row, tuple) else row)


class ReorderBuffer:
    """Rows of a group of ids that wait for the watermark, and the group's timer. A row's first column
    is its event time in microseconds, the last one its id."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.handle = handle
        self.rows = handle.getListState(f"{name}_waiting", "packed binary")
        self.timer = handle.getValueState(f"{name}_timer", "ms bigint")

    def wake_at(self, ms: int | None) -> None:
        """Move the group's one timer."""
        row = self.timer.get()
        old = None if row is None else int(row[0])
        if old == ms:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if ms is None:
            self.timer.clear()
        else:
            self.timer.update((ms,))
            self.handle.registerTimer(ms)

    def wake(self, ms: int) -> None:
        """Move the timer forward, if it stands later."""
        row = self.timer.get()
        if row is None or ms < int(row[0]):
            self.wake_at(ms)

    def add(self, rows: list[tuple]) -> None:
        if rows:
            self.rows.appendValue((pack(rows),))
            self.wake(-(-min(r[0] for r in rows) // 1000))

    def release(self, watermark_ms: int) -> tuple[dict, int | None]:
        """Take out the rows up to the watermark, by id and without the id; and when the next are due."""
        ready: dict = {}
        left = []
        for (packed,) in self.rows.get():
            for r in unpack(packed):
                if r[0] <= watermark_ms * 1000:
                    ready.setdefault(r[-1], []).append(r[:-1])
                else:
                    left.append(r)
        if ready and left:
            self.rows.put([(pack(left),)])
        elif ready:
            self.rows.clear()
        return ready, -(-min(r[0] for r in left) // 1000) if left else None


def group_of(groups: int):
    """The group whose state an id shares."""
    return F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group")


def groups_for(rows: int) -> int:
    """Groups of ids for a stream that holds ``rows`` rows (waiting ones and records) in its state."""
    return max(GROUPS, -(-rows // GROUP_ROWS))


def prepare_stream(signals: DataFrame) -> DataFrame:
    return signals.select(
        "id", F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
        "seq", "signal", "msg")


def lifecycle_stream(signals: DataFrame, p: Params, auto_timeout: bool = False,
                     watermark: str = "0 seconds", tombstone_ttl_s: int | None = None,
                     clock: str = "event", explicit_create: bool = False, reorder: bool = False,
                     initial: DataFrame | None = None, edges: DataFrame | None = None, groups: int = GROUPS) -> DataFrame:
    """Per-id lifecycle state over a signal stream (id, ts, seq, signal, msg).

    With ``auto_timeout`` a record left in a trigger state is sent back to waiting once its next
    update time has passed: on the event-time watermark (``clock="event"``, reproducible; drains
    with availableNow) or on the wall clock (``clock="processing"``, for live monitors; needs a
    continuing trigger). The deadline and the TIMEOUT transition are the same in both.

    With ``explicit_create`` only the signal CREATE makes a record (WaitToStart, next update at its
    time); signals of ids without one are NotFound: dropped and, once the record exists, counted.
    Use it with tombstones, so that a late command can't bring back an id whose tombstone expired.
    Without it every id starts in WaitToStart, as in the batch replay.

    With ``reorder`` signals are applied in (ts, seq) order across micro-batches, once the
    ``watermark`` has passed them; repeats of a signal count once, and only what comes later than the
    watermark's delay is lost. What the last watermark hasn't passed stays in the state. Ids then share
    state in ``groups`` by hash, so a micro-batch costs a few state calls a group, not an id; a group
    is read and written whole (``groups_for``), and its number is fixed for a checkpoint.

    ``initial`` (id, state_kind, state_message, next_update_time), a static frame, seeds the state in
    the first micro-batch: ids begin as their record there, and ids without one are removed. ``edges``:
    a caller's rule table (D12).
    """
    if reorder and (clock != "event" or tombstone_ttl_s is not None):
        raise ValueError("reordering is by event time, without tombstones that expire")
    if clock not in ("event", "processing"):
        raise ValueError("clock must be 'event' or 'processing'")
    spark = signals.sparkSession
    for k, v in STATEFUL_CONF.items():
        spark.conf.set(k, v)
    src = prepare_stream(signals)
    timed = auto_timeout or tombstone_ttl_s is not None or reorder
    if timed and clock == "event":  # timers (trigger timeouts, tombstone expiry, reordering) run on event time
        src = src.withWatermark("ts", watermark)
    mode = "None" if not timed else ("EventTime" if clock == "event" else "ProcessingTime")
    kind = ReorderedProcessor if reorder else LifecycleProcessor
    processor = kind(p, auto_timeout, tombstone_ttl_s, explicit_create, compile_rules(edges), initial is not None)
    keyed = (lambda df: df.select("*", group_of(groups)).groupBy("group")) if reorder else (lambda df: df.groupBy("id"))
    seed = None
    if initial is not None:
        seed = keyed(initial.select("id", "state_kind", "state_message", F.col("next_update_time").cast("bigint").alias("next_update_time")))
    return keyed(src).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUTPUT_SCHEMA, outputMode="Append", timeMode=mode, initialState=seed)


def latest_per_id(out: DataFrame) -> DataFrame:
    """Current state per id from the append-only output (max version; partial aggregation)."""
    last = F.max_by(F.struct(*[c for c in out.columns if c != "id"]), "version").alias("_l")
    return out.groupBy("id").agg(last).select("id", "_l.*")


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def run_available_now(stream: DataFrame, out_dir: str, checkpoint: str) -> None:
    """Drain everything available into an append-only parquet sink, then stop (tests, backfills)."""
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", out_dir).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def ingest_stream(orders_or_requests: DataFrame, out_dir: str, checkpoint: str, p: Params,
                  to_requests: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True,
                  retry_window: str | None = None, registry: DataFrame | Callable[[int], DataFrame] | None = None):
    """Strict ingest on a stream; good records and dead letters go to two sinks, in one write that
    is partitioned by validity.

    Each batch is written under ``batch=<epoch>`` with overwrite, so a retried batch replaces its
    own output (idempotent sink).

    With ``retry_window`` a request may be delivered more than once (columns request_id, ts, ...): the
    stream keeps the ids of requests until the watermark is that much past them, and lets each through
    once, within a batch and over batches. ``registry`` (id, ...; or a function of the epoch that gives
    it) has the records that exist already: requests whose record is there, delivered again after any
    time, make nothing, and go to ``existing/batch=<epoch>`` with their id."""
    from fleetstate.sources.ingest import bulk_create, validate_requests

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        req = to_requests(batch) if to_requests else batch
        staged = f"{out_dir}/checked/batch={epoch}"
        # one pass over the micro-batch: bodies are validated once, and the two kinds parted by the write
        valid = validate_requests(req).withColumn("valid", F.col("reason").isNull())
        valid.write.mode("overwrite").partitionBy("valid").parquet(staged)
        checked = spark.read.schema(valid.schema).parquet(staged)
        fields = [c for c in valid.columns if c not in ("reason", "detail", "valid")]
        good = bulk_create(checked.where("valid").select(*fields), p)
        if registry is not None:
            known = (registry(epoch) if callable(registry) else registry).select("id").distinct()
            good.join(known, "id", "left_semi").select("id").write.mode("overwrite").parquet(f"{out_dir}/existing/batch={epoch}")
            good = good.join(known, "id", "left_anti")
        good.write.mode("overwrite").parquet(f"{out_dir}/good/batch={epoch}")
        checked.where("not valid").select(*req.columns, "reason", "detail").write.mode("overwrite").parquet(f"{out_dir}/rejects/batch={epoch}")
        remove_path(spark, staged)

    if retry_window is not None:
        for k, v in STATEFUL_CONF.items():
            orders_or_requests.sparkSession.conf.set(k, v)
        orders_or_requests = orders_or_requests.withWatermark("ts", retry_window).dropDuplicatesWithinWatermark(["request_id"])
    w = orders_or_requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


COMMAND = {"ts": "timestamp", "seq": "bigint", "signal": "string", "msg": "string"}


def monitor_rounds(observations: DataFrame, registry_root: str, outcomes, checkpoint: str,
                   p: Params, now_fn: Callable[[int], int] | None = None, interval_seconds: int | None = None,
                   obs_order: list[str] | None = None, commands: DataFrame | None = None, compact_every: int = 1,
                   edges: DataFrame | None = None):
    """The monitor as a fixed-rate stream, the only writer of its registry. Round ``e`` reads the
    version that round ``e - 1`` completed and writes, in this order:

    * ``phases``, version e+1: the latest observation of every id so far. A record without a new
      observation keeps its last phase; one never observed reads as Unknown; a pod that is gone is
      observed as NotExisted.
    * ``commands/batch=e``, with ``commands``: each command of the micro-batch with its outcome
      (Applied, NotAllowed, NotFound), as the transition log has them. The commands are folded onto the
      registry in (ts, seq) order, before the round, which then sees what they left.
    * ``log/batch=e``: the transitions made (id, from_kind, signal, state_kind, state_message,
      next_update_time, ts, seq), the commands' first: theirs have their own time and number, the
      round's its clock and none.
    * the registry, version e+1. Its _SUCCESS file, written last, completes the round.

    A round that failed before that is written anew from the same version; a completed one is not
    repeated. ``registry_root`` starts with ``v=0``. With ``compact_every`` k > 1 only every k-th
    version is whole; the others are change sets, so that a round writes in proportion to what it
    changed (``operators.layers``; read with ``layers.read_version``).

    ``outcomes``: id, err_msg, or a function of the round's number that gives them. ``now_fn`` gives a
    round's clock (default: the wall clock). ``commands``: a stream of id, ts, seq, signal (STOP,
    RESTART, DELETE), msg. ``edges``: a caller's rule table (D12).

    ``interval_seconds`` None drains what is available (tests); otherwise a rate stream of ticks
    beside the observations makes every interval a round, new observations or not (a round that
    overruns its interval starts the next one at once).
    """
    import time

    from fleetstate.operators.layers import read_version, version_complete, write_version
    from fleetstate.operators.observe import OBS_ORDER
    from fleetstate.operators.planning import sync_round
    from fleetstate.operators.registry import apply_changes
    from fleetstate.operators.replay import replay_log

    order = obs_order or OBS_ORDER
    state = ["state_kind", "state_message", "next_update_time"]

    def write_phases(spark: SparkSession, seen: DataFrame, epoch: int) -> DataFrame:
        """The latest observation of every id, from what earlier rounds wrote and this one saw."""
        newest = lambda df: df.groupBy("id").agg(F.max(F.struct(*order, "phase")).alias("_l")).select("id", "_l.*")
        root = f"{registry_root}/phases"
        parts = [f"{root}/{'v' if v % compact_every == 0 else 'changes/v'}={v}" for v in range(epoch // compact_every * compact_every, epoch + 1) if v]
        before = [spark.read.schema(seen.schema).parquet(x) for x in parts]
        if (epoch + 1) % compact_every == 0:
            for x in before:
                seen = seen.unionByName(x)
            newest(seen).write.mode("overwrite").parquet(f"{root}/v={epoch + 1}")
            return spark.read.schema(seen.schema).parquet(f"{root}/v={epoch + 1}")
        newest(seen).write.mode("overwrite").parquet(f"{root}/changes/v={epoch + 1}")
        every = spark.read.schema(seen.schema).parquet(f"{root}/changes/v={epoch + 1}")
        for x in before:
            every = every.unionByName(x)
        return every

    def fold_commands(spark: SparkSession, batch: DataFrame, reg: DataFrame, rp: Params, epoch: int) -> tuple[DataFrame, DataFrame]:
        """(transitions, changes) of the batch's commands; their log is written."""
        asked = batch.where("_command is not null").select("id", "_command.*")
        path = f"{registry_root}/commands/batch={epoch}"
        replay_log(asked, rp, initial=reg, edges=edges).write.mode("overwrite").parquet(path)
        made = spark.read.parquet(path).where("outcome = 'Applied'")
        last = made.groupBy("id").agg(F.max_by(F.struct(F.col("to_kind").alias("state_kind"), *state[1:]), F.struct("ts", "seq")).alias("s"))
        changes = last.select("id", *[F.col(f"s.{c}").alias(c) for c in state], (F.col("s.state_kind") == "Removed").alias("removed"))
        return made.select("id", "from_kind", "signal", F.col("to_kind").alias("state_kind"), *state[1:], "ts", "seq"), changes

    def round_(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if version_complete(spark, registry_root, epoch + 1):
            return  # this round ended, but its commit in the stream's checkpoint didn't
        if not version_complete(spark, registry_root, epoch):
            raise RuntimeError(f"{registry_root}/v={epoch} isn't a complete snapshot")
        rp = Params(now=now_fn(epoch) if now_fn else int(time.time()), interval=p.interval, timeout=p.timeout)
        reg = now = read_version(spark, registry_root, epoch)
        seen = batch.where(F.col("id").isNotNull())
        seen = (seen.where("_command is null") if commands is not None else seen).select("id", *order, "phase")
        phases = write_phases(spark, seen, epoch)
        moved = changes = None
        if commands is not None:
            moved, changes = fold_commands(spark, batch, reg, rp, epoch)
            now = apply_changes(reg, changes)
        results = outcomes(epoch) if callable(outcomes) else outcomes
        done = sync_round(now, phases, results, rp, edges=edges, obs_order=order, absent_phase="Unknown").where("status = 'ok'").select(
            "id", "from_kind", F.col("action").alias("signal"), *state, F.timestamp_seconds(F.lit(rp.now)).alias("ts"), F.lit(None).cast("bigint").alias("seq"))
        log = f"{registry_root}/log/batch={epoch}"
        (done if moved is None else moved.unionByName(done)).write.mode("overwrite").parquet(log)
        own = spark.read.parquet(log).where("seq is null").select("id", *state, F.lit(False).alias("removed"))
        if changes is not None:  # a record that both changed ends as the round left it; the round has one row an id
            own = changes.withColumn("_by", F.lit(0)).unionByName(own.withColumn("_by", F.lit(1))).groupBy("id").agg(
                F.max_by(F.struct(*state, "removed"), "_by").alias("s")).select("id", "s.*")
        write_version(reg, own, registry_root, epoch + 1, compact_every)

    if commands is not None:
        # apart from the observations' columns, whatever these are called
        asked = commands.select("id", F.struct(*[F.col(c).cast(t).alias(c) for c, t in COMMAND.items()]).alias("_command"))
        observations = observations.withColumn("_command", F.lit(None).cast(asked.schema["_command"].dataType)).unionByName(asked, allowMissingColumns=True)
    if interval_seconds is not None:
        ticks = observations.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in observations.schema.fields]
        observations = observations.unionByName(ticks.select(*blank))
    w = observations.writeStream.foreachBatch(round_).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if interval_seconds is None else w.trigger(processingTime=f"{interval_seconds} seconds")
    q = w.start()
    if interval_seconds is None:
        q.awaitTermination()
    return q

"""Lifecycle replay: the ordered fold of signals per id, its transition log, and derived reports.

Order is ``(ts, seq)``. Each signal is a function on the fold states (12 + Removed) that also
rewrites the message (clear / keep / set / append / const) and the next update time, and function
composition is associative. That lets the fold run in two levels so that no id - however hot - is
ever collected into one task:

1. ``repartitionByRange(P, id, ts, seq)``: sampled range boundaries split a hot id across several
   partitions ("chunks"); each chunk is bounded by the partition size.
2. Per (id, chunk) run: what the run does to the states it can start with, by a vectorised prefix
   over whole Arrow batches (``functions.fold``). Only a partition's first run can go on from an
   earlier partition, so only it is folded from every state; any other run starts its id.
3. An id goes through several chunks only where it is the first or last run of a partition. Those
   runs - two a partition, whatever the data - are applied in chunk order; all others are final.

The transition log needs the state before every signal. Only the states that partitions' first runs
begin with are unknown: one row a partition, found by the same passes over first and last runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstate.functions.fold import Fold
from fleetstate.functions.rules import BUILT_IN, RuleTable, compile_rules
from fleetstate.model import ERROR_SEPARATOR, Params
from fleetstate.session import materialize

INITIAL_STATE = 0  # every replay starts in WaitToStart, no message, no next update time


def signal_index(col: str = "signal", rules: RuleTable = BUILT_IN):
    kv = []
    for i, s in enumerate(rules.signals):
        kv += [F.lit(s), F.lit(i)]
    return F.coalesce(F.try_element_at(F.create_map(*kv), F.col(col)), F.lit(-1))


def unordered_signals(signals: DataFrame) -> DataFrame:
    """Signals without an id, time or sequence number: they have no place in a history. The folds
    leave them out; this is where they are found."""
    return signals.where(F.col("id").isNull() | F.col("ts").isNull() | F.col("seq").isNull())


def prepare(signals: DataFrame, rules: RuleTable = BUILT_IN, initial: DataFrame | None = None) -> DataFrame:
    """Fold input: id, ts, seq, signal, msg, its number g and second t, and the state (i_s, i_m, i_n)
    that its id begins with: WaitToStart, or its record in ``initial`` (absent ids begin removed, so
    their signals are NotFound)."""
    rows = signals.where(F.col("id").isNotNull() & F.col("ts").isNotNull() & F.col("seq").isNotNull()).select(
        "id", "ts", "seq", "signal", "msg", signal_index("signal", rules).alias("g"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    if initial is None:
        return rows.select("*", F.lit(INITIAL_STATE).alias("i_s"), F.lit(None).cast("string").alias("i_m"), F.lit(None).cast("bigint").alias("i_n"))
    index = F.array_position(F.array(*[F.lit(x) for x in rules.states]), F.col("state_kind")).cast("int") - 1
    init = initial.select("id", index.alias("i_s"), F.col("state_message").alias("i_m"), F.col("next_update_time").cast("bigint").alias("i_n"))
    return rows.join(init, "id", "left").withColumn("i_s", F.coalesce("i_s", F.lit(rules.removed)))


def chunked(signals: DataFrame, partitions: int | None = None, rules: RuleTable = BUILT_IN, initial: DataFrame | None = None) -> DataFrame:
    """Range-partition signals by (id, ts, seq) and tag each row with its chunk (= partition)."""
    n = partitions or int(signals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (prepare(signals, rules, initial).repartitionByRange(n, "id", "ts", "seq")
            .withColumn("chunk", F.spark_partition_id()))


RUN_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("chunk", T.IntegerType()), T.StructField("border", T.BooleanType()),
    T.StructField("start", T.IntegerType()), T.StructField("s", T.IntegerType()), T.StructField("mk", T.BooleanType()),
    T.StructField("mt", T.StringType()), T.StructField("nk", T.BooleanType()), T.StructField("nv", T.LongType()),
    T.StructField("na", T.LongType()), T.StructField("n_sig", T.LongType()),
    T.StructField("i_s", T.IntegerType()), T.StructField("i_m", T.StringType()), T.StructField("i_n", T.LongType())])
_NAMES = RUN_SCHEMA.names
_TYPES = [pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()]


def _numbers(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False)


def _same_as_before(col: pa.Array) -> np.ndarray:
    """Whether each row but the first has the value of the row before it."""
    return pc.equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)


def _runs(batch: pa.RecordBatch, held_id: str | None, held_chunk: int | None) -> tuple[np.ndarray, bool]:
    """First rows of the (id, chunk) runs of a batch, and whether its first run goes on from the last batch."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = ~(_same_as_before(batch.column("id")) & _same_as_before(batch.column("chunk")))
    goes_on = held_id is not None and batch.column("id")[0].as_py() == held_id and batch.column("chunk")[0].as_py() == held_chunk
    return np.flatnonzero(new), goes_on


class _Held:
    """The run at the end of a batch, which may go on in the next one: an entry per start state."""

    def __init__(self, rid, chunk, border, starts, i_s, i_m, i_n):
        self.id, self.chunk, self.border, self.n_sig = rid, chunk, border, 0
        self.init = (i_s, i_m, i_n)
        self.entries = [[x, x, True, "", True, None, 0] for x in starts]  # start, s, mk, mt, nk, nv, na

    def add(self, rules: RuleTable, p: Params, g, t, msg) -> None:
        """Apply the rows of one run to every entry."""
        one = Fold(rules, p, g, t, msg, np.zeros(1, np.int64))
        self.n_sig += len(g)
        known: dict[int, tuple] = {}
        for e in self.entries:
            if e[1] not in known:
                x = one.ends(np.array([e[1]]))
                known[e[1]] = (int(x["s"][0]), bool(x["mk"][0]), x["mt"][0].as_py(), bool(x["nk"][0]), None if x["nn"][0] else int(x["nv"][0]), int(x["na"][0]))
            s, mk, mt, nk, nv, na = known[e[1]]
            e[1], e[6] = s, e[6] + na
            if not mk:
                e[2], e[3] = False, mt
            elif mt != "":
                e[3] = None if e[3] is None or mt is None else e[3] + mt
            if not nk:
                e[4], e[5] = False, nv

    def rows(self) -> list[tuple]:
        return [(self.id, self.chunk, self.border, *e, self.n_sig, *self.init) for e in self.entries]


def _fold_runs(rules: RuleTable, p: Params, borders_only: bool = False):
    """Fold the (id, chunk) runs of a partition sorted by (id, chunk, ts, seq): RUN_SCHEMA rows.

    ``border`` marks a partition's first and last run of a chunk; its first run has a row for every
    start state, any other run one row. mk: the message is kept from the start and mt added to it,
    else mt is the message; nk: next-update time kept, else nv; na: transitions.
    ``borders_only`` leaves the other runs out, which then aren't folded."""
    every = range(len(rules.states))

    def fold(batches: Iterator[pa.RecordBatch]):
        held: _Held | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first, goes_on = _runs(batch, held and held.id, held and held.chunk)
            ends = np.append(first[1:], batch.num_rows)
            ids, chunks, msg = batch.column("id"), _numbers(batch.column("chunk")), batch.column("msg")
            g, t = _numbers(batch.column("g")).astype(np.int64), _numbers(batch.column("t")).astype(np.int64)
            init = [batch.column(c) for c in ("i_s", "i_m", "i_n")]

            def begin(r: int) -> _Held:
                at = int(first[r])
                opens = held is None or chunks[at] != (chunks[at - 1] if at else held.chunk)
                i_s, i_m, i_n = (c[at].as_py() for c in init)
                return _Held(ids[at].as_py(), int(chunks[at]), opens, every if opens else [i_s], i_s, i_m, i_n)

            out = []
            if not goes_on:
                if held:
                    held.border |= held.chunk != chunks[0]
                    if held.border or not borders_only:
                        out.append(held.rows())
                held = begin(0)
            held.add(rules, p, g[: ends[0]], t[: ends[0]], msg.slice(0, int(ends[0])))
            if len(first) > 1:
                # where the chunk number changes, a run is the last of one chunk or the first of the next
                begun = chunks[first[1:]] != chunks[first[1:] - 1]
                held.border |= bool(begun[0])
                if held.border or not borders_only:
                    out.append(held.rows())
                inner = [r for r in range(1, len(first) - 1)] if begun.any() else None
                alone = np.arange(1, len(first) - 1) if inner is None else np.array([r for r in inner if not begun[r - 1]], np.int64)
                for r in () if inner is None else inner:
                    if begun[r - 1]:
                        h = begin(r)
                        h.add(rules, p, g[first[r]: ends[r]], t[first[r]: ends[r]], msg.slice(int(first[r]), int(ends[r] - first[r])))
                        out.append(h.rows())
                is_last = np.append(begun, False)  # of its chunk, by run
                keep = alone if not borders_only else alone[is_last[alone]]
                if len(keep):
                    yield _single_runs(rules, p, keep, first, ends, is_last, ids, chunks, g, t, msg, init)
                r = len(first) - 1
                held = begin(r)
                held.add(rules, p, g[first[r]:], t[first[r]:], msg.slice(int(first[r])))
            if out:
                yield _as_batch([x for rows in out for x in rows])
        if held:
            held.border = True
            yield _as_batch(held.rows())

    return fold


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _single_runs(rules, p, keep, first, ends, is_last, ids, chunks, g, t, msg, init) -> pa.RecordBatch:
    """Rows of whole runs that start their id, all at once."""
    size = ends[keep] - first[keep]
    if size.sum() == len(g):
        at = None
        own = first[keep]
    else:
        own = np.cumsum(size) - size
        at = np.repeat(first[keep] - own, size) + np.arange(int(size.sum()))
    cut = (lambda x: x) if at is None else (lambda x: x[at])
    start_rows = pa.array(first[keep])
    i_s, i_m, i_n = (c.take(start_rows) for c in init)
    start = _numbers(i_s).astype(np.int64)
    e = Fold(rules, p, cut(g), cut(t), msg if at is None else msg.take(pa.array(at)), own).ends(start)
    cols = [ids.take(start_rows), chunks[first[keep]], is_last[keep], start, e["s"], e["mk"], e["mt"], e["nk"], None, e["na"], size, i_s, i_m, i_n]
    cols[8] = pa.array(e["nv"], pa.int64(), mask=e["nn"] | e["nk"])
    return pa.RecordBatch.from_arrays([c.cast(t_) if isinstance(c, pa.Array) else pa.array(c).cast(t_) for c, t_ in zip(cols, _TYPES)], _NAMES)


def run_tables(chunks: DataFrame, rules: RuleTable, p: Params, borders_only: bool = False) -> DataFrame:
    """Level 2: what the runs of chunked signals do (RUN_SCHEMA), in one sorted pass per partition."""
    cols = ["id", "chunk", "g", "msg", "t", "i_s", "i_m", "i_n"]
    return chunks.sortWithinPartitions("id", "chunk", "ts", "seq").select(*cols).mapInArrow(_fold_runs(rules, p, borders_only), RUN_SCHEMA)


def chunk_tables(signals: DataFrame, p: Params, partitions: int | None = None, edges: DataFrame | None = None) -> DataFrame:
    """RUN_SCHEMA rows of the signals' chunks."""
    rules = compile_rules(edges)
    return run_tables(chunked(signals, partitions, rules), rules, p)


def _apply(state: tuple, e: tuple) -> tuple:
    """(s, m, n) after a run whose row for start state s is ``e``: (s, mk, mt, nk, nv)."""
    s, mk, mt, nk, nv = e
    _, m, n = state
    m = mt if not mk else m if mt == "" else None if m is None or mt is None else m + mt
    return s, m, n if nk else nv


def _chain(starts: bool):
    """Apply the border runs of each id in chunk order, from RUN_SCHEMA rows sorted by id, chunk; one
    state is held at a time, and there are about two runs a partition. Other runs are whole ids, and
    are finished column by column. ``starts``: give the state before each border run instead of the
    state after the last."""
    names = ["id", "chunk", "s", "m", "n"] if starts else ["id", "s", "m", "n", "n_sig", "n_app"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()] if starts else [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    def scan(batches):
        rid = state = None
        n_sig = n_app = 0
        last = None  # (chunk, the state it began with, whether it is applied)
        for batch in batches:
            border = _numbers(batch.column("border")).astype(bool)
            if not starts and not border.all():
                yield _whole(batch.filter(pa.array(~border)))
            out = []
            for r in batch.filter(pa.array(border)).to_pylist():
                if r["id"] != rid:
                    if rid is not None and not starts:
                        out.append((rid, *state, n_sig, n_app))
                    rid, state, n_sig, n_app, last = r["id"], (r["i_s"], r["i_m"], r["i_n"]), 0, 0, None
                if r["chunk"] != last:  # the first of the chunk's rows
                    last, before = r["chunk"], state
                    n_sig += r["n_sig"]
                    if starts:
                        out.append((rid, last, *before))
                if r["start"] == before[0]:
                    state = _apply(before, (r["s"], r["mk"], r["mt"], r["nk"], r["nv"]))
                    n_app += r["na"]
            if out:
                yield batch_of(out)
        if rid is not None and not starts:
            yield batch_of([(rid, *state, n_sig, n_app)])

    def _whole(b: pa.RecordBatch) -> pa.RecordBatch:
        mk, nk = b.column("mk"), b.column("nk")
        kept = pc.if_else(pc.equal(b.column("mt"), ""), b.column("i_m"), pc.binary_join_element_wise(b.column("i_m"), b.column("mt"), ""))
        kept = pc.if_else(pc.is_null(b.column("mt")), pa.scalar(None, pa.string()), kept)
        m = pc.if_else(mk, kept, b.column("mt"))
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("s"), m, pc.if_else(nk, b.column("i_n"), b.column("nv")), b.column("n_sig"), b.column("na")], names)

    return scan


def _chained(tables: DataFrame, starts: bool) -> DataFrame:
    n = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = tables.repartition(n, "id").sortWithinPartitions("id", "chunk")
    return t.mapInArrow(_chain(starts), "id string, chunk int, s int, m string, n long" if starts else "id string, s int, m string, n long, n_sig long, n_app long")


def replay_state(signals: DataFrame, p: Params, partitions: int | None = None,
                 initial: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """final state of every id after all its signals, in order.

    ``initial`` (id, state_kind, state_message, next_update_time), e.g. a registry snapshot, makes
    the fold start from each record's current state: ordered commands applied to the latest
    state, which is what a command that loses a race and retries amounts to. ``edges``: a caller's
    rule table (D12), compiled first. Output: id, state_kind, state_message, next_update_time,
    n_signals, n_applied.
    """
    rules = compile_rules(edges)
    tables = run_tables(chunked(signals, partitions, rules, initial), rules, p)
    states = F.array(*[F.lit(s) for s in rules.states])
    return _chained(tables, False).select(
        "id", states[F.col("s")].alias("state_kind"), F.col("m").alias("state_message"),
        F.col("n").alias("next_update_time"), F.col("n_sig").alias("n_signals"), F.col("n_app").alias("n_applied"))


def chunk_starts(tables: DataFrame) -> DataFrame:
    """The state that each border run starts from: a prefix pass over two runs a partition."""
    return _chained(tables.where("border"), True)


LOG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()), T.StructField("signal", T.StringType()),
    T.StructField("from_kind", T.StringType()), T.StructField("to_kind", T.StringType()),
    T.StructField("outcome", T.StringType()), T.StructField("state_message", T.StringType()),
    T.StructField("next_update_time", T.LongType()),
])


def _log_fold(rules: RuleTable, p: Params):
    """States before and after every row of a partition sorted by (id, chunk, ts, seq). A run begins
    with (s0, m0, n0) of its first row; the last run's state carries over to the next batch."""
    names = pa.array(rules.states)
    outcomes = pa.array(["Applied", "NotAllowed", "NotFound"])

    def fold(batches):
        held = None  # id, chunk, state, message, next-update time
        for batch in batches:
            if not batch.num_rows:
                continue
            first, goes_on = _runs(batch, held and held[0], held and held[1])
            at = pa.array(first)
            s0 = _numbers(batch.column("s0").take(at)).astype(np.int64)
            m0, n0 = batch.column("m0").take(at), batch.column("n0").take(at)
            if goes_on:
                s0 = s0.copy()
                s0[0] = held[2]
                m0 = pa.concat_arrays([pa.array([held[3]], pa.string()), m0.slice(1)])
                n0 = pa.concat_arrays([pa.array([held[4]], pa.int64()), n0.slice(1)])
            g, t = (_numbers(batch.column(c)).astype(np.int64) for c in ("g", "t"))
            x = Fold(rules, p, g, t, batch.column("msg"), first).rows(s0, m0, n0)
            what = np.where(x["applied"], 0, np.where(x["before"] == rules.removed, 2, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("ts"), batch.column("seq"), batch.column("signal"), names.take(pa.array(x["before"])),
                 names.take(pa.array(x["after"])), outcomes.take(pa.array(what)), x["message"], x["next"]], LOG_SCHEMA.names)
            held = (batch.column("id")[-1].as_py(), batch.column("chunk")[-1].as_py(), int(x["after"][-1]), x["message"][-1].as_py(), x["next"][-1].as_py())

    return fold


def replay_log(signals: DataFrame, p: Params, partitions: int | None = None,
               initial: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """A5: the transition log of the replay - one row per signal with the state before and after.

    outcome: Applied, NotAllowed (no edge from the current state), NotFound (record removed).
    Only first and last runs of chunks are folded to learn what the first runs begin with: at most
    two rows a partition, so they are broadcast whatever the data's size. Every chunk is then walked
    once, where it is, without another shuffle.
    """
    rules = compile_rules(edges)
    ch = materialize(chunked(signals, partitions, rules, initial))  # both branches must see the same chunks
    starts = chunk_starts(run_tables(ch, rules, p, borders_only=True)).select("id", "chunk", F.col("s").alias("s1"), F.col("m").alias("m1"), F.col("n").alias("n1"), F.lit(True).alias("known"))
    rows = ch.join(F.broadcast(starts), ["id", "chunk"], "left")
    begin = lambda c: F.when(F.col("known"), F.col(f"{c}1")).otherwise(F.col(f"i_{c}")).alias(f"{c}0")
    return rows.select("id", "chunk", "ts", "seq", "signal", "g", "t", "msg", begin("s"), begin("m"), begin("n")).sortWithinPartitions("id", "chunk", "ts", "seq").mapInArrow(_log_fold(rules, p), LOG_SCHEMA)


def error_history(signals: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every action error of an id, oldest first, joined with the error separator.

    Two levels like the fold: per (id, chunk) the messages of a range partition in order, then per
    id the chunk texts in chunk order (string concatenation is associative).
    """
    errs = signals.where((F.col("signal") == "RELEASE_ERR") & F.col("msg").isNotNull())
    spark = signals.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = F.array_sort(F.collect_list(F.struct("ts", "seq", "msg")))  # of one id in one range partition
    runs = (errs.select("id", "ts", "seq", "msg").repartitionByRange(n, "id", "ts", "seq")
            .groupBy("id", F.spark_partition_id().alias("chunk"))
            .agg(F.array_join(F.transform(run, lambda x: x["msg"]), ERROR_SEPARATOR).alias("txt"), F.count(F.lit(1)).alias("n")))
    return runs.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "txt"))), lambda x: x["txt"]),
                     ERROR_SEPARATOR).alias("history"),
        F.sum("n").cast("bigint").alias("n_errors"))


def time_to_state(log: DataFrame, target: str, allowed: list[str]) -> DataFrame:
    """did each id reach ``target`` before entering a state outside ``allowed``?

    Works on the transition log: the first applied transition into the target against the
    first applied transition into any unexpected state (aggregates with map-side combine).
    """
    applied = log.where(F.col("outcome") == "Applied")
    hit = F.min(F.when(F.col("to_kind") == target, F.struct("ts", "seq")))
    bad = F.min(F.when(~F.col("to_kind").isin(target, *allowed), F.struct("ts", "seq", "to_kind")))
    agg = applied.groupBy("id").agg(hit.alias("h"), bad.alias("b"))
    h_ts, h_seq, b_ts, b_seq = F.col("h.ts"), F.col("h.seq"), F.col("b.ts"), F.col("b.seq")
    reached_first = F.col("h").isNotNull() & (
        F.col("b").isNull() | (h_ts < b_ts) | ((h_ts == b_ts) & (h_seq < b_seq)))
    return agg.select(
        "id",
        F.when(reached_first, "reached").when(F.col("b").isNotNull(), "failed").otherwise("pending").alias("status"),
        F.col("h.ts").alias("reached_ts"), F.col("b.ts").alias("failed_ts"), F.col("b.to_kind").alias("failed_kind"),
    )

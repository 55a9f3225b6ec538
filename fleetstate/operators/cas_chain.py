"""Ordered compare-and-set for batches with several updates per id (D1, same-key batches).

Each update is judged on the state the previous updates of its id left behind, in ``order``. Which
updates win is a chain: after one that won, the next winner is the first later update of the id that
expects the state it wrote. That successor is found for all updates at once by a sorted search, and
chains are followed by pointer doubling, so a batch takes a logarithmic number of numpy calls and no
step loops over rows.

Hot ids are split as in the replay: updates are range-partitioned by (id, ts, seq); an id goes through
several chunks only where it is the first or last run of a partition. A partition's first run may
begin in any state, so it becomes a map from each state that it expects to the state it ends in; those
runs - two a partition - are applied in order to the registry's states, and each chunk is then walked
once from what it starts with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstate.functions.fold import last_so_far, last_true
from fleetstate.session import materialize


def _runs(batch: pa.RecordBatch, held: tuple | None) -> tuple[np.ndarray, bool]:
    """First rows of the (id, chunk) runs of a batch, and whether its first run goes on from the last batch."""
    new = np.ones(batch.num_rows, bool)
    for c, first in (("id", True), ("chunk", False)):
        col = batch.column(c)
        same = pc.fill_null(pc.equal(col.slice(1), col.slice(0, len(col) - 1)), False).to_numpy(zero_copy_only=False)
        new[1:] = ~same if first else new[1:] | ~same
    key = (batch.column("id")[0].as_py(), batch.column("chunk")[0].as_py())
    return np.flatnonzero(new), held is not None and key[0] is not None and key == held


def _key(kind: pa.Array, message: pa.Array) -> pa.Array:
    """One text per state; null where the kind is, which equals nothing."""
    kind, message = kind.cast(pa.string()), message.cast(pa.string())
    tail = pc.if_else(pc.is_null(message), "n", pc.binary_join_element_wise("m", pc.fill_null(message, ""), ""))
    return pc.binary_join_element_wise(kind, tail, "\x00")


class Chains:
    """The updates of a batch, with the successor of each: the update that wins next if it wins."""

    def __init__(self, batch: pa.RecordBatch, first: np.ndarray, starts: list[tuple[pa.Array, pa.Array]] = ()):
        self.n, self.first = batch.num_rows, first
        head = np.zeros(self.n, bool)
        head[first] = True
        self.run = np.cumsum(head) - 1
        states = [_key(batch.column("before_kind"), batch.column("before_message")), _key(batch.column("after_kind"), batch.column("after_message")), *(_key(k, m) for k, m in starts)]
        codes = pa.concat_arrays(states).dictionary_encode()
        self.width = len(codes.dictionary) + 1
        code = np.concatenate([np.zeros(0, np.int64), pc.fill_null(codes.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)])
        self.before, self.after, self.start = code[: self.n], code[self.n: 2 * self.n], code[2 * self.n:]
        expects = np.flatnonzero(self.before >= 0)
        self.places = np.sort((self.run[expects] * self.width + self.before[expects]) * self.n + expects)
        self.successor = self.find(self.run, self.after, np.arange(self.n))

    def find(self, run: np.ndarray, code: np.ndarray, after: np.ndarray) -> np.ndarray:
        """First row of each run that expects the state ``code`` and comes after row ``after``, else n."""
        asked = run * self.width + code
        at = np.searchsorted(self.places, asked * self.n + after, side="right")
        hit = np.append(self.places, -1)[at]
        return np.where((code >= 0) & (hit >= 0) & (hit // self.n == asked), hit % self.n, self.n)

    def won(self, entry: np.ndarray) -> np.ndarray:
        """Which rows are on the chains that begin at the rows ``entry`` (n: none)."""
        on = np.zeros(self.n + 1, bool)
        on[entry] = True
        jump = np.append(self.successor, self.n)
        longest = int(np.diff(np.append(self.first, self.n)).max())
        for _ in range(longest.bit_length()):
            on[jump[np.flatnonzero(on)]] = True
            jump = jump[jump]
        return on[: self.n]

    def ends(self) -> np.ndarray:
        """The last row of the chain through each row."""
        at = np.where(self.successor < self.n, self.successor, np.arange(self.n))
        longest = int(np.diff(np.append(self.first, self.n)).max())
        for _ in range(longest.bit_length()):
            at = at[at]
        return at


def _state(batch: pa.RecordBatch, row: int) -> tuple:
    return tuple(batch.column(c)[row].as_py() for c in ("after_kind", "after_message", "next_update_time"))


class _Border:
    """A chunk's first or last run. ``known``: the state it is in now, if it starts its id; else
    ``map`` has, for each state (kind, message) that an update expects, the state it leads to."""

    def __init__(self, batch: pa.RecordBatch, row: int, opens: bool):
        col = lambda c: batch.column(c)[row].as_py()
        self.key = (col("id"), col("chunk"))
        self.init = (col("k0"), col("m0"), col("n0"), col("f0"))
        self.known = None if opens else self.init[:3]
        self.map: dict[tuple, tuple] = {}

    def add(self, part: pa.RecordBatch) -> None:
        """Apply the rows of one run."""
        states = [self.known[:2]] if self.known else [v[:2] for v in self.map.values()]
        asked = (pa.array([s[0] for s in states], pa.string()), pa.array([s[1] for s in states], pa.string()))
        x = Chains(part, np.zeros(1, np.int64), [asked])
        end = x.ends()
        entry = x.find(np.zeros(len(states), np.int64), x.start, np.full(len(states), -1))
        now = [_state(part, int(end[e])) if e < x.n else None for e in entry]
        if self.known:
            self.known = now[0] or self.known
            return
        for k, to in zip(list(self.map), now):
            self.map[k] = to or self.map[k]
        kinds, messages = part.column("before_kind"), part.column("before_message")
        _, firsts = np.unique(x.before, return_index=True)
        for row in firsts[x.before[firsts] >= 0].tolist():
            k = (kinds[row].as_py(), messages[row].as_py())
            if k not in self.map:  # until now the run would have left this state alone
                self.map[k] = _state(part, int(end[row]))

    def rows(self) -> list[tuple]:
        if self.known:
            return [(*self.key, *self.init, False, None, None, *self.known)]
        moves = [(*k, *to) for k, to in self.map.items()] or [(None,) * 5]
        return [(*self.key, *self.init, True, *m) for m in moves]


_BORDER = "id string, chunk int, k0 string, m0 string, n0 long, f0 boolean, open boolean, fk string, fm string, tk string, tm string, tn long"
_BORDER_TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
_BORDER_NAMES = [x.split()[0] for x in _BORDER.split(", ")]


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)


def _borders(batches):
    """The first and last run of each chunk of a partition sorted by (id, chunk, ts, seq). The runs
    between them aren't looked at."""
    held: _Border | None = None
    opens = True
    for batch in batches:
        if not batch.num_rows:
            continue
        first, goes_on = _runs(batch, held and held.key)
        ends = np.append(first[1:], batch.num_rows)
        chunk = batch.column("chunk").to_numpy(zero_copy_only=False)
        of_run = chunk[first]
        for r in range(len(first)) if (of_run != of_run[0]).any() else sorted({0, len(first) - 1}):
            a, b = int(first[r]), int(ends[r])
            if not (r == 0 and goes_on):
                changed = held is None or held.key[1] != of_run[r]
                if held is not None and (opens or changed):
                    yield _batch(held.rows(), _BORDER_TYPES, _BORDER_NAMES)
                opens = changed
                held = _Border(batch, a, changed)
            held.add(batch.slice(a, b - a))
    if held is not None:
        yield _batch(held.rows(), _BORDER_TYPES, _BORDER_NAMES)


def _starts(batches):
    """The state each border run starts from, in one pass over rows sorted by (id, chunk)."""
    types, names = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()], ["id", "chunk", "s_k", "s_m", "s_n"]
    rid = chunk = None
    state = before = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["id"] != rid:
                rid, chunk, state = r["id"], None, (r["k0"], r["m0"], r["n0"])
            if r["chunk"] != chunk:
                chunk, before = r["chunk"], state
                out.append((rid, chunk, *before))
            if not r["f0"]:
                continue
            if not r["open"] or (r["fk"] is not None and (r["fk"], r["fm"]) == before[:2]):
                state = (r["tk"], r["tm"], r["tn"])
        if out:
            yield _batch(out, types, names)


def _walk(batches):
    """Outcomes of every update, from each (id, chunk) run's start state."""
    held = None  # key, state
    names = pa.array(["Success", "Fail", "NotFound"])
    for batch in batches:
        if not batch.num_rows:
            continue
        first, goes_on = _runs(batch, held and held[0])
        at = pa.array(first)
        k, m, n = (batch.column(c).take(at) for c in ("s_k", "s_m", "s_n"))
        if goes_on:
            k, m, n = (pa.concat_arrays([pa.array([v], c.type), c.slice(1)]) for v, c in zip(held[1], (k, m, n)))
        found = pc.fill_null(batch.column("f0"), False).to_numpy(zero_copy_only=False)
        x = Chains(batch, first, [(k, m)])
        entry = x.find(np.arange(len(first)), x.start, np.full(len(first), -1))
        entry[~found[first]] = x.n
        won = x.won(entry)
        done = last_so_far(won, x.first, x.run)
        before = np.where(np.arange(x.n) > x.first[x.run], np.append(-1, done[:-1]), -1)
        begin = x.n + x.run  # place of a run's start state behind the updates' own
        none = pa.array(~found)

        def state(c: str, start: pa.Array, row: np.ndarray) -> pa.Array:
            both = pa.concat_arrays([batch.column(c), start.cast(batch.column(c).type)])  # noqa: B023
            return pc.if_else(none, pa.scalar(None, both.type), both.take(pa.array(np.where(row >= 0, row, begin))))  # noqa: B023

        cols = [names.take(pa.array(np.where(~found, 2, np.where(won, 0, 1)))), state("after_kind", k, before), state("after_message", m, before),
                state("after_kind", k, done), state("after_message", m, done), state("next_update_time", n, done)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "ts", "seq", "before_kind", "before_message", "after_kind", "after_message")), *cols], OUT_SCHEMA.names)
        last = int(last_true(won, x.first)[-1])
        end = _state(batch, last) if last >= 0 else (k[-1].as_py(), m[-1].as_py(), n[-1].as_py())
        held = ((batch.column("id")[-1].as_py(), batch.column("chunk")[-1].as_py()), end)


OUT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()),
    T.StructField("before_kind", T.StringType()), T.StructField("before_message", T.StringType()),
    T.StructField("after_kind", T.StringType()), T.StructField("after_message", T.StringType()),
    T.StructField("outcome", T.StringType()), T.StructField("current_kind", T.StringType()),
    T.StructField("current_message", T.StringType()), T.StructField("state_kind", T.StringType()),
    T.StructField("state_message", T.StringType()), T.StructField("next_update_time", T.LongType()),
])


def cas_sequence(updates: DataFrame, registry: DataFrame, partitions: int | None = None) -> DataFrame:
    """Ordered CAS: ``updates`` has id, ts, seq (a total order per id), before_kind, before_message,
    after_kind, after_message, next_update_time. Returns one row per update with its outcome
    (Success / Fail / NotFound), the state it met and the state it left. An expected kind of NULL
    equals no state."""
    spark = updates.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = ["id", "ts", "seq", "before_kind", "before_message", "after_kind", "after_message", "next_update_time"]
    s0 = registry.select("id", F.col("state_kind").alias("k0"), F.col("state_message").alias("m0"),
                         F.col("next_update_time").cast("bigint").alias("n0"), F.lit(True).alias("f0"))
    # materialized once: the chunk ids are read by two branches and must agree
    up = materialize(updates.select(*cols).join(s0, "id", "left").repartitionByRange(n, "id", "ts", "seq")
                     .withColumn("chunk", F.spark_partition_id()))
    borders = up.sortWithinPartitions("id", "chunk", "ts", "seq").mapInArrow(_borders, _BORDER)
    starts = (borders.repartition(n, "id").sortWithinPartitions("id", "chunk")
              .mapInArrow(_starts, "id string, chunk int, s_k string, s_m string, s_n long"))
    # two rows a partition at most
    rows = up.join(F.broadcast(starts.withColumn("known", F.lit(True))), ["id", "chunk"], "left")
    begin = lambda c: F.when(F.col("known"), F.col(f"s_{c}")).otherwise(F.col(f"{c}0")).alias(f"s_{c}")
    return rows.select(*cols, "chunk", "f0", begin("k"), begin("m"), begin("n")).sortWithinPartitions("id", "chunk", "ts", "seq").mapInArrow(_walk, OUT_SCHEMA)

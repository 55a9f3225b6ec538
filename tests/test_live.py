"""Reordered and seeded streams, waits, monitors with commands, layered and calendar snapshots, leases, rules."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_replay import cut

from conftest import SF001
from fleetstate.functions.rules import BUILT_IN, compile_rules, rule_report
from fleetstate.functions.step import Stepper
from fleetstate.model import EDGE_SCHEMA, REGISTRY_SCHEMA, SIGNALS, Params, edges_df
from fleetstate.operators import calendar, layers, leases, planning, reduce, registry, replay
from fleetstate.sources import fixtures as X
from fleetstate.streaming import lifecycle as S
from fleetstate.streaming import waits as W

P = Params()
SIGNAL = "id string, ts timestamp, seq long, signal string, msg string"


def signals(spark, rows):
    return spark.createDataFrame(rows, "id string, t long, seq long, signal string, msg string").select("id", F.timestamp_seconds("t").alias("ts"), "seq", "signal", "msg")


def files(spark, root, batches):
    """One file a batch, in this order; a micro-batch takes one."""
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(f"{root}/src")
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/src")


def drained(spark, stream, root, schema):
    S.run_available_now(stream, f"{root}/out", f"{root}/ck")
    return spark.read.schema(schema).parquet(f"{root}/out")


COLS = ["id", "state_kind", "state_message", "next_update_time", "n_signals", "n_applied"]


def history(r, ids=3, n=25):
    lively = ["ACQUIRE", "RELEASE_OK", "RELEASE_ERR", "TIMEOUT", "PHASE_Running", "STOP", "RESTART"]
    out = []
    for i in range(ids):
        for k in range(n):
            g = r.choice(lively) if r.random() < 0.8 else r.choice(SIGNALS)
            out.append((f"id{i}", 1000 + r.randrange(400), k, g, f"m{k}" if g == "RELEASE_ERR" else None))
    return out


@pytest.mark.parametrize("seed, seeded", [(1, False), (2, True), (3, False)])
def test_any_order_and_cut_equals_the_batch_replay(spark, seed, seeded):
    r = random.Random(seed)
    rows = history(r)
    initial = None
    if seeded:
        kinds = [("id0", "Running", None, 5), ("id1", "ErrorClean", "old", None), ("other", "Running", None, 7)]
        initial = spark.createDataFrame(kinds, "id string, state_kind string, state_message string, next_update_time long")
    want = {tuple(x) for x in replay.replay_state(signals(spark, rows), P, initial=initial).select(*COLS).collect()}
    shuffled = rows + r.sample(rows, 10)  # some come twice
    r.shuffle(shuffled)
    batches, at = [], 0
    while at < len(shuffled):
        n = r.choice([5, 20, 40])
        batches.append(signals(spark, shuffled[at: at + n]))
        at += n
    batches.append(signals(spark, [("~end", 5000, 0, "STOP", None)]))
    root = S.scratch_dir(spark, f"reorder{seed}")
    stream = S.lifecycle_stream(files(spark, root, batches), P, watermark="1000 seconds", reorder=True, initial=initial)
    out = S.latest_per_id(drained(spark, stream, root, S.OUTPUT_SCHEMA))
    assert {tuple(x) for x in out.select(*COLS).collect()} == want


def test_signals_wait_for_the_watermark_and_late_ones_are_lost(spark):
    root = S.scratch_dir(spark, "late")
    batches = [[("a", 100, 2, "RELEASE_OK", None)], [("a", 90, 1, "ACQUIRE", None)], [("b", 300, 1, "STOP", None)], [("b", 310, 2, "STOP", None)], [("a", 95, 3, "RELEASE_ERR", "late")], [("b", 900, 3, "RESTART", None)]]
    stream = S.lifecycle_stream(files(spark, root, [signals(spark, b) for b in batches]), P, watermark="50 seconds", reorder=True, auto_timeout=True)
    out = drained(spark, stream, root, S.OUTPUT_SCHEMA)
    cur = {r["id"]: r for r in S.latest_per_id(out).collect()}
    assert cur["a"]["state_kind"] == "StartInProgress" and cur["a"]["n_signals"] == 2
    assert cur["b"]["state_kind"] == "Terminated"  # the last signal is still waiting


def test_timeouts_behind_the_buffer(spark):
    batches = [[("a", 100, 1, "ACQUIRE", None)], [("a", 110, 2, "RELEASE_OK", None), ("b", 100, 1, "ACQUIRE", None)], [("~end", 1000, 1, "STOP", None)]]
    got = []
    for i, b in enumerate([batches, [sum(batches, [])], batches[::-1][1:] + batches[2:]]):
        root = S.scratch_dir(spark, f"buffered-timeout{i}")
        stream = S.lifecycle_stream(files(spark, root, [signals(spark, x) for x in b]), P, watermark="20 seconds", reorder=True, auto_timeout=True)
        cur = S.latest_per_id(drained(spark, stream, root, S.OUTPUT_SCHEMA))
        got.append({r["id"]: (r["state_kind"], r["next_update_time"], r["via"]) for r in cur.collect()})
    assert got[0] == got[1] == got[2]
    assert got[0]["a"][0] == "StartInProgress" and got[0]["b"] == ("WaitToStart", 100 + P.timeout + 1, "timer")


def test_a_stream_by_a_callers_rules(spark):
    rules = spark.createDataFrame([("WaitToStart", "GO", "Flying", "set", "interval", "x", None), ("Flying", "LAND", "Removed", "clear", "none", "x", None)], EDGE_SCHEMA)
    rows = [("a", 10, 1, "GO", "up"), ("b", 10, 1, "GO", "up"), ("b", 11, 2, "LAND", None), ("b", 12, 3, "GO", None), ("c", 10, 1, "STOP", None)]
    root = S.scratch_dir(spark, "own-rules")
    out = S.latest_per_id(drained(spark, S.lifecycle_stream(files(spark, root, [signals(spark, rows)]), P, edges=rules), root, S.OUTPUT_SCHEMA))
    got = {tuple(x) for x in out.select(*COLS).collect()}
    assert got == {("a", "Flying", "up", 10 + P.interval, 1, 1), ("b", "Removed", None, None, 3, 2), ("c", "WaitToStart", None, None, 1, 0)}
    assert got == {tuple(x) for x in replay.replay_state(signals(spark, rows), P, edges=rules).select(*COLS).collect()}
    log = {(r["id"], r["seq"]): (r["from_kind"], r["to_kind"], r["outcome"]) for r in replay.replay_log(signals(spark, rows), P, edges=rules).collect()}
    assert log["b", 2] == ("Flying", "Removed", "Applied") and log["b", 3][2] == "NotFound" and log["c", 1][2] == "NotAllowed"


def test_rule_tables_are_checked(spark):
    assert compile_rules(edges_df(spark)).next.tolist() == BUILT_IN.next.tolist()
    good = ("WaitToStart", "GO", "Running", "clear", "now", "x", None)
    for bad in [[good, good[:2] + ("Terminated",) + good[3:]], [good[:3] + ("shout",) + good[4:]], [good[:4] + ("later",) + good[5:]], [good[:3] + ("const",) + good[4:]], [("Removed",) + good[1:]]]:
        with pytest.raises(ValueError):
            compile_rules(spark.createDataFrame(bad, EDGE_SCHEMA))
    rows = [good, good[:2] + ("Terminated",) + good[3:], ("Island", "GO", "Running", "clear", "now", "x", None)]
    got = {r["state"]: tuple(r)[1:] for r in rule_report(spark.createDataFrame(rows, EDGE_SCHEMA)).collect()}
    assert got == {"WaitToStart": (2, 1, True, 0, False), "Running": (0, 0, True, 1, True), "Terminated": (0, 0, True, 1, True), "Island": (1, 0, False, None, False)}
    assert rule_report(spark.createDataFrame([], EDGE_SCHEMA)).count() == 0
    step = Stepper(P, compile_rules(spark.createDataFrame([good], EDGE_SCHEMA)))
    assert step.step(0, None, None, len(SIGNALS), None, 9) == (3, None, 9, "Applied")


# ---------------------------------------------------------------- waits

def judged(moves, w, start="WaitToStart"):
    """Outcome of a wait by walking its id's transitions one by one."""
    rid, wid, t, target, allowed, deadline = w
    kind = start
    mine = sorted((m[1], m[2], m[3]) for m in moves if m[0] == rid)
    for ts, _, to in mine:
        if ts <= t:
            kind = to
    def end(status, at):
        return (rid, wid, status, at * 1_000_000, kind)
    if kind == target:
        return end("reached", t)
    if kind not in allowed:
        return end("failed", t)
    for ts, _, to in mine:
        if t < ts <= deadline:
            kind = to
            if kind == target:
                return end("reached", ts)
            if kind not in allowed:
                return end("failed", ts)
    return end("timed_out", deadline)


@pytest.mark.parametrize("seed", [1, 2])
def test_waits_before_and_after_the_transition(spark, seed):
    r = random.Random(seed)
    kinds = ["WaitToStart", "TriggerStart", "StartInProgress", "Running", "Terminated", "ErrorClean"]
    moves = [(f"id{r.randrange(4)}", 1000 + r.randrange(300), k, r.choice(kinds)) for k in range(40)]
    asked = [(f"id{r.randrange(5)}", k, 1000 + r.randrange(300), r.choice(kinds[3:]), r.sample(kinds, 3), 0) for k in range(60)]
    asked = [(*w[:5], w[2] + r.choice([0, 5, 50, 400])) for w in asked]
    move = lambda rows: spark.createDataFrame(rows, "id string, t long, seq long, to_kind string").select("id", F.timestamp_seconds("t").alias("ts"), "seq", "to_kind")
    wait = lambda rows: spark.createDataFrame(rows, "id string, wait_id long, t long, target string, allowed array<string>, d long").select(
        "id", "wait_id", F.timestamp_seconds("t").alias("ts"), "target", "allowed", F.timestamp_seconds("d").alias("deadline"))
    m, w = moves[:], asked[:]
    r.shuffle(m)
    r.shuffle(w)
    end = 5000
    root = S.scratch_dir(spark, f"waits{seed}")
    left = files(spark, f"{root}/m", [move(m[:10]), move(m[10:]), move([("~end", end, 0, "x")])])
    right = files(spark, f"{root}/w", [wait(w[:40]), wait(w[40:50]), wait(w[50:]), wait([("~end", 0, end, "x", ["x"], end)])])
    out = drained(spark, W.wait_stream(left, right, ("500 seconds", "500 seconds")), root, W.OUTPUT)
    got = sorted((x["id"], x["wait_id"], x["status"], x["at_us"], x["state_kind"]) for x in out.where("id <> '~end'").collect())
    assert got == sorted(judged(moves, x) for x in asked)
    assert {x[2] for x in got} == {"reached", "failed", "timed_out"}


# ---------------------------------------------------------------- monitors, snapshots

def size(path):
    path = path.removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def records(spark, n, next_time):
    rows = [(f"e{i}", f"name {i}" * 3, "Spark", "3.5.3", "Running", None, {"k": str(i)}, None, next_time if i < 5 else None) for i in range(n)]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def test_layered_rounds_write_what_they_change_and_compaction_keeps_it(spark):
    none = spark.createDataFrame([], "id string, err_msg string")
    schema = "id string, ts long, phase string"
    states = []
    for every in (1, 3):
        root = S.scratch_dir(spark, f"layers{every}")
        registry.write_registry(records(spark, 3000, P.now - 1), f"{root}/registry/v=0")
        for i in range(4):
            spark.createDataFrame([(f"e{j}", i + 1, "Running" if i < 2 else "Failed") for j in range(3)], schema).coalesce(1).write.parquet(f"{root}/obs/{i}")
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/obs")
            S.monitor_rounds(stream, f"{root}/registry", none, f"{root}/ck", P, now_fn=lambda e: P.now + 100 * e, obs_order=["ts"], compact_every=every)
        states.append([sorted(map(str, layers.read_version(spark, f"{root}/registry", v).collect())) for v in range(5)])
        if every == 3:
            assert layers.base_of(spark, f"{root}/registry", 4) == 3 and layers.base_of(spark, f"{root}/registry", 2) == 0
            whole = size(f"{root}/registry/v=0")
            assert all(size(f"{root}/registry/changes/v={v}") < whole / 3 for v in (1, 2, 4))
            assert not os.path.exists(f"{root}/registry/changes/v=3".removeprefix("file:"))
    assert states[0] == states[1] and len(states[0][4]) == 3000


def test_change_sets_create_change_and_remove(spark):
    root = S.scratch_dir(spark, "change-sets")
    registry.write_registry(records(spark, 10, None), f"{root}/v=0")
    types = "id string, state_kind string, state_message string, next_update_time long, name string, version string, created boolean, removed boolean"
    sets = [[("new", "WaitToStart", None, 5, "n", "3.5.4", True, False), ("e1", "Terminated", None, None, None, None, False, False), ("gone", "WaitToStart", None, 5, "g", "3.5.4", True, False)],
            [("new", "Running", None, 9, None, None, False, False), ("e2", "Removed", None, None, None, None, False, True), ("gone", "Removed", None, None, None, None, False, True)],
            [("e1", "WaitToStart", None, 7, None, None, False, False), ("e3", "WaitToStart", None, 1, "again", "x", True, False)]]
    for v, rows in enumerate(sets, 1):
        layers.write_changes(spark.createDataFrame(rows, types), root, v)
    for bound in (layers.BROADCAST_ROWS, -1):
        old, layers.BROADCAST_ROWS = layers.BROADCAST_ROWS, bound
        try:
            got = {r["id"]: (r["state_kind"], r["name"], r["next_update_time"]) for r in layers.read_version(spark, root, 3).collect()}
        finally:
            layers.BROADCAST_ROWS = old
        assert len(got) == 10 and "e2" not in got and "gone" not in got
        assert got["new"] == ("Running", "n", 9) and got["e1"] == ("WaitToStart", "name 1" * 3, 7) and got["e0"][0] == "Running"
    with pytest.raises(RuntimeError, match="isn't complete"):
        layers.read_version(spark, root, 5)


def test_a_create_never_resets_a_record(spark):
    reg = records(spark, 3, 7)
    new = spark.createDataFrame([("e1", "WaitToStart", None, 1, "other", False, True), ("x", "WaitToStart", None, 1, "x", False, True), ("e2", "Terminated", None, 2, None, False, False), ("y", "Running", None, 2, None, False, False)],
                                "id string, state_kind string, state_message string, next_update_time long, name string, removed boolean, created boolean")
    got = {r["id"]: (r["state_kind"], r["name"], r["next_update_time"]) for r in registry.apply_changes(reg, new).collect()}
    assert got == {"e0": ("Running", "name 0" * 3, 7), "e1": ("Running", "name 1" * 3, 7), "e2": ("Terminated", "name 2" * 3, 2), "x": ("WaitToStart", "x", 1)}
    asked = spark.createDataFrame([("e1",), ("x",), ("x",), ("z",)], "id string")
    assert sorted(tuple(r) for r in registry.creates(asked, reg).collect()) == [("e1", "Exists"), ("x", "Created"), ("x", "Duplicate"), ("z", "Created")]


def test_commands_reach_a_running_monitor(spark):
    root = S.scratch_dir(spark, "commanded")
    registry.write_registry(records(spark, 6, P.now - 1), f"{root}/registry/v=0")
    none = spark.createDataFrame([], "id string, err_msg string")
    schema = "id string, ts long, phase string"
    asked = [[("e0", P.now, 1, "STOP", None), ("e0", P.now + 1, 2, "RESTART", None), ("e1", P.now, 3, "STOP", None), ("nobody", P.now, 4, "STOP", None), ("e5", P.now, 5, "RESTART", None)], [("e1", P.now + 500, 6, "DELETE", None)]]
    for i, rows in enumerate(asked):
        spark.createDataFrame([("e2", i, "Failed" if i else "Running")], schema).coalesce(1).write.parquet(f"{root}/obs/{i}")
        signals(spark, rows).coalesce(1).write.parquet(f"{root}/asked/{i}")
        streams = [spark.readStream.schema(s).option("recursiveFileLookup", "true").parquet(f"{root}/{n}") for s, n in ((schema, "obs"), (SIGNAL, "asked"))]
        S.monitor_rounds(streams[0], f"{root}/registry", none, f"{root}/ck", P, now_fn=lambda e: P.now + 100 * e, obs_order=["ts"], commands=streams[1], compact_every=2)
    outcome = {(r["id"], r["seq"]): r["outcome"] for r in spark.read.parquet(f"{root}/registry/commands").collect()}
    assert outcome == {("e0", 1): "Applied", ("e0", 2): "Applied", ("e1", 3): "Applied", ("nobody", 4): "NotFound", ("e5", 5): "NotAllowed", ("e1", 6): "NotAllowed"}
    first = {r["id"]: r["state_kind"] for r in layers.read_version(spark, f"{root}/registry", 1).collect()}
    assert first["e0"] == "Running" and first["e1"] == "WaitToTerminate"  # due at P.now, so in the next round
    now = {r["id"]: r["state_kind"] for r in layers.read_version(spark, f"{root}/registry", 2).collect()}
    assert now["e1"] == "TriggerTermination" and now["e2"] == "ErrorClean" and len(now) == 6
    log = spark.read.parquet(f"{root}/registry/log").select("id", "from_kind", F.col("state_kind").alias("to_kind"), "signal")
    # a round acquires and releases at once; its CRASH is the acquire alone
    single = log.where("signal not in ('CRASH', 'RELEASE_OK', 'RELEASE_ERR')")
    assert planning.illegal_transitions(single, with_signal=True).count() == 0 and single.where("signal = 'STOP'").count() == 2


def test_calendar_layout_prunes_what_is_not_due(spark):
    path = f"{S.scratch_dir(spark, 'wheel')}/v=0"
    rows = [(f"e{i}", None, None, None, "Running", None, {}, None, None if i % 5 == 0 else P.now - 500 + 10 * i) for i in range(2000)]
    reg = spark.createDataFrame(rows, REGISTRY_SCHEMA)
    calendar.write_calendar(reg, path, P, slot_seconds=60, slots=30)
    snap = calendar.read_calendar(spark, path)
    for later in (0, 90, 1000, 1800, 5000, 10_000_000):  # also beyond the wheel
        p = Params(now=P.now + later)
        due = registry.due_records(snap, p)
        assert {r[0] for r in due.select("id").collect()} == {r[0] for r in rows if r[8] is not None and r[8] < p.now}
    due = registry.due_records(snap, Params(now=P.now + 61))
    plan = due._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "isnotnull(due_slot" in pruned and "* slot_seconds" in pruned and "LessThan(next_update_time" in plan.split("PushedFilters")[1], plan
    slots = {r[0] for r in due.select("due_slot").distinct().collect()}
    every = {r[0] for r in snap.select("due_slot").distinct().collect()}
    assert len(slots) <= 3 and len(every) >= 32 and None in every


def test_observations_are_reduced_below_the_aggregate(spark):
    reg, obs = X.registry(spark, SF001), X.observations(spark, SF001)
    due = registry.due_records(reg, P).where(F.col("state_kind").isin("StartInProgress", "Running", "TerminateInProgress", "ErrorCleanInProgress")).select("id")
    n_due = due.count()
    left = reduce.may_have(obs, reduce.id_bitmap(due))
    assert left.columns == obs.columns
    want = obs.join(due, "id", "left_semi")
    assert left.count() == want.count() < obs.count() and left.select("id").distinct().count() <= n_due
    few = reduce.may_have(obs, reduce.id_bitmap(due, bits=15), bits=15)  # a small bitmap lets some others pass, and loses none
    assert want.count() <= few.count() < obs.count() and few.join(due, "id", "left_semi").count() == want.count()
    assert reduce.may_have(obs, reduce.id_bitmap(due.limit(0))).count() == 0
    plan = planning.sync_round(reg, obs, X.outcomes(spark, SF001), P)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    aggregate = next(i for i, x in enumerate(lines) if "Aggregate" in x and "l_linenumber" in x)
    below = [x for x in lines[aggregate + 1:] if "_word" in x and "Join" in x]
    assert below and "rightHint=(strategy=broadcast)" in below[0]


# ---------------------------------------------------------------- leases

def test_leases_over_any_batches_equal_single_steps():
    for seed in range(60):
        r = random.Random(seed)
        timeout = r.choice([0, 3, 20])
        rows, want, chunk = [], [], 0
        for i in range(r.choice([1, 4, 12])):
            t = sorted(r.randrange(r.choice([5, 300])) for _ in range(r.choice([1, 3, 150])))
            lease = None
            for k, x in enumerate(t):
                chunk += r.random() < 0.05
                rows.append((f"id{i:02}", chunk, x, f"c{k % 7}", x * 1_000_000 + k))
                won = lease is None or x > lease[0] + timeout
                lease = (x, f"c{k % 7}", x * 1_000_000 + k) if won else lease
                want.append(("Success" if won else "Fail", lease[1], lease[2], lease[0] + timeout))
        table = pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.timestamp("us")])], ["id", "chunk", "t", "claimant", "ts"])
        borders = pa.Table.from_batches(list(leases._borders(timeout)(iter(cut(table, r))))).sort_by([("id", "ascending"), ("chunk", "ascending"), ("until", "ascending")])
        starts = {(x["id"], x["chunk"]): (x["at"], x["claimant"], x["ts"]) for b in leases._starts(timeout)(iter(cut(borders, r))) for x in b.to_pylist()}
        begin = [starts.get((x[0], x[1]), (leases.NEVER, None, None)) for x in rows]
        for c, j, t in (("s_at", 0, pa.int64()), ("s_claimant", 1, pa.string()), ("s_ts", 2, pa.int64())):
            table = table.append_column(c, pa.array([b[j] for b in begin], t))
        table = table.append_column("seq", pa.array([0] * len(rows))).append_column("tiebreak", pa.array([0] * len(rows)))
        got = [(x["outcome"], x["holder"], x["lease_ts"], x["expires"]) for b in leases._walk(timeout)(iter(cut(table, r))) for x in b.to_pylist()]
        from datetime import datetime, timedelta
        assert got == [(a, b, datetime(1970, 1, 1) + timedelta(microseconds=c), d) for a, b, c, d in want]


def test_a_hot_id_of_claims_is_split(spark):
    rows = [("hot", 1000 + i // 3, f"c{i % 5}", i, 0) for i in range(3000)] + [("cold", 5, "c", 1, 0), (None, 5, "c", 1, 0)]
    df = spark.createDataFrame(rows, "id string, t long, claimant string, seq long, tiebreak long").select("id", F.timestamp_seconds("t").alias("ts"), "claimant", "seq", "tiebreak")
    out = leases.lease_history(df, 99, partitions=8)
    assert out.count() == 3001
    won = [r[0] for r in out.where("id = 'hot' and outcome = 'Success'").select(F.unix_seconds("ts")).orderBy("ts").collect()]
    assert won == list(range(1000, 2000, 100))


def test_claims_without_an_id_are_not_found(spark):
    reg = records(spark, 1, P.now - 1).withColumn("state_kind", F.lit("WaitToStart"))
    df = spark.createDataFrame([("e0", 1, "a", 1, 1), (None, 1, "b", 1, 1), ("x", 1, "c", 1, 1)], "id string, t long, claimant string, seq long, tiebreak long").select("id", F.timestamp_seconds("t").alias("ts"), "claimant", "seq", "tiebreak")
    got = {r["claimant"]: r["outcome"] for r in planning.acquire(df, reg, P).collect()}
    assert got == {"a": "Success", "b": "NotFound", "c": "NotFound"}


def test_requests_delivered_again_make_nothing(spark):
    """Within a micro-batch, in the next one, and after the stream has forgotten them."""
    root = S.scratch_dir(spark, "again")
    body = '{"name":"n%d","engine_type":"Spark","version":"3.5.3"}'
    deliveries = [[(1, 0), (1, 0), (2, 0)], [(2, 100), (3, 100), (9, 100)], [(1, 50_000), (4, 50_000)], [(3, 90_000), (2, 90_000), (5, 90_000)]]
    types = "request_id long, body string, t long"
    made = []
    for i, rows in enumerate(deliveries):
        rows = [(k, body % k if k < 9 else "{", t) for k, t in rows]
        spark.createDataFrame(rows, types).select("request_id", "body", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(f"{root}/in/{i}")
        src = spark.readStream.schema("request_id long, body string, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{root}/in")
        known = spark.createDataFrame([(x,) for x in made], "id string")
        S.ingest_stream(src, f"{root}/out", f"{root}/ck", P, retry_window="1 hour", registry=known)
        made = [r["id"] for r in spark.read.parquet(f"{root}/out/good").collect()]
    import hashlib

    assert sorted(made) == sorted(hashlib.sha256(str(k).encode()).hexdigest() for k in (1, 2, 3, 4, 5))
    assert spark.read.parquet(f"{root}/out/existing").count() >= 1 and spark.read.parquet(f"{root}/out/rejects").count() == 1
    assert not os.listdir(f"{root}/out/checked".removeprefix("file:"))  # what a batch staged is gone

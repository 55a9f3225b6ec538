"""The two-level fold against a plain Python fold, including one hot id spread over many chunks."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fleetstate.functions.step import SIGNAL_INDEX, Stepper
from fleetstate.model import FOLD_STATES, SIGNALS, Params
from fleetstate.operators import replay
from fleetstate.sources import fixtures as X

P = Params()


def brute_force(sig_rows, p=P):
    """sig_rows: (id, t, seq, signal, msg). Returns {id: (kind, msg, next, n, applied)}."""
    st = Stepper(p)
    by = {}
    for r in sorted(sig_rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    out = {}
    for i, rs in by.items():
        s, m, n, a = 0, None, None, 0
        for _, t, _, g, x in rs:
            s, m, n, oc = st.step(s, m, n, SIGNAL_INDEX.get(g, -1), x, t)
            a += oc == "Applied"
        out[i] = (FOLD_STATES[s], m, n, len(rs), a)
    return out


def make_signals(spark, n_ids=5, hot=2000, cold=40, seed=7):
    rnd = random.Random(seed)
    names = SIGNALS + ["BOGUS"]
    data = []
    seq = 0
    for i in range(n_ids):
        for _ in range(hot if i == 0 else cold):
            seq += 1
            g = rnd.choice(names)
            # bias toward signals that move the machine so long histories stay lively
            if rnd.random() < 0.5:
                g = rnd.choice(["ACQUIRE", "RELEASE_OK", "RELEASE_ERR", "TIMEOUT", "PHASE_Running", "STOP", "RESTART"])
            msg = f"e{seq}" if g == "RELEASE_ERR" else None
            data.append((f"id{i}", 1_000_000 + rnd.randint(0, 500), seq, g, msg))
    df = spark.createDataFrame(data, "id string, t long, seq long, signal string, msg string").select(
        "id", F.timestamp_seconds("t").alias("ts"), "seq", "signal", "msg")
    return data, df


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_fold_matches_brute_force(spark, parts):
    data, df = make_signals(spark)
    expect = brute_force(data)
    got = {r["id"]: (r["state_kind"], r["state_message"], r["next_update_time"], r["n_signals"], r["n_applied"])
           for r in replay.replay_state(df, P, partitions=parts).collect()}
    assert got == expect


def test_hot_id_is_split_across_chunks(spark):
    _, df = make_signals(spark, n_ids=3, hot=3000, cold=10)
    tabs = replay.chunk_tables(df, P, partitions=8)
    chunks_of_hot = tabs.where(F.col("id") == "id0").count()
    assert chunks_of_hot >= 4  # the range partitioner spreads the hot id; no task holds it whole
    biggest = tabs.agg(F.max("n_sig")).collect()[0][0]
    assert biggest < 3000


def test_log_agrees_with_state(spark):
    data, df = make_signals(spark, n_ids=4, hot=600, cold=30, seed=11)
    log = replay.replay_log(df, P, partitions=5)
    assert log.count() == len(data)
    last = (log.groupBy("id").agg(F.max_by(F.struct("to_kind", "state_message", "next_update_time"),
                                           F.struct("ts", "seq")).alias("l")).select("id", "l.*"))
    st = replay.replay_state(df, P, partitions=5)
    a = {tuple(r) for r in last.collect()}
    b = {tuple(r) for r in st.select("id", "state_kind", "state_message", "next_update_time").collect()}
    assert a == b
    # no transition in our own log breaks the rule table
    from fleetstate.operators.planning import illegal_transitions
    applied = log.where(F.col("outcome") == "Applied").select("from_kind", "signal", "to_kind")
    assert illegal_transitions(applied, with_signal=True).count() == 0


def test_append_rule(spark):
    rows = [("x", 1, 1, "ACQUIRE", None), ("x", 2, 2, "RELEASE_ERR", "first"),  # -> ErrorClean(first)
            ("y", 1, 1, "STOP", None), ("y", 2, 2, "RESTART", None), ("y", 3, 3, "ACQUIRE", None),
            ("z", 1, 1, "ACQUIRE", None), ("z", 2, 2, "TIMEOUT", None), ("z", 3, 3, "ACQUIRE", None)]
    # build an error-clean loop: TriggerTermination error -> ErrorWaitToClean(e1) -> acquire -> error again (append)
    rows += [("w", 1, 1, "ACQUIRE", None), ("w", 2, 2, "RELEASE_OK", None), ("w", 3, 3, "PHASE_Running", None),
             ("w", 4, 4, "STOP", None), ("w", 5, 5, "ACQUIRE", None), ("w", 6, 6, "RELEASE_ERR", "e1"),
             ("w", 7, 7, "ACQUIRE", None), ("w", 8, 8, "RELEASE_ERR", "e2")]
    df = spark.createDataFrame(rows, "id string, t long, seq long, signal string, msg string").select(
        "id", F.timestamp_seconds("t").alias("ts"), "seq", "signal", "msg")
    got = {r["id"]: (r["state_kind"], r["state_message"], r["next_update_time"])
           for r in replay.replay_state(df, P, partitions=3).collect()}
    assert got["x"] == ("ErrorClean", "first", None)
    assert got["y"] == ("TriggerStart", None, 3 + P.timeout)
    assert got["w"] == ("ErrorWaitToClean", "e1\n\ne2", 8)
    assert got == {k: v[:3] for k, v in brute_force(rows).items()}


def test_error_history_order(spark):
    rows = [("a", 5, 2, "RELEASE_ERR", "second"), ("a", 5, 1, "RELEASE_ERR", "first"), ("a", 9, 3, "RELEASE_ERR", "third"),
            ("a", 6, 4, "STOP", None)]
    df = spark.createDataFrame(rows, "id string, t long, seq long, signal string, msg string").select(
        "id", F.timestamp_seconds("t").alias("ts"), "seq", "signal", "msg")
    r = replay.error_history(df, partitions=2).collect()[0]
    assert r["history"] == "first\n\nsecond\n\nthird" and r["n_errors"] == 3


def test_fixture_replay_counts(spark):
    st = replay.replay_state(X.signals(spark, SF01), P)
    counts = dict(st.groupBy("state_kind").count().collect())
    assert st.count() == 150
    assert counts["ErrorClean"] == 66 and counts["Removed"] == 64


def test_cas_sequence_matches_brute_force(spark):
    from fleetstate.model import REGISTRY_SCHEMA, STATES
    from fleetstate.operators.cas_chain import cas_sequence

    rnd = random.Random(5)
    reg = spark.createDataFrame([("h", "n", "Spark", "3.5.4", "Running", None, {}, None, 1),
                                 ("c", "n", "Spark", "3.5.4", "ErrorClean", "x", {}, None, None)], REGISTRY_SCHEMA)
    ups = []
    kinds = STATES[:8] + ["ErrorClean"]
    for i in range(3000):  # one hot id
        ups.append(("h", 1000 + rnd.randint(0, 50), i, rnd.choice(kinds), None, rnd.choice(kinds), None, i))
    ups += [("c", 5, 1, "ErrorClean", "x", "Terminated", None, 7), ("c", 6, 2, "ErrorClean", "x", "Running", None, 8),
            ("z", 5, 1, "Running", None, "Terminated", None, 9)]
    df = spark.createDataFrame(ups, "id string, t long, seq long, before_kind string, before_message string, "
                                    "after_kind string, after_message string, next_update_time long").select(
        "id", F.timestamp_seconds("t").alias("ts"), "seq", "before_kind", "before_message", "after_kind",
        "after_message", "next_update_time")
    got = {(r["id"], r["seq"]): (r["outcome"], r["state_kind"]) for r in cas_sequence(df, reg, partitions=6).collect()}
    state = {"h": ("Running", None), "c": ("ErrorClean", "x")}
    expect = {}
    for u in sorted(ups, key=lambda u: (u[0], u[1], u[2])):
        cur = state.get(u[0])
        if cur is None:
            expect[(u[0], u[2])] = ("NotFound", None)
            continue
        if cur == (u[3], u[4]):
            state[u[0]] = (u[5], u[6])
            expect[(u[0], u[2])] = ("Success", u[5])
        else:
            expect[(u[0], u[2])] = ("Fail", cur[0])
    assert got == expect
    assert sum(1 for v in got.values() if v[0] == "Success") > 50


def test_error_history_hot_id(spark):
    rows = [("h", 10 + i // 7, i, "RELEASE_ERR", f"e{i}") for i in range(700)] + [("c", 1, 1, "RELEASE_ERR", "only")]
    df = spark.createDataFrame(rows, "id string, t long, seq long, signal string, msg string").select(
        "id", F.timestamp_seconds("t").alias("ts"), "seq", "signal", "msg")
    got = {r["id"]: (r["history"], r["n_errors"]) for r in replay.error_history(df, partitions=5).collect()}
    assert got["h"] == ("\n\n".join(f"e{i}" for i in range(700)), 700)
    assert got["c"] == ("only", 1)


@pytest.mark.parametrize("parts", [1, 4])
def test_fold_from_registry_state(spark, parts):
    from fleetstate.model import REGISTRY_SCHEMA
    reg = spark.createDataFrame([("r", "n", "Spark", "3.5.4", "Running", None, {}, None, 9),
                                 ("e", "n", "Spark", "3.5.4", "ErrorClean", "boom", {}, None, None),
                                 ("t", "n", "Spark", "3.5.4", "WaitToTerminate", None, {}, None, 3)], REGISTRY_SCHEMA)
    rows = [("r", 10, 1, "STOP", None), ("r", 11, 2, "STOP", None),     # Running -> WaitToTerminate; 2nd refused
            ("e", 10, 1, "RESTART", None), ("e", 11, 2, "DELETE", None),  # refused; then removed
            ("t", 10, 1, "RESTART", None),                              # WaitToTerminate -> Running, next = now
            ("x", 10, 1, "STOP", None)]                                 # not in the registry
    df = spark.createDataFrame(rows, "id string, t long, seq long, signal string, msg string").select(
        "id", F.timestamp_seconds("t").alias("ts"), "seq", "signal", "msg")
    got = {r["id"]: (r["state_kind"], r["state_message"], r["next_update_time"], r["n_applied"])
           for r in replay.replay_state(df, P, partitions=parts, initial=reg).collect()}
    assert got == {"r": ("WaitToTerminate", None, 10, 1), "e": ("Removed", None, None, 1),
                   "t": ("Running", None, 10, 1), "x": ("Removed", None, None, 0)}
    log = {(r["id"], r["seq"]): r["outcome"] for r in replay.replay_log(df, P, partitions=parts, initial=reg).collect()}
    assert log[("r", 2)] == "NotAllowed" and log[("x", 1)] == "NotFound" and log[("e", 2)] == "Applied"


def test_time_to_running(spark):
    rows = [("a", 1, 1, "ACQUIRE", None), ("a", 2, 2, "RELEASE_OK", None), ("a", 3, 3, "PHASE_Running", None),
            ("a", 4, 4, "PHASE_Failed", None),                                       # reached before failing
            ("b", 1, 1, "ACQUIRE", None), ("b", 2, 2, "RELEASE_ERR", "x"),           # ErrorClean first
            ("c", 1, 1, "STOP", None),                                                # Terminated: unexpected
            ("d", 1, 1, "ACQUIRE", None), ("d", 2, 2, "PHASE_Running", None)]        # refused; still TriggerStart
    df = spark.createDataFrame(rows, "id string, t long, seq long, signal string, msg string").select(
        "id", F.timestamp_seconds("t").alias("ts"), "seq", "signal", "msg")
    log = replay.replay_log(df, P, partitions=2)
    out = {r["id"]: (r["status"], r["failed_kind"]) for r in replay.time_to_state(
        log, "Running", ["WaitToStart", "TriggerStart", "StartInProgress"]).collect()}
    assert out == {"a": ("reached", "ErrorClean"), "b": ("failed", "ErrorClean"),
                   "c": ("failed", "Terminated"), "d": ("pending", None)}


def test_prefix_pass_is_linear_in_the_chunks_of_a_hot_id():
    """50,000 chunks of one id: the pass keeps one state, so twice the chunks take about twice the time."""
    import time

    from fleetstate.operators.replay import _as_batch, _chain

    def run(n):
        rows = [("hot", c, True, i, (i + 1) % 12, True, "", False, 7, 1, 1, 0, None, None) for c in range(n) for i in range(13)]
        batches = [_as_batch(rows[i: i + 10_001]) for i in range(0, len(rows), 10_001)]
        t = time.process_time()
        starts = [r for b in _chain(True)(iter(batches)) for r in b.to_pylist()]
        (end,) = [r for b in _chain(False)(iter(batches)) for r in b.to_pylist()]
        return time.process_time() - t, starts, end

    run(1000)
    small, starts, _ = run(25_000)
    large, starts, end = run(50_000)
    assert [r["s"] for r in starts] == [i % 12 for i in range(50_000)] and end["s"] == 50_000 % 12 and end["n_app"] == end["n_sig"] == 50_000
    assert large < 4 * small + 1


def cut(table, r):
    """The rows of a table as record batches of random sizes."""
    out, at = [], 0
    while at < table.num_rows:
        n = r.choice([1, 2, 3, 10, 100])
        out += table.slice(at, n).combine_chunks().to_batches()
        at += n
    return out


def test_folds_over_any_batches_equal_single_steps():
    """The passes over record batches, cut anywhere, against one step after the other."""
    import pyarrow as pa

    from fleetstate.functions.rules import BUILT_IN
    from fleetstate.operators.replay import _chain, _fold_runs, _log_fold

    step = Stepper(P)
    for seed in range(40):
        r = random.Random(seed)
        lively = ["ACQUIRE", "RELEASE_OK", "RELEASE_ERR", "TIMEOUT", "PHASE_Running", "STOP", "ACQUIRE", "RELEASE_ERR"]
        rows, want_log, want = [], [], {}
        for i in range(r.choice([1, 3, 12])):
            init = (r.randrange(13), r.choice([None, "old"]), r.choice([None, 5])) if seed % 2 else (0, None, None)
            state, n_app = init, 0
            n = r.choice([1, 2, 5, 200])
            for k in range(n):
                g = r.choice(lively) if r.random() < 0.8 else r.choice(SIGNALS + ["BOGUS"])
                msg = r.choice([f"e{i}.{k}", None]) if g == "RELEASE_ERR" else None
                rows.append((f"id{i:02}", len(rows) // r.choice([7, 40]), k, g, SIGNAL_INDEX.get(g, -1), msg, 100 + k, *init))
                s, m, nx, oc = step.step(*state, SIGNAL_INDEX.get(g, -1), msg, 100 + k)
                want_log.append((FOLD_STATES[state[0]], FOLD_STATES[s], oc, m, nx))
                state, n_app = (s, m, nx), n_app + (oc == "Applied")
            want[f"id{i:02}"] = (*state, n, n_app)
        chunk = 0
        fixed = []
        for x in rows:  # chunk numbers rise
            chunk = max(chunk, x[1])
            fixed.append((x[0], chunk, *x[2:]))
        names = ["id", "chunk", "seq", "signal", "g", "msg", "t", "i_s", "i_m", "i_n"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
        table = pa.table([pa.array(list(c), t) for c, t in zip(zip(*fixed), types)], names)
        tables = list(_fold_runs(BUILT_IN, P)(iter(cut(table, r))))
        ordered = lambda bs: cut(pa.Table.from_batches(bs).sort_by([("id", "ascending"), ("chunk", "ascending")]), r)  # noqa: E731, B023
        got = {x["id"]: (x["s"], x["m"], x["n"], x["n_sig"], x["n_app"]) for b in _chain(False)(iter(ordered(tables))) for x in b.to_pylist()}
        assert got == want
        assert sum(x["n_sig"] for b in tables for x in b.to_pylist() if x["start"] == 0 or not x["border"]) >= 1
        borders = [b.filter(b.column("border")) for b in _fold_runs(BUILT_IN, P, True)(iter(cut(table, r)))]
        keep = lambda bs: sorted((tuple(x.values()) for b in bs for x in b.to_pylist()), key=str)
        assert keep(borders) == keep([b.filter(b.column("border")) for b in tables])
        starts = {(x["id"], x["chunk"]): (x["s"], x["m"], x["n"]) for b in _chain(True)(iter(ordered(borders))) for x in b.to_pylist()}
        begin = [starts.get((x[0], x[1]), x[7:]) for x in fixed]
        log = table.append_column("ts", pa.array([x[6] for x in fixed], pa.timestamp("us"))).append_column("s0", pa.array([b[0] for b in begin], pa.int32()))
        log = log.append_column("m0", pa.array([b[1] for b in begin], pa.string())).append_column("n0", pa.array([b[2] for b in begin], pa.int64()))
        rows_ = [(x["from_kind"], x["to_kind"], x["outcome"], x["state_message"], x["next_update_time"]) for b in _log_fold(BUILT_IN, P)(iter(cut(log, r))) for x in b.to_pylist()]
        assert rows_ == want_log


def test_ordered_updates_over_any_batches_equal_single_steps():
    import pyarrow as pa

    from fleetstate.operators.cas_chain import _borders, _starts, _walk

    for seed in range(40):
        r = random.Random(seed)
        states = [(k, m) for k in "AB" for m in (None, "x", "y", "")][: r.choice([2, 5, 8])]
        rows, want, chunk = [], [], 0
        for i in range(r.choice([1, 4, 15])):
            found = r.random() < 0.8
            init = (*r.choice(states), 3, True) if found else (None, None, None, None)
            cur = init[:3]
            for k in range(r.choice([1, 3, 150])):
                b, a, t = r.choice([*states, (None, None)]), r.choice(states), r.choice([None, k])
                chunk += r.random() < 0.05
                rows.append((f"id{i:02}", chunk, k, *b, *a, t, *init))
                if not found:
                    want.append(("NotFound", None, None, None, None, None))
                    continue
                ok = b[0] is not None and b == cur[:2]
                met, cur = cur, (*a, t) if ok else cur
                want.append(("Success" if ok else "Fail", *met[:2], *cur))
        names = ["id", "chunk", "seq", "before_kind", "before_message", "after_kind", "after_message", "next_update_time", "k0", "m0", "n0", "f0"]
        types = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        table = pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)
        starts = {(x["id"], x["chunk"]): (x["s_k"], x["s_m"], x["s_n"]) for b in _starts(_borders(iter(cut(table, r)))) for x in b.to_pylist()}
        begin = [starts.get((x[0], x[1]), x[8:11]) for x in rows]
        table = table.append_column("ts", pa.array([x[2] for x in rows], pa.timestamp("us")))
        for j, (c, t) in enumerate([("s_k", pa.string()), ("s_m", pa.string()), ("s_n", pa.int64())]):
            table = table.append_column(c, pa.array([b[j] for b in begin], t))
        cols = ["outcome", "current_kind", "current_message", "state_kind", "state_message", "next_update_time"]
        assert [tuple(x[c] for c in cols) for b in _walk(iter(cut(table, r))) for x in b.to_pylist()] == want


def test_updates_of_one_id_with_many_messages_stay_near_linear():
    import time

    import numpy as np
    import pyarrow as pa

    from fleetstate.operators.cas_chain import Chains

    n = 200_000
    batch = pa.RecordBatch.from_pydict({"before_kind": ["A"] * n, "before_message": [f"m{i}" for i in range(n)], "after_kind": ["A"] * n, "after_message": [f"m{i + 1}" for i in range(n)]})
    t = time.process_time()
    x = Chains(batch, np.zeros(1, np.int64))
    assert x.won(np.array([n // 2])).sum() == n // 2 and (x.ends() == n - 1).all()
    assert time.process_time() - t < 10


def test_signals_without_a_time_are_left_out_and_found(spark):
    from fleetstate.operators.replay import replay_state, unordered_signals

    rows = [("a", 10, 1, "STOP", None), ("a", None, 2, "RESTART", None), (None, 10, 3, "STOP", None)]
    df = spark.createDataFrame(rows, "id string, t long, seq long, signal string, msg string").selectExpr("id", "timestamp_seconds(t) as ts", "seq", "signal", "msg")
    got = replay_state(df, Params()).collect()
    assert [(r["id"], r["state_kind"], r["n_signals"]) for r in got] == [("a", "Terminated", 1)]
    assert unordered_signals(df).count() == 2


def test_ids_of_requests_are_decoded(spark):
    from fleetstate.operators.commands import route_requests

    paths = ["/engine/a%20b", "/engine/a+b?x=1", "/engine/%zz/stop", "/engine?all=1", "/engine/a/stop?force=/engine/b"]
    log = spark.createDataFrame([("POST" if "stop" in p else "GET", p) for p in paths], "method string, path string")
    got = {r["path"]: (r["operation"], r["id"]) for r in route_requests(log).collect()}
    assert [got[p] for p in paths] == [("get", "a b"), ("get", "a+b"), ("stop", "%zz"), ("list", None), ("stop", "a")]

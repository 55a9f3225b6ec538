"""The transition table: every edge and every refused (state, signal) pair, as table tests."""

from pyspark.sql import functions as F

from fleetstate.functions.columns import next_update_time, state_class
from fleetstate.model import (EDGES, FOLD_EDGES, FOLD_STATES, SIGNALS, STATES, Params, dense_tables,
                              edges_df)
from fleetstate.operators.edges import round_edges

E = {(e.from_kind, e.signal): e for e in FOLD_EDGES}


def test_edge_counts():
    assert len(FOLD_EDGES) == 44
    assert len([e for e in FOLD_EDGES if e.actor == "observer"]) == 24
    assert len([e for e in FOLD_EDGES if e.actor != "observer"]) == 20
    assert [e for e in EDGES if e.from_kind is None][0].to_kind == "WaitToStart"


def test_command_edges():
    assert E[("WaitToStart", "STOP")].to_kind == "Terminated"
    assert E[("WaitToStart", "STOP")].next_rule == "none"
    for s in ["StartInProgress", "Running"]:
        assert E[(s, "STOP")].to_kind == "WaitToTerminate"
        assert E[(s, "STOP")].next_rule == "now"
    # restart of a terminating engine asks for an immediate check, not now + interval
    assert (E[("WaitToTerminate", "RESTART")].to_kind, E[("WaitToTerminate", "RESTART")].next_rule) == ("Running", "now")
    assert E[("Terminated", "RESTART")].to_kind == "WaitToStart"
    for s in ["WaitToStart", "Terminated", "ErrorClean"]:
        assert E[(s, "DELETE")].to_kind == "Removed"
    allowed = {(e.from_kind, e.signal) for e in FOLD_EDGES if e.signal in ("STOP", "RESTART", "DELETE")}
    refused = [(s, g) for s in STATES for g in ("STOP", "RESTART", "DELETE") if (s, g) not in allowed]
    assert len(refused) == 36 - 8  # 3 stop, 2 restart and 3 delete edges
    assert ("WaitToStart", "RESTART") in refused and ("Running", "DELETE") in refused


def test_monitor_edges():
    assert E[("ErrorWaitToClean", "ACQUIRE")].msg_rule == "keep"
    assert E[("TriggerStart", "RELEASE_ERR")].to_kind == "ErrorClean"
    assert E[("TriggerStart", "RELEASE_ERR")].next_rule == "none"
    assert E[("TriggerTermination", "RELEASE_ERR")].to_kind == "ErrorWaitToClean"
    assert E[("ErrorTriggerClean", "RELEASE_ERR")].msg_rule == "append"
    assert E[("ErrorTriggerClean", "RELEASE_OK")].to_kind == "ErrorCleanInProgress"
    for trig, wait in [("TriggerStart", "WaitToStart"), ("TriggerTermination", "WaitToTerminate"),
                       ("ErrorTriggerClean", "ErrorWaitToClean")]:
        assert E[(trig, "TIMEOUT")].to_kind == wait
        assert E[(trig, "TIMEOUT")].next_rule == "now"


def test_observation_edges():
    assert E[("StartInProgress", "PHASE_Running")].to_kind == "Running"
    for ph in ["Pending", "Unknown"]:
        assert E[("StartInProgress", f"PHASE_{ph}")].to_kind == "StartInProgress"
    for ph in ["Succeeded", "Failed", "NotExisted"]:
        e = E[("StartInProgress", f"PHASE_{ph}")]
        assert (e.to_kind, e.const_message, e.next_rule) == ("ErrorClean", "Engine fails to start.", "none")
        e = E[("Running", f"PHASE_{ph}")]
        assert (e.to_kind, e.const_message) == ("ErrorClean", "Engine terminates during running.")
    e = E[("Running", "PHASE_Pending")]
    assert (e.to_kind, e.const_message, e.next_rule) == ("ErrorCleanInProgress", "Engine restarts unexpected.", "interval")
    assert E[("TerminateInProgress", "PHASE_NotExisted")].to_kind == "Terminated"
    assert E[("ErrorCleanInProgress", "PHASE_NotExisted")].msg_rule == "keep"
    # no observation edge from waiting, trigger or stable states
    for s in ["WaitToStart", "TriggerStart", "Terminated", "ErrorClean", "WaitToTerminate"]:
        assert not any((s, f"PHASE_{p}") in E for p in ["Pending", "Running", "NotExisted"])


def test_dense_tables_match_edges():
    d = dense_tables()
    n_g = len(SIGNALS)
    for si, s in enumerate(FOLD_STATES):
        for gi, g in enumerate(SIGNALS):
            e = E.get((s, g))
            assert (d["next"][si * n_g + gi] >= 0) == (e is not None)
            if e:
                assert FOLD_STATES[d["next"][si * n_g + gi]] == e.to_kind
    assert all(x == -1 for x in d["next"][FOLD_STATES.index("Removed") * n_g:])


def test_next_update_time_service_case(spark):
    # state, now=0, interval=3, timeout=5
    df = spark.createDataFrame([(s,) for s in STATES], "state_kind string")
    got = {r[0]: r[1] for r in df.select("state_kind", next_update_time("state_kind", 0, 3, 5)).collect()}
    expect = {"WaitToStart": 0, "WaitToTerminate": 0, "ErrorWaitToClean": 0,
              "TriggerStart": 5, "TriggerTermination": 5, "ErrorTriggerClean": 5,
              "StartInProgress": 3, "Running": 3, "TerminateInProgress": 3, "ErrorCleanInProgress": 3,
              "Terminated": None, "ErrorClean": None}
    assert got == expect


def test_params_bounds():
    import pytest
    with pytest.raises(ValueError):
        Params(interval=256)
    with pytest.raises(ValueError):
        Params(timeout=70000)


def test_round_edges(spark):
    r = {(x[0], x[1]): x[2:] for x in round_edges(edges_df(spark)).collect()}
    assert r[("WaitToStart", "RELEASE_OK")][0] == "StartInProgress"
    assert r[("WaitToStart", "RELEASE_ERR")][:2] == ("ErrorClean", "set")
    assert r[("WaitToStart", "CRASH")][0] == "TriggerStart"
    assert r[("ErrorWaitToClean", "RELEASE_ERR")][:2] == ("ErrorWaitToClean", "append")
    assert r[("ErrorWaitToClean", "RELEASE_OK")][:2] == ("ErrorCleanInProgress", "keep")


def test_state_class(spark):
    df = spark.createDataFrame([(s,) for s in STATES], "k string")
    got = dict(df.select("k", state_class("k")).collect())
    assert got["Running"] == "in_progress" and got["ErrorClean"] == "stable" and got["TriggerStart"] == "trigger"
    assert F is not None


def test_all_pairs_through_rule_join(spark):
    """Every (state, signal) pair through the Spark rule join: allowed exactly when an edge exists."""
    from fleetstate.operators.edges import apply_edge, join_edges, resolve_edges

    p = Params(now=100, interval=3, timeout=5)
    pairs = [(s, g, "old", "arg") for s in FOLD_STATES for g in SIGNALS]
    df = spark.createDataFrame(pairs, "state_kind string, signal string, state_message string, arg string")
    j = join_edges(df, resolve_edges(spark, None))
    kind, msg, nxt = apply_edge(j, p, arg=F.col("arg"))
    got = {(r[0], r[1]): (r[2], r[3], r[4]) for r in j.select("state_kind", "signal", kind, msg, nxt).collect()}
    assert len(got) == len(FOLD_STATES) * len(SIGNALS)
    for (s, g), (to, m, n) in got.items():
        e = E.get((s, g))
        if e is None:
            assert to is None, (s, g)
            continue
        assert to == e.to_kind
        expect_m = {"clear": None, "keep": "old", "set": "arg", "append": "old\n\narg", "const": e.const_message}[e.msg_rule]
        assert m == expect_m, (s, g)
        assert n == {"none": None, "now": 100, "interval": 103, "timeout": 105}[e.next_rule], (s, g)
    assert sum(1 for v in got.values() if v[0] is not None) == 44

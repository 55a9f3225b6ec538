"""Property test: the distributed fold equals a plain fold for random histories and chunkings."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetstate.functions.step import SIGNAL_INDEX, Stepper
from fleetstate.model import FOLD_STATES, SIGNALS, Params
from fleetstate.operators import replay

P = Params(interval=7, timeout=11)

signal = st.sampled_from(SIGNALS + ["NOPE"])
row = st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 30), signal)
history = st.lists(row, min_size=1, max_size=120)


def plain(rows):
    out = {}
    step = Stepper(P)
    for rid in sorted({r[0] for r in rows}):
        s, m, n, a = 0, None, None, 0
        mine = sorted((r for r in rows if r[0] == rid), key=lambda r: (r[1], r[3]))
        for _, t, g, seq, msg in mine:
            s, m, n, oc = step.step(s, m, n, SIGNAL_INDEX.get(g, -1), msg, t)
            a += oc == "Applied"
        out[rid] = (FOLD_STATES[s], m, n, len(mine), a)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(history, st.integers(1, 9))
def test_fold_equals_plain_fold(spark, rows, parts):
    rows = [(r, t, g, i, f"m{i}" if g == "RELEASE_ERR" else None) for i, (r, t, g) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id string, t long, signal string, seq long, msg string").select(
        "id", F.timestamp_seconds("t").alias("ts"), "seq", "signal", "msg")
    got = {r["id"]: (r["state_kind"], r["state_message"], r["next_update_time"], r["n_signals"], r["n_applied"])
           for r in replay.replay_state(df, P, partitions=parts).collect()}
    assert got == plain(rows)

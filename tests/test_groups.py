"""Streams behind a reorder buffer: ids share state in groups, and what arrives is made once."""

import random

import pytest
from pyspark.sql import functions as F

from fleetstate.model import Params
from fleetstate.operators import replay
from fleetstate.plans.live import _arrive
from fleetstate.streaming import lifecycle as S
from fleetstate.streaming import waits as W

P = Params()
SIGNAL = "id string, t long, seq long, signal string, msg string"
COLS = ["id", "state_kind", "state_message", "next_update_time", "n_signals", "n_applied"]


def files(spark, path, frames):
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def signals(spark, rows):
    return spark.createDataFrame(rows, SIGNAL).select("id", F.timestamp_seconds("t").alias("ts"), "seq", "signal", "msg")


def drained(spark, stream, root, schema):
    """The output, and the most values that the state held after a micro-batch."""
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    return spark.read.schema(schema).parquet(f"{root}/out"), held


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    names = ["STOP", "RESTART", "ACQUIRE", "RELEASE_OK", "RELEASE_ERR", "PHASE_Running", "PHASE_Failed", "DELETE"]
    return [(f"id{r.randrange(90)}", 1000 + r.randrange(300), k, s, f"e{k}" if s == "RELEASE_ERR" else None)
            for k, s in enumerate(r.choices(names, k=600))]


def test_seeded_state_is_held_by_groups(spark, rows):
    seeds = [(f"id{i}", ["WaitToStart", "Running", "ErrorClean", "TriggerStart"][i % 4], "m" if i % 4 == 2 else None, i if i % 3 else None) for i in range(20, 400)]
    initial = spark.createDataFrame(seeds, "id string, state_kind string, state_message string, next_update_time long")
    shuffled = random.Random(5).sample(rows, len(rows))
    root = S.scratch_dir(spark, "groups-seeded")
    src = files(spark, f"{root}/in", [signals(spark, x) for x in (shuffled[:200], shuffled[200:], [("~end", 5000, 0, "STOP", None)])])
    out, held = drained(spark, S.lifecycle_stream(src, P, watermark="1000 seconds", reorder=True, initial=initial, groups=4), root, S.OUTPUT_SCHEMA)
    want = replay.replay_state(signals(spark, rows), P, initial=initial)
    assert sorted(map(tuple, S.latest_per_id(out).select(*COLS).collect()), key=str) == sorted(map(tuple, want.select(*COLS).collect()), key=str)
    assert held <= 10 * 4  # a value for each of 400 ids would be more


def test_seeded_triggers_time_out_without_signals(spark):
    seeds = [("a", "TriggerStart", None, 100), ("b", "TriggerStart", None, 9000), ("c", "Running", None, 100), ("d", "TriggerStart", None, 200)]
    initial = spark.createDataFrame(seeds, "id string, state_kind string, state_message string, next_update_time long")
    root = S.scratch_dir(spark, "groups-triggers")
    src = files(spark, f"{root}/in", [signals(spark, x) for x in ([("d", 150, 1, "RELEASE_OK", None), ("e", 150, 1, "STOP", None)], [("~end", 5000, 0, "STOP", None)])])
    out, _ = drained(spark, S.lifecycle_stream(src, P, watermark="10 seconds", reorder=True, initial=initial, auto_timeout=True, groups=1), root, S.OUTPUT_SCHEMA)
    got = {r["id"]: (r["state_kind"], r["next_update_time"], r["n_signals"], r["via"]) for r in S.latest_per_id(out).collect()}
    assert got["a"] == ("WaitToStart", 101, 0, "timer") and got["d"][0] == "StartInProgress" and got["e"][0] == "Removed"
    assert set(got) == {"a", "d", "e"}


def test_reordered_state_is_held_by_groups(spark, rows):
    shuffled = random.Random(7).sample(rows, len(rows))
    root = S.scratch_dir(spark, "groups-reordered")
    src = files(spark, f"{root}/in", [signals(spark, x) for x in (shuffled[:300], shuffled[300:], [("~end", 5000, 0, "STOP", None)])])
    out, held = drained(spark, S.lifecycle_stream(src, P, watermark="1000 seconds", reorder=True, groups=3), root, S.OUTPUT_SCHEMA)
    want = replay.replay_state(signals(spark, rows), P)
    assert sorted(map(tuple, S.latest_per_id(out).select(*COLS).collect()), key=str) == sorted(map(tuple, want.select(*COLS).collect()), key=str)
    assert held <= 10 * 3


def test_only_created_ids_have_records(spark):
    root = S.scratch_dir(spark, "groups-create")
    batches = [[("a", 12, 3, "STOP", None), ("b", 10, 1, "STOP", None)], [("a", 11, 2, "CREATE", None), ("a", 10, 1, "STOP", None)], [("~end", 5000, 0, "STOP", None)]]
    src = files(spark, f"{root}/in", [signals(spark, x) for x in batches])
    out, _ = drained(spark, S.lifecycle_stream(src, P, watermark="100 seconds", reorder=True, explicit_create=True, groups=1), root, S.OUTPUT_SCHEMA)
    assert [(r["id"], r["state_kind"], r["n_signals"], r["n_dropped"]) for r in S.latest_per_id(out).collect()] == [("a", "Terminated", 2, 1)]


def test_waits_are_held_by_groups(spark):
    ids = [f"id{i}" for i in range(120)]
    moves = [(x, 100 + i, i, "Running" if i % 2 else "Terminated") for i, x in enumerate(ids)]
    asked = [(x, i, 50, "Running", ["WaitToStart"], 1000 if i % 3 else 60) for i, x in enumerate(ids)]
    move = lambda rows: spark.createDataFrame(rows, "id string, t long, seq long, to_kind string").select("id", F.timestamp_seconds("t").alias("ts"), "seq", "to_kind")
    wait = lambda rows: spark.createDataFrame(rows, "id string, wait_id long, t long, target string, allowed array<string>, d long").select(
        "id", "wait_id", F.timestamp_seconds("t").alias("ts"), "target", "allowed", F.timestamp_seconds("d").alias("deadline"))
    root = S.scratch_dir(spark, "groups-waits")
    left = files(spark, f"{root}/m", [move(moves), move([("~end", 5000, 0, "x")])])
    right = files(spark, f"{root}/w", [wait(asked[::-1]), wait([("~end", 0, 5000, "x", ["x"], 5000)])])
    out, held = drained(spark, W.wait_stream(left, right, ("500 seconds", "500 seconds"), groups=3), root, W.OUTPUT)
    got = {r["wait_id"]: (r["status"], r["at_us"] // 1_000_000, r["state_kind"]) for r in out.where("id <> '~end'").collect()}
    assert got == {i: ("timed_out", 60, "WaitToStart") if i % 3 == 0 else ("reached", 100 + i, "Running") if i % 2 else ("failed", 100 + i, "Terminated") for i in range(120)}
    assert held <= 10 * 3


class Allowed(str):
    """Allowed states that count how often they are looked at."""

    looked = 0

    def split(self, *args):
        Allowed.looked += 1
        return super().split(*args)


def test_open_waits_are_judged_by_kind_not_one_by_one():
    n = 400
    moves = [(10 * i, 0, i, "ab"[i % 2], 0, None, None, 0) for i in range(n)]
    asked = [(10 * i + 1, 1, i, None, i, "c", Allowed("a\nb"), 10 * (i + 150)) for i in range(n)]
    done = []
    Allowed.looked = 0
    kind, left = W.WaitProcessor._happen("x", "a", [], sorted(moves + asked, key=lambda e: e[:3]), 10 * n, done)
    assert Allowed.looked <= 2 * n  # each open wait at each move would be some 150 n
    # deadlines pass in order, in the state of that time; the rest stays open
    assert done == [("x", i, "c", "timed_out", 10 * (i + 150), 1499, "ab"[(i + 150) % 2] if i + 150 < n else kind) for i in range(n - 150 + 1)]
    assert kind == "b" and sorted(w[0] for w in left) == list(range(n - 150 + 1, n))
    done.clear()
    assert W.WaitProcessor._happen("x", kind, left, [(10 * n + 1, 0, n, "c", 0, None, None, 0)], 10 * n + 1, done) == ("c", [])
    assert sorted(d[1] for d in done) == list(range(n - 150 + 1, n)) and {d[3] for d in done} == {"reached"}


def test_arriving_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").alias("seq"))
    root = S.scratch_dir(spark, "arrive-once")
    how = _arrive(rows.mapInArrow(seen, rows.schema), f"{root}/in", "seq")
    assert made.value == how.rows == 100
    assert spark.read.schema(rows.schema).parquet(f"{root}/in").count() == 101  # and the row at the end

"""The original service's own test cases, re-expressed as rows through the bulk operators."""

import json

from pyspark.sql import functions as F

from conftest import rows
from fleetstate.functions import columns as C
from fleetstate.functions import launch
from fleetstate.model import Params, REGISTRY_SCHEMA
from fleetstate.operators import planning, registry
from fleetstate.sources import ingest

P = Params(now=1000, interval=3, timeout=5)


def reg(spark, recs):
    """recs: (id, state_kind, state_message, next_update_time, version, config)"""
    data = [(i, "n", "Spark", v, k, m, cfg or {}, None, n) for i, k, m, n, v, cfg in recs]
    return spark.createDataFrame(data, REGISTRY_SCHEMA)


# ------------------------------------------------------------------ create requests

def _validate(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    return {r["request_id"]: r for r in ingest.validate_requests(df).collect()}


def test_create_request_cases(spark):
    bodies = [
        json.dumps({"version": "3.5.3", "engine_type": "Spark", "config": {}}),
        json.dumps({"name": "test", "invalid": "invalid"}),
        json.dumps({"name": "test", "engine_type": "foo", "config": {}}),
        json.dumps({"name": "test", "engine_type": "Spark", "version": "3.5.3",
                    "config": {"spark.executor.instances": "1"}}),
        json.dumps({"name": "test", "engine_type": "Spark", "version": "3.5.3", "config": None}),
        json.dumps({"name": "test", "engine_type": "Spark", "version": "3.5.3"}),
        json.dumps({"name": "test", "engine_type": "Spark", "version": "3.5.3", "config": {"a": 1}}),
        json.dumps({"name": "test", "engine_type": "Spark", "version": "3.5.3", "config": 5}),
        '{"name":"a","name":"b","engine_type":"Spark","version":"3.5.3"}',
        "[1, 2]",
        '{"name": "test"',
        json.dumps({"name": 7, "engine_type": "Spark", "version": "3.5.3"}),
        json.dumps({"name": "x", "configs": {}}),  # documented key, rejected by the code
        json.dumps({"name": "", "engine_type": "Spark", "version": "9"}),  # any name and version string
        '{"name":"a","engine_type":"Spark","version":"3.5.3"} x',  # trailing characters
        '{"name":"a","engine_type":"Spark","version":"3.5.3"}{}',
        json.dumps({"name": "a", "engine_type": "Spark", "version": "3.5.3", "config": {"k": "1"}})[:-1] + ',"config":{}}',
        '{"name":"a","engine_type":"Spark","version":"3.5.3"}]',
        '{"name":"a","engine_type":"Spark","version":"3.5.3"},0]',
        '  {"name":"a","engine_type":"Spark","version":"3.5.3"}  ',  # surrounding whitespace is fine
    ]
    r = _validate(spark, bodies)
    assert r[0]["reason"] == "missing_field" and "missing field `name`" in r[0]["detail"]
    assert r[1]["reason"] == "unknown_field"
    assert "unknown field `invalid`, expected one of `name`, `engine_type`, `version`, `config`" in r[1]["detail"]
    assert r[2]["reason"] == "unknown_variant" and "engine_type: unknown variant `foo`" in r[2]["detail"]
    assert r[3]["reason"] is None and r[3]["config"] == {"spark.executor.instances": "1"}
    assert (r[3]["name"], r[3]["engine_type"], r[3]["version"]) == ("test", "Spark", "3.5.3")
    assert r[4]["reason"] is None and r[4]["config"] == {}
    assert r[5]["reason"] is None and r[5]["config"] == {}
    assert r[6]["reason"] == "bad_type" and r[6]["detail"].startswith("config.a:")
    assert r[7]["reason"] == "bad_type"
    assert r[8]["reason"] == "duplicate_field"
    assert r[9]["reason"] == "not_object"
    assert r[10]["reason"] == "malformed"
    assert r[11]["reason"] == "bad_type" and r[11]["detail"].startswith("name:")
    assert r[12]["reason"] == "unknown_field"
    assert r[13]["reason"] is None
    assert r[14]["reason"] == "malformed" and r[15]["reason"] == "malformed"
    assert r[16]["reason"] == "duplicate_field"
    assert r[17]["reason"] == "malformed" and r[18]["reason"] == "malformed" and r[19]["reason"] is None


def test_bulk_create_is_idempotent(spark):
    df = spark.createDataFrame([(1, json.dumps({"name": "a", "engine_type": "Spark", "version": "3.5.4"}))],
                               "request_id long, body string")
    good, bad = ingest.split_requests(df)
    a = ingest.bulk_create(good, P).collect()[0]
    b = ingest.bulk_create(good, P).collect()[0]
    assert a["id"] == b["id"] and a["state_kind"] == "WaitToStart" and a["next_update_time"] == 1000
    assert a["config"] == {} and bad.count() == 0


# ------------------------------------------------------------------ ids and wire forms

def test_id_cases(spark):
    wires = ['"123"', '{"id":""}', '{"id":"123","other":"456"}', '{"id":"abc"}', '{"id":"abc"']
    df = spark.createDataFrame([(w,) for w in wires], "wire string")
    got = {r[0]: (r[1], r[2], r[3]) for r in df.select("wire", ingest.validate_id(F.col("wire")).alias("v"))
           .select("wire", "v.id", "v.reason", "v.detail").collect()}
    msg = 'Failed to deserialize EngineId, expect a map `{"id": <non empty string>}`'
    assert got['"123"'] == (None, "bad_shape", msg)
    assert got['{"id":"123","other":"456"}'][1] == "bad_shape"
    assert got['{"id":""}'] == (None, "empty", "Not allowed: Engine id cannot be empty.")
    assert got['{"id":"abc"}'] == ("abc", None, None)
    assert got['{"id":"abc"'][1] == "bad_shape"


def test_state_wire_round_trip(spark):
    states = [("WaitToStart", None), ("ErrorClean", 'a "quoted"\n\nmsg'), ("Running", None)]
    df = spark.createDataFrame(states, "k string, m string")
    enc = df.select("k", "m", C.encode_state("k", "m").alias("w"))
    dec = enc.select("k", "m", "w", ingest.decode_state(F.col("w")).alias("d")).collect()
    for r in dec:
        assert (r["d"]["kind"], r["d"]["message"], r["d"]["reason"]) == (r["k"], r["m"], None)
    bad = spark.createDataFrame([('"Paused"',), ('{"Running":"x"}',), ('{"ErrorClean":1}',), ('"Running',)], "w string")
    reasons = [r[0] for r in bad.select(ingest.decode_state(F.col("w"))["reason"]).collect()]
    assert reasons == ["unknown_variant", "unknown_variant", "bad_type", "malformed"]


def test_debug_text(spark):
    df = spark.createDataFrame([("ErrorClean", 'x"y\n'), ("Running", None)], "k string, m string")
    assert [r[0] for r in df.select(C.debug_text("k", "m")).collect()] == ['ErrorClean("x\\"y\\n")', "Running"]


# ------------------------------------------------------------------ commands (stop / restart / delete)

def test_command_cases(spark):
    r = reg(spark, [("123", "WaitToStart", None, 5, "3.5.3", None), ("124", "Terminated", None, None, "3.5.3", None),
                    ("125", "Running", None, 9, "3.5.3", None), ("126", "ErrorClean", "bad", None, "3.5.3", None),
                    ("127", "WaitToTerminate", None, 9, "3.5.3", None)])
    cmds = spark.createDataFrame([("123", "STOP"), ("124", "RESTART"), ("123", "RESTART"), ("999", "DELETE"),
                                  ("125", "DELETE"), ("126", "DELETE"), ("127", "RESTART"), ("125", "STOP")],
                                 "id string, signal string")
    out = {(x["id"], x["signal"]): x for x in planning.plan_commands(cmds, r, P).collect()}
    assert out[("123", "STOP")]["new_kind"] == "Terminated" and out[("123", "STOP")]["new_next_update_time"] is None
    assert out[("124", "RESTART")]["new_kind"] == "WaitToStart" and out[("124", "RESTART")]["new_next_update_time"] == 1000
    x = out[("123", "RESTART")]
    assert x["outcome"] == "NotAllowed"
    assert x["error"] == "Not allowed: Engine 123 is in WaitToStart state, cannot be restarted"
    assert out[("999", "DELETE")]["outcome"] == "NotFound"
    assert out[("999", "DELETE")]["error"] == "Not found: Engine 999 not found"
    assert out[("125", "DELETE")]["error"] == "Not allowed: Engine 125 is in Running state, cannot be deleted"
    assert out[("126", "DELETE")]["removed"] is True
    assert (out[("127", "RESTART")]["new_kind"], out[("127", "RESTART")]["new_next_update_time"]) == ("Running", 1000)
    assert out[("125", "STOP")]["new_kind"] == "WaitToTerminate"


# ------------------------------------------------------------------ monitor round

def test_sync_round_cases(spark):
    recs = [
        ("a", "WaitToStart", None, 1, "3.5.4", None), ("b", "WaitToStart", None, 1, "3.5.5", None),
        ("c", "WaitToTerminate", None, 1, "3.5.4", None), ("d", "WaitToTerminate", None, 1, "3.5.4", None),
        ("e", "ErrorWaitToClean", "s", 1, "3.5.4", None), ("f", "ErrorWaitToClean", "s", 1, "3.5.4", None),
        ("g", "WaitToStart", None, 1, "3.5.4", None),  # crash: no outcome row
        ("h", "StartInProgress", None, 1, "3.5.4", None), ("i", "StartInProgress", None, 1, "3.5.4", None),
        ("j", "TriggerStart", None, 1, "3.5.4", None), ("k", "Running", None, 1, "3.5.4", None),
        ("l", "Terminated", None, 1, "3.5.4", None),  # a due stable record is illegal
        ("m", "Running", None, 1000, "3.5.4", None),  # not due: strictly before now only
        ("n", "ErrorCleanInProgress", "s", 1, "3.5.4", None),
    ]
    r = reg(spark, recs)
    outcomes = spark.createDataFrame([("a", None), ("b", "3.5.5 is invalid"), ("c", None), ("d", "e1"),
                                      ("e", None), ("f", "e2")], "id string, err_msg string")
    obs = spark.createDataFrame([("h", 1, "Running"), ("i", 1, "Pending"), ("k", 1, None)],
                                "id string, t int, phase string").select(
        "id", F.timestamp_seconds("t").alias("ts"), F.lit(1).alias("l_linenumber"), F.lit(1).alias("l_partkey"),
        F.lit(1).alias("l_suppkey"), "phase")
    out = {x["id"]: (x["action"], x["state_kind"], x["state_message"], x["next_update_time"], x["status"])
           for x in planning.sync_round(r, obs, outcomes, P).collect()}
    assert out["a"] == ("RELEASE_OK", "StartInProgress", None, 1003, "ok")
    assert out["b"] == ("RELEASE_ERR", "ErrorClean", "3.5.5 is invalid", None, "ok")
    assert out["c"] == ("RELEASE_OK", "TerminateInProgress", None, 1003, "ok")
    assert out["d"] == ("RELEASE_ERR", "ErrorWaitToClean", "e1", 1000, "ok")
    assert out["e"] == ("RELEASE_OK", "ErrorCleanInProgress", "s", 1003, "ok")
    assert out["f"] == ("RELEASE_ERR", "ErrorWaitToClean", "s\n\ne2", 1000, "ok")
    assert out["g"] == ("CRASH", "TriggerStart", None, 1005, "ok")
    assert out["h"] == ("PHASE_Running", "Running", None, 1003, "ok")
    assert out["i"] == ("PHASE_Pending", "StartInProgress", None, 1003, "ok")  # unchanged still writes
    assert out["j"] == ("TIMEOUT", "WaitToStart", None, 1000, "ok")
    assert out["k"] == ("PHASE_Unknown", "Running", None, 1003, "ok")  # NULL phase reads as Unknown
    assert out["l"][4] == "illegal"
    assert "m" not in out
    assert out["n"] == ("PHASE_NotExisted", "ErrorClean", "s", None, "ok")  # no pod: NotExisted


def test_due_boundary(spark):
    r = reg(spark, [("a", "Running", None, 999, "3.5.4", None), ("b", "Running", None, 1000, "3.5.4", None),
                    ("c", "Running", None, 1001, "3.5.4", None), ("d", "Running", None, None, "3.5.4", None)])
    assert rows(registry.due_records(r, P), "id") == [("a",)]


def test_competing_claims(spark):
    r = reg(spark, [("a", "WaitToStart", None, 1, "3.5.4", None), ("b", "Running", None, 1, "3.5.4", None)])
    claims = spark.createDataFrame([("a", 5, "m1", 1, 1), ("a", 5, "m0", 1, 1), ("a", 9, "m2", 1, 1),
                                    ("b", 1, "m0", 1, 1), ("z", 1, "m0", 1, 1)],
                                   "id string, t int, claimant string, seq long, tiebreak long").select(
        "id", F.timestamp_seconds("t").alias("ts"), "claimant", "seq", "tiebreak")
    out = {(x["id"], x["claimant"]): (x["outcome"], x["state_kind"]) for x in planning.acquire(claims, r, P).collect()}
    assert out[("a", "m0")] == ("Success", "TriggerStart")
    assert out[("a", "m1")] == ("Fail", "TriggerStart") and out[("a", "m2")] == ("Fail", "TriggerStart")
    assert out[("b", "m0")] == ("Fail", "Running")
    assert out[("z", "m0")][0] == "NotFound"


def test_cas_compares_message(spark):
    r = reg(spark, [("a", "ErrorClean", "x", None, "3.5.4", None), ("b", "ErrorClean", "x", None, "3.5.4", None)])
    u = spark.createDataFrame([("a", "ErrorClean", "x", "Terminated"), ("b", "ErrorClean", "y", "Terminated"),
                               ("c", "Running", None, "Terminated")],
                              "id string, before_kind string, before_message string, after_kind string").select(
        "*", F.lit(None).cast("string").alias("after_message"), F.lit(None).cast("bigint").alias("next_update_time"))
    out = {x["id"]: (x["outcome"], x["current_message"]) for x in registry.cas_update(u, r).collect()}
    assert out == {"a": ("Success", "x"), "b": ("Fail", "x"), "c": ("NotFound", None)}


# ------------------------------------------------------------------ launch arguments

GOLDEN_EMPTY = [
    "--master", "k8s://https://kubernetes:443", "--deploy-mode", "client",
    "--packages", "org.apache.spark:spark-connect_2.12:3.5.3",
    "--conf", "spark.app.id=PFX-abc",
    "--conf", "spark.driver.extraJavaOptions=-Divy.cache.dir=/tmp -Divy.home=/tmp",
    "--conf", "spark.driver.host=PFX-abc",
    "--conf", "spark.kubernetes.container.image=apache/spark:3.5.3",
    "--conf", "spark.kubernetes.driver.pod.name=PFX-abc-driver",
    "--conf", "spark.kubernetes.executor.podNamePrefix=PFX-abc",
]


def _plan(spark, recs, prefix="PFX-"):
    df = spark.createDataFrame(recs, "id string, version string, config map<string,string>")
    return {x["id"]: x["p"] for x in df.select(
        "id", launch.launch_plan(F.col("id"), F.col("version"), F.col("config"), prefix).alias("p")).collect()}


def test_launch_goldens(spark):
    out = _plan(spark, [("abc", "3.5.3", {}), ("abd", "3.5.3", {"spark.executor.instances": "2"})])
    assert out["abc"]["args"] == GOLDEN_EMPTY and len(out["abc"]["args"]) == 18
    two = [a.replace("abc", "abd") for a in GOLDEN_EMPTY] + ["--conf", "spark.executor.instances=2"]
    assert out["abd"]["args"] == two and len(two) == 20


def test_reserved_keys_and_version(spark):
    recs = [(f"r{i}", "3.5.3", {k: ""}) for i, k in enumerate(launch.RESERVED_KEYS)]
    recs += [("v", "3.5.5", {"spark.app.id": "x"}), ("two", "3.5.4", {"spark.driver.host": "", "spark.app.id": ""})]
    out = _plan(spark, recs)
    for i, k in enumerate(launch.RESERVED_KEYS):
        assert out[f"r{i}"]["status"] == "reserved_key"
        assert out[f"r{i}"]["error"].startswith(f"Not allowed: The config {k} is not allowed as it is reserved.")
    assert out["v"]["status"] == "bad_version"  # the version is checked first
    assert out["v"]["error"] == 'Not allowed: Spark version 3.5.5 is not supported. Supported versions: ["3.5.3", "3.5.4"]'
    assert out["two"]["error"].startswith("Not allowed: The config spark.app.id ")  # first in key order


def test_derived_names(spark):
    df = spark.createDataFrame([("abc", "3.5.4")], "id string, v string")
    n = launch.derived_names(F.col("id"), F.col("v"), "PFX-")
    r = df.select(*[c.alias(k) for k, c in n.items()]).collect()[0]
    assert (r["app_id"], r["driver_name"], r["service_name"]) == ("PFX-abc", "PFX-abc-driver", "PFX-abc")
    assert r["image"] == "apache/spark:3.5.4" and r["package"] == "org.apache.spark:spark-connect_2.12:3.5.4"


# ------------------------------------------------------------------ time and errors

def test_time_format_and_parse(spark):
    df = spark.createDataFrame([(883612800,)], "t long").select(F.timestamp_seconds("t").alias("ts"))
    assert df.select(C.format_time("ts")).collect()[0][0] == "1998-01-01 00:00:00 +00:00:00"
    txt = spark.createDataFrame([("1998-01-01 00:00:00 +00:00:00",), ("1998-01-01 00:00:00 +05:30:15",), ("junk",)], "s string")
    got = [r[0] for r in txt.select(F.unix_seconds(C.parse_time("s"))).collect()]
    assert got == [883612800, 883612800 - (5 * 3600 + 30 * 60 + 15), None]
    assert df.select(C.elapsed_seconds("ts", 883612810)).collect()[0][0] == 10


def test_error_kinds(spark):
    df = spark.createDataFrame([(k,) for k, _, _ in C.ERROR_KINDS], "k string")
    got = {r[0]: (r[1], r[2]) for r in df.select("k", C.error_display("k"), C.error_status("k")).collect()}
    assert got["NotFound"] == ("Not found", 404) and got["NotAllowed"] == ("Not allowed", 403)
    assert got["Unauthorized"] == ("Unauthorized", 401) and got["FailToLoadConfig"][1] == 500
    assert len(got) == 11


def test_error_kind_table_and_flows(spark):
    from fleetstate.operators.commands import error_kinds_df
    d = {r["kind"]: r["http_status"] for r in error_kinds_df(spark).collect()}
    assert len(d) == 11 and d["NotFound"] == 404 and d["FailToStartEngine"] == 500
    df = spark.createDataFrame([("TriggerTermination",), ("ErrorClean",), ("Running",)], "k string")
    assert [r[0] for r in df.select(C.state_flow("k")).collect()] == ["terminate", "error_clean", "start"]


def test_sync_round_launch_check(spark):
    """The start of a WaitToStart engine runs the launch checks; a refusal is the release error."""
    r = reg(spark, [("a", "WaitToStart", None, 1, "3.5.5", None), ("b", "WaitToStart", None, 1, "3.5.4", None),
                    ("c", "WaitToStart", None, 1, "3.5.4", {"spark.driver.host": "x"}),
                    ("d", "WaitToTerminate", None, 1, "3.5.5", None)])
    outcomes = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", None)], "id string, err_msg string")
    obs = spark.createDataFrame([], "id string, ts timestamp, l_linenumber int, l_partkey long, l_suppkey long, phase string")
    out = {x["id"]: (x["state_kind"], x["state_message"])
           for x in planning.sync_round(r, obs, outcomes, P, launch_check=True).collect()}
    assert out["a"] == ("ErrorClean", 'Not allowed: Spark version 3.5.5 is not supported. Supported versions: ["3.5.3", "3.5.4"]')
    assert out["b"] == ("StartInProgress", None)
    assert out["c"] == ("ErrorClean", "Not allowed: The config spark.driver.host is not allowed as it is reserved.")
    assert out["d"] == ("TerminateInProgress", None)  # only starts are checked


def test_write_back_and_delete(spark):
    r = reg(spark, [("a", "WaitToStart", None, 5, "3.5.4", None), ("b", "Running", None, 9, "3.5.4", None),
                    ("c", "Terminated", None, None, "3.5.4", None)])
    ch = spark.createDataFrame([("a", "Terminated", None, None, False), ("c", None, None, None, True)],
                               "id string, state_kind string, state_message string, next_update_time long, removed boolean")
    nxt = {x["id"]: (x["state_kind"], x["next_update_time"]) for x in registry.apply_changes(r, ch).collect()}
    assert nxt == {"a": ("Terminated", None), "b": ("Running", 9)}
    dels = spark.createDataFrame([("a", "WaitToStart", None), ("b", "Terminated", None), ("q", "Running", None)],
                                 "id string, before_kind string, before_message string")
    out, rest = registry.conditional_delete(dels, r)
    assert dict((x["id"], x["outcome"]) for x in out.collect()) == {"a": "Success", "b": "Fail", "q": "NotFound"}
    assert sorted(x["id"] for x in rest.collect()) == ["b", "c"]


def test_sync_round_custom_observation_order(spark):
    r = reg(spark, [("a", "StartInProgress", None, 1, "3.5.4", None)])
    obs = spark.createDataFrame([("a", 5, 1, "Pending"), ("a", 5, 2, "Running"), ("a", 4, 9, "Failed")],
                                "id string, t long, seq long, phase string").select(
        "id", F.timestamp_seconds("t").alias("ts"), "seq", "phase")
    outcomes = spark.createDataFrame([], "id string, err_msg string")
    x = planning.sync_round(r, obs, outcomes, P, obs_order=["ts", "seq"]).collect()[0]
    assert (x["action"], x["state_kind"]) == ("PHASE_Running", "Running")  # newest by (ts, seq)


def test_route_requests(spark):
    from fleetstate.operators.commands import route_requests
    log = spark.createDataFrame([(1, "POST", "/engine"), (2, "GET", "/engine"), (3, "GET", "/engine/abc"),
                                 (4, "DELETE", "/engine/abc"), (5, "POST", "/engine/abc/stop"),
                                 (6, "POST", "/engine/abc/restart"), (7, "GET", "/engine/abc/stop"),
                                 (8, "GET", "/engine/"), (9, "GET", "/any"), (10, "PUT", "/engine/abc")],
                                "event_id long, method string, path string")
    got = {r["event_id"]: (r["operation"], r["id"], r["route_status"]) for r in route_requests(log).collect()}
    assert got[1] == ("create", None, "routed") and got[2] == ("list", None, "routed")
    assert got[3] == ("get", "abc", "routed") and got[4] == ("delete", "abc", "routed")
    assert got[5] == ("stop", "abc", "routed") and got[6] == ("restart", "abc", "routed")
    assert got[7][2] == "MethodNotAllowed" and got[10][2] == "MethodNotAllowed"
    assert got[8][2] == "NotFound" and got[9][2] == "NotFound"


def test_release_and_retry(spark):
    r = reg(spark, [("a", "TriggerStart", None, 1, "3.5.4", None), ("b", "TriggerTermination", None, 1, "3.5.4", None),
                    ("c", "ErrorTriggerClean", "s", 1, "3.5.4", None), ("d", "TriggerStart", None, 5000, "3.5.4", None),
                    ("e", "Running", None, 1, "3.5.4", None)])
    outcomes = spark.createDataFrame([("a", None), ("b", "e1"), ("c", "e2")], "id string, err_msg string")
    rel = {x["id"]: (x["signal"], x["state_kind"], x["state_message"], x["next_update_time"], x["written"])
           for x in planning.release(r, outcomes, P).collect()}
    assert rel["a"] == ("RELEASE_OK", "StartInProgress", None, 1003, True)
    assert rel["b"] == ("RELEASE_ERR", "ErrorWaitToClean", "e1", 1000, True)
    assert rel["c"] == ("RELEASE_ERR", "ErrorWaitToClean", "s\n\ne2", 1000, True)
    assert rel["d"] == ("CRASH", "TriggerStart", None, None, False)  # no result: stays until its timeout
    assert "e" not in rel
    ret = {x["id"]: (x["state_kind"], x["state_message"], x["next_update_time"])
           for x in planning.retry_timeouts(r, P).collect()}
    assert ret == {"a": ("WaitToStart", None, 1000), "b": ("WaitToTerminate", None, 1000),
                   "c": ("ErrorWaitToClean", "s", 1000)}  # d is not due yet


def test_reconcile_cases(spark):
    from fleetstate.operators.observe import reconcile
    r = reg(spark, [("a", "ErrorCleanInProgress", "s", 1, "3.5.4", None), ("b", "TerminateInProgress", None, 1, "3.5.4", None),
                    ("c", "TerminateInProgress", None, 1, "3.5.4", None), ("d", "Running", None, 1, "3.5.4", None),
                    ("e", "Running", None, 1, "3.5.4", None), ("f", "WaitToStart", None, 1, "3.5.4", None)])
    obs = spark.createDataFrame([("b", 1, "Running"), ("d", 1, "Pending"), ("e", 1, "Exploded")],
                                "id string, t long, phase string").select(
        "id", F.timestamp_seconds("t").alias("ts"), F.lit(1).alias("l_linenumber"), F.lit(1).alias("l_partkey"),
        F.lit(1).alias("l_suppkey"), "phase")
    out = {x["id"]: (x["phase"], x["state_kind"], x["state_message"], x["next_update_time"], x["status"])
           for x in reconcile(r, obs, P).collect()}
    assert out["a"] == ("NotExisted", "ErrorClean", "s", None, "changed")       # message kept
    assert out["b"] == ("Running", "TerminateInProgress", None, 1003, "unchanged")  # heartbeat still writes
    assert out["c"] == ("NotExisted", "Terminated", None, None, "changed")
    assert out["d"] == ("Pending", "ErrorCleanInProgress", "Engine restarts unexpected.", 1003, "changed")
    assert out["e"][0] is None and out["e"][4] == "illegal"                      # unknown phase text
    assert "f" not in out                                                         # only in-progress records


def test_command_responses(spark):
    from fleetstate.operators.commands import command_responses
    r = reg(spark, [("a", "Running", None, 1, "3.5.4", None), ("b", "ErrorClean", 'x"y', None, "3.5.4", None)])
    routed = spark.createDataFrame([(1, "a", "stop"), (2, "a", "delete"), (3, "b", "stop"), (4, "z", "get"),
                                    (5, "b", "get"), (6, "b", "delete")], "event_id long, id string, operation string")
    out = {x["event_id"]: (x["kind"], x["http_status"], x["message"], x["kind_display"], x["state_kind"])
           for x in command_responses(routed, r, P).collect()}
    assert out[1] == ("Ok", 200, None, None, "WaitToTerminate")
    assert out[2] == ("NotAllowed", 403, "Not allowed: Engine a is in Running state, cannot be deleted", "Not allowed", None)
    assert out[3][2] == 'Not allowed: Engine b is in ErrorClean("x\\"y") state, cannot be stopped'
    assert out[4] == ("NotFound", 404, "Not found: Engine z not found", "Not found", None)
    assert out[5] == ("Ok", 200, None, None, "ErrorClean")
    assert out[6] == ("Ok", 200, None, None, "Removed")


def test_hot_id_claims_have_one_winner(spark):
    r = reg(spark, [("h", "WaitToTerminate", None, 1, "3.5.4", None), ("c", "WaitToStart", None, 1, "3.5.4", None)])
    rows = [("h", 100 + (i * 7919) % 997, f"m{i % 13}", i, i) for i in range(3000)] + [("c", 5, "m1", 1, 1)]
    claims = spark.createDataFrame(rows, "id string, t long, claimant string, seq long, tiebreak long").select(
        "id", F.timestamp_seconds("t").alias("ts"), "claimant", "seq", "tiebreak")
    out = planning.acquire(claims, r, P).collect()
    wins = [x for x in out if x["outcome"] == "Success"]
    assert sorted(x["id"] for x in wins) == ["c", "h"]
    first = min((x for x in rows if x[0] == "h"), key=lambda x: (x[1], x[2], x[3], x[4]))
    assert [x["seq"] for x in wins if x["id"] == "h"] == [first[3]]
    assert all(x["state_kind"] == "TriggerTermination" for x in out if x["id"] == "h")
    assert sum(1 for x in out if x["outcome"] == "Fail") == 2999

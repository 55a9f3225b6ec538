"""Request validation against a plain walk over the keys, on bodies of every shape."""

import json
import random

from fleetstate.sources import ingest

EXPECTED = ", ".join(f"`{f}`" for f in ingest.REQUEST_FIELDS)


def plain(body):
    """(reason, detail, name, engine_type, version, config) of a body, key by key."""
    if body is None:
        return ("malformed", "malformed JSON", None, None, None, None)
    try:
        pairs = json.loads(body, object_pairs_hook=list)
        value = json.loads(body)
    except ValueError:
        return ("malformed", "malformed JSON", None, None, None, None)
    if not isinstance(value, dict):
        return ("not_object", "invalid type, expected struct CreateEngineRequest", None, None, None, None)
    seen = set()
    for k, _ in pairs:
        v = value[k]
        if k not in ingest.REQUEST_FIELDS:
            return ("unknown_field", f"unknown field `{k}`, expected one of {EXPECTED}", None, None, None, None)
        if k in seen:
            return ("duplicate_field", f"duplicate field `{k}`", None, None, None, None)
        seen.add(k)
        if k in ("name", "version") and not isinstance(v, str):
            return ("bad_type", f"{k}: invalid type, expected a string", None, None, None, None)
        if k == "engine_type" and not isinstance(v, str):
            return ("bad_type", "engine_type: invalid type, expected variant identifier", None, None, None, None)
        if k == "engine_type" and v != "Spark":
            return ("unknown_variant", f"engine_type: unknown variant `{v}`, expected `Spark`", None, None, None, None)
        if k == "config" and v is not None and not isinstance(v, dict):
            return ("bad_type", "config: invalid type, expected a map", None, None, None, None)
        if k == "config":
            for ck, cv in (v or {}).items():
                if not isinstance(cv, str):
                    return ("bad_type", f"config.{ck}: invalid type, expected a string", None, None, None, None)
    for f in ingest.REQUIRED_FIELDS:
        if f not in seen:
            return ("missing_field", f"missing field `{f}`", None, None, None, None)
    return (None, None, value["name"], value["engine_type"], value["version"], value.get("config") or {})


def bodies():
    r = random.Random(8)
    out = [None, "", "{}", "[]", "null", "1", '"x"', "{", '{"name":"a"} {"name":"b"}', '{"name":"a","engine_type":"Spark","version":"1"}x',
           '  {"version":"1","engine_type":"Spark","name":"}"}  ', '{"name":"a\\"}","engine_type":"Spark","version":"{}"}', '[{"name":"a"}]', '{"name":"a","engine_type":"Spark","version":"1"},']
    text = ['"a"', '"Spark"', '"}{"', '""', "null", "1", "true", "[1]", '{"k":"v"}']
    config = ["null", "{}", '{"k":"v"}', '{"k":1}', '{"b":1,"a":2}', '{"k":"v","l":"}"}', '"x"', "[]", '{"k":null}', '{"k":{"x":"y"}}']
    for _ in range(700):
        keys = ["name", "engine_type", "version"]
        good = {"name": '"n"', "engine_type": '"Spark"', "version": '"3.5.3"'}
        pairs = [(k, good[k] if r.random() < 0.85 else r.choice(text)) for k in keys if r.random() < 0.93]
        if r.random() < 0.6:
            pairs.append(("config", r.choice(config)))
        if r.random() < 0.15:
            pairs.append((r.choice(["x", "Name", ""]), r.choice(text)))
        if r.random() < 0.1 and pairs:
            pairs.append(r.choice(pairs))
        r.shuffle(pairs)
        body = "{" + ",".join(f'"{k}":{v}' for k, v in pairs) + "}"
        out.append(body if r.random() < 0.95 else body[: r.randrange(len(body))])
    return out


def test_every_body_equals_the_plain_walk(spark):
    rows = list(enumerate(bodies()))
    df = spark.createDataFrame(rows, "request_id long, body string")
    got = {r["request_id"]: (r["reason"], r["detail"], r["name"], r["engine_type"], r["version"], r["config"]) for r in ingest.validate_requests(df).collect()}
    wrong = [(b, got[i], plain(b)) for i, b in rows if got[i] != plain(b)]
    assert not wrong, wrong[:5]
    assert {g[0] for g in got.values()} == {None, "malformed", "not_object", "unknown_field", "duplicate_field", "bad_type", "unknown_variant", "missing_field"}

"""Strict ingest of create requests (A2), record creation (A3), state and id wire forms.

All checks are column expressions over the JSON text, so ingest is a narrow, shuffle-free map
that splits one input into a good and a dead-letter DataFrame.

Rules of the request body (closed world):
* the body must be a JSON object (else ``malformed`` / ``not_object``);
* the first problem in document order wins: an unknown field, a repeated field, an engine type
  other than the one supported, a value of the wrong JSON type (``config`` must be null or an
  object of strings);
* then the first missing field in the order name, engine_type, version;
* a null or absent ``config`` is an empty map; inside ``config`` a repeated key keeps the last value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstate.functions.columns import ERROR_STATES, UNIT_STATES
from fleetstate.model import Params

# --- fixed values: the request's fields and the supported engine types ------
REQUEST_FIELDS = ["name", "engine_type", "version", "config"]
REQUIRED_FIELDS = ["name", "engine_type", "version"]
ENGINE_TYPES = ["Spark"]
# --- end of fixed values -----------------------------------------------------

_EXPECTED = ", ".join(f"`{f}`" for f in REQUEST_FIELDS)
_VARIANTS = ", ".join(f"`{t}`" for t in ENGINE_TYPES)


def validate_requests(requests: DataFrame, body_col: str = "body") -> DataFrame:
    """A2: add ``reason`` (NULL when valid), ``detail`` and the typed fields to every request.

    A body is parsed once, to a variant. That fails for malformed text and for repeated keys, so where
    it succeeds each field has one value, and names and types are checked on it. A body with one
    problem at most is settled by that, whatever the order of its keys. Only the others, and those
    that don't parse, take the slow path, which finds the first problem: the key list in document
    order, typed fields and config map are parsed for them alone, every per-field check becomes a
    boolean column, and the walk over the keys only picks the first failing one.
    """
    body = F.col(body_col)
    kind = F.schema_of_variant
    one = requests.select(*[F.col(c) for c in requests.columns], F.try_parse_json(body).alias("__p"))
    one = one.select("*", F.try_variant_get("__p", "$", "map<string,variant>").alias("__m"))
    one = one.select("*", *[F.try_element_at("__m", F.lit(f)).alias(f"__f_{f}") for f in REQUEST_FIELDS],
                     F.when(F.size("__m") > 0, F.array_except(F.map_keys("__m"), F.array(*[F.lit(f) for f in REQUEST_FIELDS]))).alias("__extra"))
    given = F.col("__f_config").isNotNull()
    one = one.select("*", F.when(given, F.try_variant_get("__f_config", "$", "map<string,variant>")).alias("__f_map"))
    entries = F.col("__f_map")

    def bad_if(f, wrong):
        return F.coalesce(F.col(f"__f_{f}").isNotNull() & wrong, F.lit(False)).alias(f"__bad_{f}")

    one = one.select(
        "*", *[bad_if(f, kind(F.col(f"__f_{f}")) != "STRING") for f in REQUIRED_FIELDS],
        bad_if("config", entries.isNull() & (kind(F.col("__f_config")) != "VOID")),
        F.when(F.size(entries) > 0, F.filter(F.map_keys(entries), lambda k: kind(F.try_element_at(entries, k)) != "STRING")).alias("__bad_keys"),
        F.try_variant_get("__f_engine_type", "$", "string").alias("__f_et"))
    bad = lambda f: F.col(f"__bad_{f}")
    strange = F.coalesce(~bad("engine_type") & ~F.col("__f_et").isin(*ENGINE_TYPES), F.lit(False))
    count = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    problems = count("__extra") + count("__bad_keys") + sum(F.when(x, 1).otherwise(0) for x in [bad("name"), bad("version"), bad("engine_type"), strange, bad("config")])
    # exactly one value: it ends with its brace, and has no braces but its own and the config's
    closing = F.length(body) - F.length(F.replace(body, F.lit("}"), F.lit("")))
    whole = F.rtrim(body).endswith("}") & (closing == F.when(entries.isNotNull(), 2).otherwise(1))
    plain_case = F.coalesce(F.col("__m").isNotNull() & whole & (problems <= 1), F.lit(False))
    # a value that isn't an object needs no second look, either
    other = F.col("__p").isNotNull() & F.col("__m").isNull()
    only = lambda c: F.try_element_at(c, F.lit(1))
    lacking = F.coalesce(*[F.when(F.col(f"__f_{f}").isNull(), F.lit(f)) for f in REQUIRED_FIELDS])
    found = (F.when(other, F.struct(F.lit("not_object").alias("reason"), F.lit("invalid type, expected struct CreateEngineRequest").alias("detail")))
             .when(count("__extra") > 0, _unknown(only("__extra")))
             .when(bad("name"), _bad("name", "a string")).when(bad("version"), _bad("version", "a string"))
             .when(bad("engine_type"), _bad("engine_type", "variant identifier")).when(strange, _variant(F.col("__f_et")))
             .when(bad("config"), _bad("config", "a map")).when(count("__bad_keys") > 0, _bad_value(only("__bad_keys")))
             .when(lacking.isNotNull(), _missing(lacking)))
    one = one.select(*requests.columns, "__p", "__m", (~(plain_case | other)).alias("__slow"), F.when(plain_case | other, found).alias("__found"))
    slow = F.col("__slow")
    fields = F.when(~slow & F.col("__found").isNull(), F.try_variant_get("__p", "$", "struct<name:string,engine_type:string,version:string,config:map<string,string>>"))
    parsed = one.select(*requests.columns, "__p", "__slow", "__found", fields.alias("__s"), F.when(slow, F.json_object_keys(body)).alias("__keys"))
    parsed = parsed.select(
        "*",
        F.when(F.col("__keys").isNotNull(), F.from_json(body, "name variant, engine_type variant, version variant, config variant")).alias("__v"),
        # only bodies that name a config are parsed for it
        F.when(F.col("__keys").isNotNull() & (body.contains("config") | body.contains("\\")), F.from_json(F.get_json_object(body, "$.config"), "map<string,variant>")).alias("__cfg"),
    )
    v, cfg = F.col("__v"), F.col("__cfg")

    def is_str(f):
        return F.coalesce(F.schema_of_variant(v.getField(f)) == "STRING", F.lit(False))

    cfg_type = F.schema_of_variant(v.getField("config"))
    checks = parsed.select(
        "*",
        F.when(slow, F.try_variant_get(v.getField("engine_type"), "$", "string")).alias("__et"),
        (slow & ~is_str("name")).alias("__name_bad"),
        (slow & ~is_str("version")).alias("__version_bad"),
        (slow & ~is_str("engine_type")).alias("__et_bad"),
        (slow & (cfg_type != "VOID") & cfg.isNull()).alias("__cfg_bad"),
        # first config key, in document order, whose value is not a JSON string
        F.when(slow & (cfg_type != "VOID"), F.try_element_at(
            F.filter(F.map_keys(cfg), lambda k: F.schema_of_variant(F.try_element_at(cfg, k)) != "STRING"),
            F.lit(1))).alias("__cfg_bad_key"),
    )
    keys = F.col("__keys")
    fields = F.array(*[F.lit(f) for f in REQUEST_FIELDS])

    def problem(k, i):
        return (
            F.when(~F.array_contains(fields, k), _unknown(k))
            .when(F.array_position(keys, k) < i + 1,
                  F.struct(F.lit("duplicate_field").alias("reason"),
                           F.concat(F.lit("duplicate field `"), k, F.lit("`")).alias("detail")))
            .when((k == "name") & F.col("__name_bad"), _bad("name", "a string"))
            .when((k == "version") & F.col("__version_bad"), _bad("version", "a string"))
            .when((k == "engine_type") & F.col("__et_bad"), _bad("engine_type", "variant identifier"))
            .when((k == "engine_type") & ~F.col("__et").isin(*ENGINE_TYPES), _variant(F.col("__et")))
            .when((k == "config") & F.col("__cfg_bad"), _bad("config", "a map"))
            .when((k == "config") & F.col("__cfg_bad_key").isNotNull(), _bad_value(F.col("__cfg_bad_key")))
        )

    first = F.try_element_at(F.filter(F.transform(keys, problem), lambda x: x.isNotNull()), F.lit(1))
    missing = F.coalesce(*[F.when(~F.array_contains(keys, F.lit(f)), F.lit(f)) for f in REQUIRED_FIELDS])
    # a NULL key list is malformed text or a non-object. The
    # parsers stop after the first value, so a body must also be exactly one value. It is, if it ends
    # with a brace and has no more closing braces than its object and the config need: the last one
    # then closes the object. Other bodies (braces in strings, nested values, trailing text) are
    # probed: "[" body "]" must be a one-element array and "[" body ",0]" a two-element one. Trailing
    # text either breaks one of the two or changes a count (a body can't close the wrapper early in both).
    plain = F.rtrim(body).endswith("}") & (closing == F.when(cfg.isNotNull(), 2).otherwise(1))
    one_value = ((F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1)
                 & (F.json_array_length(F.concat(F.lit("["), body, F.lit(",0]"))) == 2))
    bad_json = F.when(slow, F.when(keys.isNull(), F.col("__p").isNull()).when(plain, F.lit(False))
                      .otherwise(~F.coalesce(one_value, F.lit(False))))
    staged = checks.select("*", F.when(slow, first).alias("__first"), F.when(slow, missing).alias("__missing"), bad_json.alias("__bad_json"))
    first, missing, bad_json = F.col("__first"), F.col("__missing"), F.col("__bad_json")
    late = (F.when(bad_json, F.struct(F.lit("malformed").alias("reason"), F.lit("malformed JSON").alias("detail")))
            .when(keys.isNull(), F.struct(F.lit("not_object").alias("reason"), F.lit("invalid type, expected struct CreateEngineRequest").alias("detail")))
            .when(first.isNotNull(), first)
            .when(missing.isNotNull(), _missing(missing)))
    staged = staged.select("*", F.when(slow, late).otherwise(F.col("__found")).alias("__why"))
    why, easy = F.col("__why"), F.col("__s")
    ok = why.isNull()
    empty = F.create_map().cast("map<string,string>")

    def field(f):
        return F.when(~slow, easy[f]).when(ok, F.try_variant_get(v.getField(f), "$", "string")).alias(f)

    result = F.struct(
        why["reason"].alias("reason"), why["detail"].alias("detail"), field("name"), field("engine_type"), field("version"),
        F.when(ok, F.when(~slow, F.coalesce(easy["config"], empty)).otherwise(F.coalesce(F.transform_values(cfg, lambda _k, x: _vstr(x)), empty))).alias("config"),
    )
    # The result leaves through a generator: a later filter on ``reason`` (the good / dead-letter
    # split) then stays above it instead of being pushed down with the whole validation inlined
    # into the scan, which would run every check twice.
    return staged.select(*[F.col(c) for c in requests.columns], F.inline(F.array(result)))


def _vstr(x: Column) -> Column:
    return F.variant_get(x, "$", "string")


def _why(reason: str, *detail) -> Column:
    """A reject's reason and detail; the detail's columns and texts are joined."""
    return F.struct(F.lit(reason).alias("reason"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in detail]).alias("detail"))


def _bad(path: str, expected: str) -> Column:
    return _why("bad_type", f"{path}: invalid type, expected {expected}")


def _unknown(key: Column) -> Column:
    return _why("unknown_field", "unknown field `", key, f"`, expected one of {_EXPECTED}")


def _variant(value: Column) -> Column:
    return _why("unknown_variant", "engine_type: unknown variant `", value, f"`, expected {_VARIANTS}")


def _bad_value(key: Column) -> Column:
    return _why("bad_type", "config.", key, ": invalid type, expected a string")


def _missing(field: Column) -> Column:
    return _why("missing_field", "missing field `", field, "`")


def split_requests(requests: DataFrame, body_col: str = "body") -> tuple[DataFrame, DataFrame]:
    """(good, rejects). Both come from one validated projection; write them in one pass
    (``foreachBatch`` or a cached frame) when the source is expensive to re-read."""
    checked = validate_requests(requests, body_col)
    good = checked.where(F.col("reason").isNull()).drop("reason", "detail")
    bad = checked.where(F.col("reason").isNotNull()).select(*requests.columns, "reason", "detail")
    return good, bad


def bulk_create(good: DataFrame, p: Params, key_col: str = "request_id") -> DataFrame:
    """A3: new registry records in WaitToStart, next update now, create time now.

    The id is a SHA-256 of the request key, so re-running an ingest creates the same ids.
    """
    return good.select(
        F.sha2(F.col(key_col).cast("string"), 256).alias("id"),
        "name", "engine_type", "version",
        F.lit("WaitToStart").alias("state_kind"),
        F.lit(None).cast("string").alias("state_message"),
        F.coalesce(F.col("config"), F.create_map().cast("map<string,string>")).alias("config"),
        F.timestamp_seconds(F.lit(p.now)).alias("create_time"),
        F.lit(p.now).cast("bigint").alias("next_update_time"),
    )


def decode_state(wire: Column) -> Column:
    """A state from its wire form - "Kind" for unit states, {"ErrorKind": "msg"} for errors.

    Returns struct(kind, message, reason); reason is NULL when the text is a valid state.
    """
    v = F.try_parse_json(wire)
    t = F.schema_of_variant(v)
    unit = F.try_variant_get(v, "$", "string")
    keys = F.json_object_keys(wire)
    k0 = F.try_element_at(keys, F.lit(1))
    val = F.try_element_at(F.from_json(wire, "map<string,variant>"), k0)
    reason = (F.when(v.isNull(), "malformed")
              .when(t == "STRING", F.when(~unit.isin(*UNIT_STATES), "unknown_variant"))
              .when(t.startswith("OBJECT"),
                    F.when(F.size(keys) != 1, "not_one_key")
                    .when(~k0.isin(*ERROR_STATES), "unknown_variant")
                    .when(F.schema_of_variant(val) != "STRING", "bad_type"))
              .otherwise("bad_type"))
    kind = F.when(t == "STRING", unit).otherwise(k0)
    return F.struct(F.when(reason.isNull(), kind).alias("kind"),
                    F.when(reason.isNull() & (t != "STRING"), F.try_variant_get(val, "$", "string")).alias("message"),
                    reason.alias("reason"))


def validate_id(wire: Column) -> Column:
    """An id from its wire form ``{"id": "<non-empty>"}``; struct(id, reason)."""
    keys = F.json_object_keys(wire)
    v = F.try_parse_json(wire)
    idv = F.try_variant_get(v, "$.id", "variant")
    ok_shape = (keys.isNotNull() & (F.size(keys) == 1) & (F.try_element_at(keys, F.lit(1)) == "id")
                & (F.schema_of_variant(idv) == "STRING"))
    txt = F.variant_get(idv, "$", "string")
    reason = (F.when(~F.coalesce(ok_shape, F.lit(False)), "bad_shape")
              .when(F.length(txt) == 0, "empty"))
    detail = (F.when(reason == "bad_shape", 'Failed to deserialize EngineId, expect a map `{"id": <non empty string>}`')
              .when(reason == "empty", "Not allowed: Engine id cannot be empty."))
    return F.struct(F.when(reason.isNull(), txt).alias("id"), reason.alias("reason"), detail.alias("detail"))

"""Bridge views: lifecycle-shaped inputs derived from the shared test tables.

Each function reads only the parquet columns it needs (Catalyst prunes the
scan) and derives a lifecycle input with plain column expressions, so every
query grows with the tables it reads. The same views exist as SQL text for
DuckDB in ``fleetstate.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstate.model import STATES


# Read schemas of the shared tables (the columns the views use); declared, never inferred.
TABLE_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.read.schema(TABLE_SCHEMAS[name]) if name in TABLE_SCHEMAS else spark.read
    return reader.parquet(path)


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a file stream (declared schema, never inferred per batch)."""
    schema = TABLE_SCHEMAS.get(name) or spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(sf_dir.rstrip("/"))


def _pick(index: Column, values: list[str]) -> Column:
    """values[index] (0-based) as a literal-array lookup; stays in codegen."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _epoch(c: Column) -> Column:
    # test tables store TIMESTAMP_NTZ; the session clock is UTC
    return F.unix_seconds(c.cast("timestamp"))


def _eng(c: Column) -> Column:
    return F.concat(F.lit("eng-"), c.cast("string"))


def _props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _registry_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    slot = k % 12
    return o.select(
        k, F.col("o_custkey"),
        _eng(k).alias("id"),
        F.concat(F.lit("job-"), F.col("o_custkey").cast("string")).alias("name"),
        F.lit("Spark").alias("engine_type"),
        _pick(F.floor(k / 12).cast("bigint") % 4, ["3.5.2", "3.5.3", "3.5.4", "3.5.5"]).alias("version"),
        _pick(slot, STATES).alias("state_kind"),
        F.when(slot >= 8, F.col("o_orderpriority")).alias("state_message"),
        F.col("o_orderdate").cast("timestamp").alias("create_time"),
        F.when(slot.isin(7, 11), F.lit(None).cast("bigint"))
        .otherwise(_epoch(F.col("o_orderdate")) + F.col("o_custkey") % 3600).alias("next_update_time"),
    )


REGISTRY_COLUMNS = ["id", "name", "engine_type", "version", "state_kind", "state_message",
                    "config", "create_time", "next_update_time"]


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order id, all twelve states present; one config in five sets a value, and every
    second record that waits to start sets a reserved key."""
    k = F.col("o_orderkey")
    config = (F.when(k % 24 == 0, F.create_map(F.lit("spark.app.id"), F.lit("x")))
              .when(k % 5 == 1, F.create_map(F.lit("spark.executor.instances"), (F.col("o_custkey") % 9).cast("string")))
              .otherwise(F.create_map().cast("map<string,string>")))
    return _registry_base(spark, sf_dir).select(
        *[c for c in REGISTRY_COLUMNS if c != "config"][:6],
        config.alias("config"),
        "create_time", "next_update_time",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pod-phase observations, NULL phase one time in six."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return li.select(
        _eng(F.col("l_orderkey")).alias("id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_partkey") % 6 < 5,
               _pick(F.col("l_partkey") % 6, ["Pending", "Running", "Succeeded", "Failed", "Unknown"])).alias("phase"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands, monitor actions and observations as one ordered signal stream per id."""
    return signals_from(table(spark, sf_dir, "events"))


def signals_from(events: DataFrame) -> DataFrame:
    """The signal view over an events frame (batch or streaming)."""
    ev = events.select("event_id", "ts", "user_id", "props")
    k = _props_k()
    names = ["STOP", "RESTART", "ACQUIRE", "RELEASE_OK", "RELEASE_ERR", "TIMEOUT",
             "PHASE_Pending", "PHASE_Running", "PHASE_Succeeded", "PHASE_Failed", "PHASE_Unknown", "PHASE_NotExisted"]
    return ev.select(
        _eng(F.col("user_id")).alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(k == 0, F.lit("DELETE")).otherwise(_pick(k % 12, names)).alias("signal"),
        F.when((k != 0) & (k % 12 == 4), F.concat(F.lit("err-"), F.col("event_id").cast("string"))).alias("msg"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of resource actions; ids without a row crashed before reporting."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    return o.where(k % 7 != 0).select(_eng(k).alias("id"), F.when(k % 5 == 0, F.lit("boom")).alias("err_msg"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare-and-set requests, one per record: half carry a stale expected state, a third of all a
    stale message (their records stay as they are), some name absent ids.

    Derived from the registry rows of the same orders (one row per key), so no join is needed.
    """
    r = _registry_base(spark, sf_dir)
    k = F.col("o_orderkey")
    return r.select(
        F.when(k % 11 == 0, F.concat(F.lit("none-"), k.cast("string"))).otherwise(F.col("id")).alias("id"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("state_kind")).otherwise(F.lit("Running")).alias("before_kind"),
        F.when(k % 3 == 1, F.lit("an older message")).otherwise(F.col("state_message")).alias("before_message"),
        F.lit("Terminated").alias("after_kind"),
        F.lit(None).cast("string").alias("after_message"),
        F.lit(None).cast("bigint").alias("next_update_time"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create-request bodies as JSON text: valid shapes, a reserved key, null config, five kinds of bad body."""
    return requests_from(table(spark, sf_dir, "orders"))


def requests_from(orders: DataFrame) -> DataFrame:
    """The request view over an orders frame (batch or streaming)."""
    o = orders.select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    head = F.concat(F.lit('{"name":"job-'), c)
    body = (
        F.when(k % 10 == 4, F.concat(head, F.lit('","engine_type":"Spark","version":"3.5.3","config":null}')))
        .when(k % 10 == 5, F.lit('{"engine_type":"Spark","version":"3.5.3","config":{}}'))
        .when(k % 10 == 6, F.concat(head, F.lit('","invalid":"invalid"}')))
        .when(k % 10 == 7, F.concat(head, F.lit('","engine_type":"foo","config":{}}')))
        .when(k % 10 == 8, F.concat(head, F.lit('","engine_type":"Spark","version":"3.5.4","config":{"spark.executor.instances":1}}')))
        .when(k % 10 == 9, F.concat(head, F.lit('"')))
        .when(k % 10 == 3, F.concat(head, F.lit('","engine_type":"Spark","version":"3.5.4","config":{"spark.app.id":"x"}}')))
        .otherwise(F.concat(head, F.lit('","engine_type":"Spark","version":"3.5.4","config":{"spark.executor.instances":"'),
                            (F.col("o_custkey") % 9).cast("string"), F.lit('"}}')))
    )
    return o.select(k.alias("request_id"), body.alias("body"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP request log: (method, path) per event, one unknown route."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    t = F.col("event_type")
    eng = F.concat(F.lit("/engine/eng-"), F.col("user_id").cast("string"))
    return ev.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(t == "error", "DELETE").when(t.isin("click", "signup"), "POST").otherwise("GET").alias("method"),
        F.when(t.isin("view", "error"), eng)
        .when(t == "click", F.concat(eng, F.lit("/stop")))
        .when(t == "signup", F.concat(eng, F.lit("/restart")))
        .when(_props_k() % 2 == 0, F.lit("/engine")).otherwise(F.lit("/any")).alias("path"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competing acquire attempts by several monitors: one row per observation row of an id."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return li.select(
        _eng(F.col("l_orderkey")).alias("id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("monitor-"), (F.col("l_suppkey") % 3).cast("string")).alias("claimant"),
        F.col("l_linenumber").cast("bigint").alias("seq"),
        F.col("l_partkey").alias("tiebreak"),
    )


def state_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry states in wire form, with a share of corrupted texts (one kind per key residue)."""
    from fleetstate.functions.columns import encode_state

    r = _registry_base(spark, sf_dir)
    k = F.col("o_orderkey") % 13
    kind = F.col("state_kind")
    wire = (F.when(k == 0, F.concat(F.lit('{"'), kind, F.lit('":'), F.col("o_custkey").cast("string"), F.lit("}")))
            .when(k == 1, F.concat(F.lit('"'), F.lower(kind), F.lit('"')))
            .when(k == 2, F.concat(F.lit('{"'), kind, F.lit('":"a","x":"b"}')))
            .when(k == 3, F.concat(F.lit('"'), kind))
            .otherwise(encode_state(kind, F.col("state_message"))))
    return r.select("id", "state_kind", "state_message", wire.alias("wire"))


def id_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine ids in wire form: the map form plus bare, empty, extra-field, numeric and broken texts."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    ks = k.cast("string")
    wire = (F.when(k % 6 == 0, F.concat(F.lit('{"id":"eng-'), ks, F.lit('"}')))
            .when(k % 6 == 1, F.concat(F.lit('"eng-'), ks, F.lit('"')))
            .when(k % 6 == 2, F.lit('{"id":""}'))
            .when(k % 6 == 3, F.concat(F.lit('{"id":"eng-'), ks, F.lit('","other":"x"}')))
            .when(k % 6 == 4, F.concat(F.lit('{"id":'), ks, F.lit("}")))
            .otherwise(F.concat(F.lit('{"id":"eng-'), ks)))
    return o.select(k.alias("request_id"), wire.alias("wire"))


def time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creation times as offset text (three offsets), one in seven with a broken separator."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    off = F.when(k % 3 == 0, "+00:00:00").when(k % 3 == 1, "+05:30:15").otherwise("-03:00:00")
    base = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    base = F.when(k % 7 == 0, F.regexp_replace(base, " ", "T")).otherwise(base)
    return o.select(k.alias("request_id"), F.concat(base, F.lit(" "), off).alias("text"))


WAIT_ALLOWED = {
    "Running": ["WaitToStart", "TriggerStart", "StartInProgress"],
    "Terminated": ["WaitToStart", "TriggerStart", "StartInProgress", "Running", "WaitToTerminate", "TriggerTermination", "TerminateInProgress"],
    "ErrorClean": [s for s in STATES if s not in ("Terminated", "ErrorClean")],
}


def waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits for a state, registered at the time of one event in seven: three targets, deadlines of one to five days."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "props").where(_props_k() % 7 == 3)
    which = F.col("event_id") % 3
    targets = list(WAIT_ALLOWED)
    allowed = [F.array(*[F.lit(s) for s in WAIT_ALLOWED[t]]) for t in targets]
    ts = F.col("ts").cast("timestamp")
    return ev.select(
        _eng(F.col("user_id")).alias("id"), F.col("event_id").alias("wait_id"), ts.alias("ts"),
        _pick(which, targets).alias("target"), F.when(which == 0, allowed[0]).when(which == 1, allowed[1]).otherwise(allowed[2]).alias("allowed"),
        F.timestamp_micros(F.unix_micros(ts) + (F.col("event_id") % 5 + 1) * 86_400_000_000).alias("deadline"))


def cas_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered compare-and-set attempts, several per id: one per observation row of an order.

    Expected and new states cycle through all states; error states have one of three messages.
    ``seq`` packs the row's tie-breaks so (ts, seq) orders the attempts of an id totally. One id in
    thirteen is absent.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    k = F.col("l_orderkey")
    return li.select(
        F.when(k % 13 == 0, F.concat(F.lit("none-"), k.cast("string"))).otherwise(_eng(k)).alias("id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_linenumber").cast("bigint") + F.col("l_suppkey") * 8 + F.col("l_partkey") * (8 << 20)).alias("seq"),
        _pick(F.col("l_partkey") % 12, STATES).alias("before_kind"),
        F.when(F.col("l_partkey") % 12 >= 8, F.concat(F.lit("m"), (F.col("l_linenumber") % 3).cast("string"))).alias("before_message"),
        _pick(F.col("l_suppkey") % 12, STATES).alias("after_kind"),
        F.when(F.col("l_suppkey") % 12 >= 8, F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string"))).alias("after_message"),
        _epoch(F.col("l_shipdate")).alias("next_update_time"),
    )

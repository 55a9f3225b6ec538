"""Plan shape: pushdown and pruning reach the scan; rule tables are broadcast; custom rules plug in."""

from pyspark.sql import functions as F

from conftest import SF001
from fleetstate.model import REGISTRY_SCHEMA, Params, edges_df
from fleetstate.operators import planning, registry
from fleetstate.streaming.lifecycle import scratch_dir

P = Params(now=1000, interval=3, timeout=5)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _snapshot(spark):
    root = scratch_dir(spark, "snap")
    rows = [("a", "n", "Spark", "3.5.4", "Running", None, {}, None, 10),
            ("b", "n", "Spark", "3.5.4", "Terminated", None, {}, None, None)]
    registry.write_registry(spark.createDataFrame(rows, REGISTRY_SCHEMA), root)
    return registry.read_registry(spark, root)


def test_due_filter_and_pruning_reach_parquet(spark):
    reg = _snapshot(spark)
    plan = _plan(registry.due_records(reg, P).select("id", "state_kind"))
    assert "PushedFilters: [IsNotNull(next_update_time), LessThan(next_update_time,1000)]" in plan
    assert "ReadSchema: struct<id:string,state_kind:string,next_update_time:bigint>" in plan


def test_point_lookup_pushdown(spark):
    plan = _plan(registry.point_lookup(_snapshot(spark), "a"))
    assert "EqualTo(id,a)" in plan


def test_rule_table_is_broadcast(spark):
    reg = _snapshot(spark)
    cmds = spark.createDataFrame([("a", "STOP")], "id string, signal string")
    plan = _plan(planning.plan_commands(cmds, reg, P))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_pluggable_rules(spark):
    """A caller's rule table with the same columns replaces the built-in one."""
    reg = _snapshot(spark)
    custom = edges_df(spark).unionByName(spark.createDataFrame(
        [("Running", "STOP", "Terminated", "clear", "none", "server", None)], edges_df(spark).schema)).where(
        ~((F.col("from_kind") == "Running") & (F.col("signal") == "STOP") & (F.col("to_kind") == "WaitToTerminate")))
    cmds = spark.createDataFrame([("a", "STOP")], "id string, signal string")
    r = planning.plan_commands(cmds, reg, P, edges=custom).collect()[0]
    assert (r["outcome"], r["new_kind"], r["new_next_update_time"]) == ("Success", "Terminated", None)
    built_in = planning.plan_commands(cmds, reg, P).collect()[0]
    assert built_in["new_kind"] == "WaitToTerminate"


def test_size_for_input(spark):
    from fleetstate.session import input_bytes, size_for_input
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        path = "/root/testdata/sf0.1/lineitem.parquet"
        b = input_bytes(spark, [path])
        assert b > 1 << 20
        n = size_for_input(spark, [path], target_bytes=1 << 20, min_partitions=1)
        assert n == -(-b // (1 << 20))
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(n)
        assert size_for_input(spark, [path], min_partitions=64) == 64  # small inputs keep the floor
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(64 << 20))


def test_flagship_shape_without_broadcast(spark):
    """At scale the data joins are sort-merge joins: each input hashed on id once, the aggregate's
    partitioning reused by the join, and only the fixed rule tables broadcast."""
    import __spark_entry__ as E
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        plan = _plan(E.queries()["sync_round"](spark, "/root/testdata/sf0.01"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert plan.count("Exchange hashpartitioning(id") == 3  # registry, observations (after partial agg), outcomes
    assert plan.count("SortMergeJoin") == 2
    assert "partial_max(struct(ts" in plan  # map-side combine before the shuffle
    assert plan.count("BroadcastExchange") >= 1  # the rule table, whatever the threshold


def test_no_round_robin_and_no_hint_on_a_callers_rules(spark):
    from fleetstate.model import edges_df
    from fleetstate.operators.planning import illegal_transitions, sync_round
    from fleetstate.sources import fixtures as X

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        reg, obs, out = X.registry(spark, SF001), X.observations(spark, SF001), X.outcomes(spark, SF001)
        own = edges_df(spark)
        many = own.crossJoin(spark.range(3000).select(F.concat(F.lit("s"), "id").alias("x"))).withColumn("signal", F.concat("signal", "x")).drop("x").unionByName(own)
        df = sync_round(reg, obs, out, Params(), edges=many)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "RoundRobin" not in plan
        log = reg.select("id", F.col("state_kind").alias("from_kind"), F.col("state_kind").alias("to_kind"))
        assert "BroadcastExchange" not in illegal_transitions(log, many)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in sync_round(reg, obs, out, Params())._jdf.queryExecution().executedPlan().toString()
        cols = ["id", "state_kind", "state_message", "next_update_time"]
        assert sorted(map(str, df.select(*cols).collect())) == sorted(map(str, sync_round(reg, obs, out, Params()).select(*cols).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_claims_on_a_hot_id_are_split(spark):
    from fleetstate.operators.planning import acquire
    from fleetstate.sources import fixtures as X

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        i = F.col("id")
        claims = spark.range(0, 400_000, 1, 16).select(F.when(i % 10 > 0, "eng-7").otherwise(F.concat(F.lit("eng-"), i)).alias("id"), F.timestamp_seconds(i).alias("ts"),
                                                       F.concat(F.lit("m"), i % 3).alias("claimant"), i.alias("seq"), i.alias("tiebreak"))
        df = acquire(claims, X.registry(spark, SF001), Params())
        df.write.format("noop").mode("overwrite").save()
        rows = df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == 400_000
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_write_back_inserts_removes_and_refuses_duplicates(spark):
    import pytest

    from fleetstate.operators.registry import apply_changes

    reg = spark.createDataFrame([("a", "n1", "Running", None, 5), ("b", "n2", "Terminated", None, None)], "id string, name string, state_kind string, state_message string, next_update_time long")
    schema = "id string, name string, state_kind string, state_message string, next_update_time long, removed boolean"
    changes = [("a", "other", "WaitToTerminate", None, 9, False), ("b", None, "Removed", None, None, True), ("c", "n3", "WaitToStart", None, 1, None), ("d", None, "Removed", None, None, True)]
    got = sorted(map(tuple, apply_changes(reg, spark.createDataFrame(changes, schema)).collect()))
    assert got == [("a", "n1", "WaitToTerminate", None, 9), ("c", "n3", "WaitToStart", None, 1)]
    with pytest.raises(Exception, match="more than one change for id a"):
        apply_changes(reg, spark.createDataFrame([changes[0], changes[0]], schema)).collect()

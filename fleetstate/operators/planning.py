"""Command planning and monitor rounds: stop/restart/delete, acquire/release, timeouts, sync."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstate.functions.columns import state_class
from fleetstate.model import COMMAND_VERBS, TRIGGER, WAITING, Params
from fleetstate.operators.edges import (apply_edge, default_edges, join_edges, new_message, new_next_time,
                                        resolve_edges, round_edges)
from fleetstate.operators.observe import latest_observation, normalize_phase
from fleetstate.operators.reduce import reduced
from fleetstate.operators.registry import due_records, refusal_text


def plan_command(commands: DataFrame, registry: DataFrame, signal: str, p: Params,
                 edges: DataFrame | None = None) -> DataFrame:
    """Plan one kind of command (STOP / RESTART / DELETE) against the current snapshot."""
    if signal not in COMMAND_VERBS:
        raise ValueError(f"not a command: {signal}")
    return plan_commands(commands.withColumn("signal", F.lit(signal)), registry, p, edges)


def plan_commands(commands: DataFrame, registry: DataFrame, p: Params, edges: DataFrame | None = None) -> DataFrame:
    """Plan commands (``id``, ``signal`` in STOP / RESTART / DELETE, plus any other columns).

    One join with the snapshot for all kinds. Each command is judged on the snapshot:
    Success with the new state, NotAllowed with the refusal text, or NotFound. A command that
    loses a race retries on the actual state, which is what folding the ordered commands does
    (``replay``); this operator plans each command against one snapshot.
    """
    spark = registry.sparkSession
    cur = registry.select("id", "state_kind", "state_message", F.lit(True).alias("_found"))
    j = join_edges(commands.join(cur, "id", "left"), resolve_edges(spark, edges))
    kind, msg, nxt = apply_edge(j, p)
    found = F.coalesce(F.col("_found"), F.lit(False))
    outcome = F.when(~found, "NotFound").when(kind.isNull(), "NotAllowed").otherwise("Success")
    verbs = F.create_map(*[F.lit(x) for kv in COMMAND_VERBS.items() for x in kv])
    return j.select(
        commands["*"],
        F.col("state_kind").alias("current_kind"),
        outcome.alias("outcome"),
        F.when(outcome == "Success", kind).alias("new_kind"),
        F.when(outcome == "Success", msg).alias("new_message"),
        F.when(outcome == "Success", nxt).alias("new_next_update_time"),
        ((outcome == "Success") & (kind == "Removed")).alias("removed"),
        F.when(outcome == "NotFound", F.concat(F.lit("Not found: Engine "), F.col("id"), F.lit(" not found")))
        .when(outcome == "NotAllowed", refusal_text("id", "state_kind", "state_message",
                                                    F.try_element_at(verbs, F.col("signal"))))
        .alias("error"),
    )


def acquire(claims: DataFrame, registry: DataFrame, p: Params, edges: DataFrame | None = None,
            order: list[str] | None = None) -> DataFrame:
    """Competing claims on due waiting records; the earliest claim per id wins.

    The winner is ``min(struct(ts, claimant, seq, tiebreak))`` per id - an aggregate with a
    map-side combine, so a hot id never lands whole in one task. Winners meet the registry first,
    one row per id on both sides, and the claims come last, in one join whose sides are both
    plainly shuffled: such a join Spark splits at a hot id. The winner moves the record to its
    trigger state; every other claim fails with the state the winner wrote.
    """
    spark = registry.sparkSession
    order = order or ["ts", "claimant", "seq", "tiebreak"]  # a total order of the claims of an id
    win = claims.groupBy("id").agg(F.min(F.struct(*order)).alias("_w"))
    # one registry pass: the current state, and for due waiting records the acquired state
    is_due = (F.col("next_update_time").isNotNull() & (F.col("next_update_time") < F.lit(p.now))
              & F.col("state_kind").isin(*WAITING))
    cur = registry.select("id", "state_kind", "state_message",
                          F.when(is_due, F.lit("ACQUIRE")).alias("signal"))
    cur = join_edges(cur, resolve_edges(spark, edges))
    kind, msg, nxt = apply_edge(cur, p)
    cur = cur.select("id", F.col("state_kind").alias("_cur_kind"), F.col("state_message").alias("_cur_msg"),
                     F.when(F.col("signal").isNotNull(), F.lit(True)).alias("_due"),
                     kind.alias("_to"), msg.alias("_to_msg"), nxt.alias("_to_next"))
    # a key of its own, so that the rows are shuffled for this join and not left as the aggregate had them
    known = win.join(cur, "id", "left").withColumn("_key", F.concat(F.lit("id:"), F.col("id"))).drop("id")
    j = claims.join(known, F.concat(F.lit("id:"), claims["id"]) == F.col("_key"), "left")  # a claim without an id is NotFound
    is_winner = F.struct(*[F.col(c) for c in order]) == F.col("_w")
    outcome = (F.when(F.col("_cur_kind").isNull(), "NotFound")
               .when(F.col("_due").isNull(), "Fail")
               .when(is_winner, "Success").otherwise("Fail"))
    return j.select(
        claims["*"], outcome.alias("outcome"),
        F.when(F.col("_due").isNotNull(), F.col("_to")).otherwise(F.col("_cur_kind")).alias("state_kind"),
        F.when(F.col("_due").isNotNull(), F.col("_to_msg")).otherwise(F.col("_cur_msg")).alias("state_message"),
        F.when(outcome == "Success", F.col("_to_next")).alias("next_update_time"),
    )


def release(registry: DataFrame, outcomes: DataFrame, p: Params, edges: DataFrame | None = None) -> DataFrame:
    """Release records in trigger states with the result of their action.

    ``outcomes``: id, err_msg (NULL = success). No outcome row means the action crashed before
    reporting: the record stays in its trigger state until the timeout retries it.
    """
    spark = registry.sparkSession
    trig = registry.where(F.col("state_kind").isin(*TRIGGER)).select("id", "state_kind", "state_message")
    o = outcomes.select("id", "err_msg", F.lit(True).alias("_done"))
    j = trig.join(o, "id", "left")
    sig = F.when(F.col("_done").isNull(), "CRASH").when(F.col("err_msg").isNull(), "RELEASE_OK").otherwise("RELEASE_ERR")
    j = join_edges(j.withColumn("signal", sig), resolve_edges(spark, edges))
    kind, msg, nxt = apply_edge(j, p, arg=F.col("err_msg"))
    crashed = F.col("signal") == "CRASH"
    return j.select(
        "id", F.col("state_kind").alias("from_kind"), "signal",
        F.when(crashed, F.col("state_kind")).otherwise(kind).alias("state_kind"),
        F.when(crashed, F.col("state_message")).otherwise(msg).alias("state_message"),
        F.when(crashed, F.lit(None).cast("bigint")).otherwise(nxt).alias("next_update_time"),
        (~crashed).alias("written"),
    )


def retry_timeouts(registry: DataFrame, p: Params, edges: DataFrame | None = None) -> DataFrame:
    """A due record in a trigger state has timed out: send it back to waiting."""
    spark = registry.sparkSession
    d = due_records(registry, p).where(F.col("state_kind").isin(*TRIGGER)).select("id", "state_kind", "state_message")
    j = join_edges(d.withColumn("signal", F.lit("TIMEOUT")), resolve_edges(spark, edges))
    kind, msg, nxt = apply_edge(j, p)
    return j.select("id", F.col("state_kind").alias("from_kind"), kind.alias("state_kind"),
                    msg.alias("state_message"), nxt.alias("next_update_time"))


def sync_round(registry: DataFrame, observations: DataFrame, outcomes: DataFrame, p: Params,
               edges: DataFrame | None = None, launch_check: bool = False,
               app_prefix: str | None = None, obs_order: list[str] | None = None,
               absent_phase: str = "NotExisted") -> DataFrame:
    """One full monitor round over every due record, in one job.

    Each due record gets an ``action`` - RELEASE_OK / RELEASE_ERR / CRASH (waiting: acquired and
    released in the round), TIMEOUT (trigger), PHASE_* (in progress, from its latest observation)
    - and one join to the round's edge table gives its new state. The registry is read once and
    filtered before any join; observations of records that aren't due and in progress are dropped
    where they are scanned (``reduce``), and the rest are reduced to one row per id map-side. Stable states
    are never due; a due stable record or an unknown phase is reported as ``illegal``.

    With ``launch_check`` a WaitToStart record is first checked as its launch would be (version
    allow-list, then reserved config keys); a refusal is its release error and no outcome is read.
    ``obs_order``: the observation columns that order them totally (newest = max), ts first.
    ``absent_phase``: what a record without any observation reads as. Where observations arrive by
    and by, that is "Unknown", and a pod that is gone says so by the phase "NotExisted".
    """
    spark = registry.sparkSession
    rules = round_edges(resolve_edges(spark, edges))
    if edges is None:
        rules = F.broadcast(rules)  # from 44 literal rows
    cols = ["id", "state_kind", "state_message", "next_update_time"]
    due = due_records(registry, p)
    if launch_check:
        from fleetstate.functions.launch import DEFAULT_APP_PREFIX, launch_plan
        plan = launch_plan(F.col("id"), F.col("version"), F.col("config"), app_prefix or DEFAULT_APP_PREFIX)
        due = due.select(*cols, F.when(F.col("state_kind") == "WaitToStart", plan["error"]).alias("_launch_err"))
    else:
        due = due.select(*cols, F.lit(None).cast("string").alias("_launch_err"))
    # only in-progress records read their observations; the others' are dropped below the aggregate
    watched = due.where(state_class("state_kind") == "in_progress").select("id")
    observations = reduced(observations, watched)
    last = latest_observation(observations, obs_order).select("id", F.col("phase").alias("_raw"),
                                                               F.lit(True).alias("_pod"))
    res = outcomes.select("id", "err_msg", F.lit(True).alias("_done"))
    j = due.join(last, "id", "left").join(res, "id", "left")
    cls = state_class("state_kind")
    phase = normalize_phase(F.col("_raw"), F.coalesce(F.col("_pod"), F.lit(False)))
    if absent_phase != "NotExisted":
        phase = (F.when(F.col("_pod").isNull(), F.lit(absent_phase))
                 .when(F.col("_raw") == "NotExisted", F.lit("NotExisted")).otherwise(phase))
    err = F.coalesce(F.col("_launch_err"), F.col("err_msg"))
    action = (F.when(cls == "waiting",
                     F.when(F.col("_launch_err").isNotNull(), "RELEASE_ERR")
                     .when(F.col("_done").isNull(), "CRASH")
                     .when(F.col("err_msg").isNull(), "RELEASE_OK").otherwise("RELEASE_ERR"))
              .when(cls == "trigger", "TIMEOUT")
              .when(cls == "in_progress", F.concat(F.lit("PHASE_"), phase)))
    j = j.select("id", "state_kind", "state_message", err.alias("err_msg"), action.alias("action"))
    j = join_edges(j, rules, signal_col="action")
    kind = F.col("_e_to")
    return j.select(
        "id", F.col("state_kind").alias("from_kind"), "action",
        F.coalesce(kind, F.col("state_kind")).alias("state_kind"),
        F.when(kind.isNull(), F.col("state_message"))
        .otherwise(new_message(F.col("state_message"), F.col("_e_msg"), F.col("err_msg"), F.col("_e_const")))
        .alias("state_message"),
        new_next_time(F.col("_e_next"), p.now, p).alias("next_update_time"),
        F.when(kind.isNull(), "illegal").otherwise("ok").alias("status"),
    )


def illegal_transitions(log: DataFrame, edges: DataFrame | None = None, with_signal: bool = False) -> DataFrame:
    """Transitions of a log that no edge allows (left anti join to the rule table).

    ``log`` has from_kind, to_kind (and signal when ``with_signal``).
    """
    spark = log.sparkSession
    keys = ["from_kind", "signal", "to_kind"] if with_signal else ["from_kind", "to_kind"]
    e = (default_edges(spark) if edges is None else edges).select(*keys).distinct()
    return log.join(F.broadcast(e) if edges is None else e, keys, "left_anti")

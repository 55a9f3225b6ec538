"""Joining records to the transition table and applying an edge's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstate.model import ERROR_SEPARATOR, Params, edges_df

def default_edges(spark: SparkSession) -> DataFrame:
    return edges_df(spark)


def resolve_edges(spark: SparkSession, edges: DataFrame | None) -> DataFrame:
    """The built-in rules (44 literal rows, hinted for broadcast), or a caller's table (D12) as it is:
    its size isn't known here, so the planner chooses the join from its statistics."""
    return F.broadcast(default_edges(spark)) if edges is None else edges


def join_edges(df: DataFrame, edges: DataFrame, state_col: str = "state_kind",
               signal_col: str = "signal", how: str = "left") -> DataFrame:
    """Attach (to_kind, msg_rule, next_rule, const_message) for (state, signal); NULL when not allowed."""
    e = edges.select(
        F.col("from_kind").alias("_e_from"), F.col("signal").alias("_e_signal"),
        F.col("to_kind").alias("_e_to"), F.col("msg_rule").alias("_e_msg"),
        F.col("next_rule").alias("_e_next"), F.col("const_message").alias("_e_const"),
    )
    j = df.join(e, (F.col(state_col) == F.col("_e_from")) & (F.col(signal_col) == F.col("_e_signal")), how)
    return j.drop("_e_from", "_e_signal")


def new_message(old: Column, rule: Column, arg: Column, const: Column) -> Column:
    return (F.when(rule == "keep", old)
            .when(rule == "set", arg)
            .when(rule == "append", F.concat(old, F.lit(ERROR_SEPARATOR), arg))
            .when(rule == "const", const)
            .otherwise(F.lit(None).cast("string")))


def new_next_time(rule: Column, now: Column | int, p: Params) -> Column:
    now_c = now if isinstance(now, Column) else F.lit(now).cast("bigint")
    return (F.when(rule == "now", now_c)
            .when(rule == "interval", now_c + F.lit(p.interval))
            .when(rule == "timeout", now_c + F.lit(p.timeout))
            .otherwise(F.lit(None).cast("bigint")))


def apply_edge(j: DataFrame, p: Params, msg_col: str = "state_message", arg: Column | None = None,
               now: Column | int | None = None) -> tuple[Column, Column, Column]:
    """(new kind, new message, new next-update time) for rows joined by ``join_edges``."""
    arg = arg if arg is not None else F.lit(None).cast("string")
    now = p.now if now is None else now
    return (
        F.col("_e_to"),
        new_message(F.col(msg_col), F.col("_e_msg"), arg, F.col("_e_const")),
        new_next_time(F.col("_e_next"), now, p),
    )


def round_edges(edges: DataFrame) -> DataFrame:
    """Edges of one monitor round, keyed by (from_kind, action).

    A waiting record is acquired and released in the same round, so its edge is
    ACQUIRE followed by RELEASE_OK / RELEASE_ERR; when the action never reports
    (CRASH) only the acquire is recorded. Trigger and in-progress records take a
    single TIMEOUT or PHASE_* edge. Built from the rule table itself (a tiny join).
    """
    a = edges.where(F.col("signal") == "ACQUIRE").select(
        F.col("from_kind"), F.col("to_kind").alias("mid"), F.col("msg_rule").alias("a_msg"),
        F.col("next_rule").alias("a_next"))
    r = edges.where(F.col("signal").isin("RELEASE_OK", "RELEASE_ERR")).select(
        F.col("from_kind").alias("mid"), F.col("signal").alias("r_sig"), F.col("to_kind"),
        F.col("msg_rule").alias("r_msg"), F.col("next_rule"), F.col("const_message"))
    composed = a.join(r, "mid").select(
        "from_kind", F.col("r_sig").alias("signal"), "to_kind",
        # the acquire keeps or clears; the release decides unless it keeps
        F.when(F.col("r_msg") == "keep", F.col("a_msg")).otherwise(F.col("r_msg")).alias("msg_rule"),
        "next_rule", "const_message")
    crash = a.select("from_kind", F.lit("CRASH").alias("signal"), F.col("mid").alias("to_kind"),
                     F.col("a_msg").alias("msg_rule"), F.col("a_next").alias("next_rule"),
                     F.lit(None).cast("string").alias("const_message"))
    single = edges.where((F.col("signal") == "TIMEOUT") | F.col("signal").startswith("PHASE_")).select(
        "from_kind", "signal", "to_kind", "msg_rule", "next_rule", "const_message")
    return composed.unionByName(crash).unionByName(single)

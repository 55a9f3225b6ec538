"""Observations: latest phase per id, phase normalization, reconciliation of in-progress records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstate.model import IN_PROGRESS, PHASES, Params
from fleetstate.operators.edges import apply_edge, join_edges, resolve_edges
from fleetstate.operators.reduce import reduced

OBS_ORDER = ["ts", "l_linenumber", "l_partkey", "l_suppkey"]


def latest_observation(observations: DataFrame, order: list[str] | None = None) -> DataFrame:
    """the newest observation per id.

    ``max(struct(order..., phase))`` is a plain aggregate: each map task keeps one row per id
    (partial aggregation), so a hot id costs one row per task in the shuffle, not all its rows.
    ``order`` must make the newest row unique (a full tie-break).
    """
    order = order or OBS_ORDER
    latest = F.max(F.struct(*[F.col(c) for c in order], F.col("phase"))).alias("_last")
    return observations.groupBy("id").agg(latest, F.count(F.lit(1)).alias("n_obs")).select(
        "id", F.col("_last.ts").alias("ts"), F.col("_last.phase").alias("phase"), "n_obs")


def normalize_phase(raw_phase, has_pod):
    """No observation -> NotExisted, NULL phase -> Unknown, unknown text -> NULL (illegal)."""
    return (F.when(~has_pod, F.lit("NotExisted"))
            .when(raw_phase.isNull(), F.lit("Unknown"))
            .when(raw_phase.isin(*[p for p in PHASES if p != "NotExisted"]), raw_phase))


def phase_normalize(records: DataFrame, observations: DataFrame, order: list[str] | None = None) -> DataFrame:
    """B12 over a set of records: one row per record with its normalized phase and an illegal flag."""
    last = latest_observation(observations, order).select("id", F.col("phase").alias("_raw"), F.lit(True).alias("_pod"))
    j = records.join(last, "id", "left")
    has_pod = F.coalesce(F.col("_pod"), F.lit(False))
    ph = normalize_phase(F.col("_raw"), has_pod)
    return j.select(records["*"], F.col("_raw").alias("raw_phase"), ph.alias("phase"),
                    ph.isNull().alias("illegal"))


def reconcile(registry: DataFrame, observations: DataFrame, p: Params, edges: DataFrame | None = None,
              only_due: bool = False, obs_order: list[str] | None = None) -> DataFrame:
    """Move every in-progress record by its latest observation (observation edges).

    "Unchanged" outcomes still write: the next update time moves (heartbeat). Observations of other
    records are dropped where they are scanned, below the aggregate.
    """
    spark = registry.sparkSession
    recs = registry.where(F.col("state_kind").isin(*IN_PROGRESS))
    if only_due:
        recs = recs.where(F.col("next_update_time").isNotNull() & (F.col("next_update_time") < p.now))
    recs = recs.select("id", "state_kind", "state_message")
    norm = phase_normalize(recs, reduced(observations, recs.select("id")), obs_order)
    j = join_edges(norm.withColumn("signal", F.concat(F.lit("PHASE_"), F.col("phase"))),
                   resolve_edges(spark, edges))
    kind, msg, nxt = apply_edge(j, p)
    return j.select(
        "id", F.col("state_kind").alias("from_kind"), "phase",
        F.coalesce(kind, F.col("state_kind")).alias("state_kind"),
        F.when(kind.isNull(), F.col("state_message")).otherwise(msg).alias("state_message"),
        nxt.alias("next_update_time"),
        F.when(kind.isNull(), "illegal").when(kind == F.col("state_kind"), "unchanged")
        .otherwise("changed").alias("status"),
    )

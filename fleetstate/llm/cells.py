"""Connected components on Spark: the smallest id that links reach, for each linked id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstate.llm import common as C


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for the ids of ``edges`` (a, b: longs). Rows stay on the cluster throughout.

    Large-star and small-star steps take turns: each links an id's neighbours to the least id
    around it, so that at the end every id hangs on the least of its component. A step reads one
    row per link, and a hot id's neighbours are reduced by a partial minimum, never gathered.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = C.cut(both)
    sig = _signature(state)
    for _ in range(rounds if sig[0] else 0):
        pairs = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = pairs.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        state = C.cut(small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct())
        before, sig = sig, _signature(state)
        if before == sig:
            break
    else:
        if sig[0]:
            raise RuntimeError("components haven't settled")
    return state.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").unionByName(
        state.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))

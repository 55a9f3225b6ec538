"""Layered registry snapshots (A4): a base and small keyed change sets; the newest wins on read.

``root/v=N`` is a whole registry (a base), ``root/changes/v=N`` what version N changed since N-1: one
row per changed id, with its state, whether it was created (then with all its columns) or removed. A
version is read from the latest base up to it and the change sets after that. So a round writes in
proportion to what it changed, and every k-th one compacts: it writes a base. A directory is whole
once its _SUCCESS file is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstate.model import REGISTRY_SCHEMA
from fleetstate.operators.registry import apply_changes, read_registry, snapshot_complete, write_registry

STATE = ["state_kind", "state_message", "next_update_time"]
RECORD = [f.name for f in REGISTRY_SCHEMA.fields if f.name not in ("id", *STATE)]
BROADCAST_ROWS = 500_000  # changed ids and states since the base, some 100 bytes each


def _schema() -> str:
    types = {f.name: f.dataType.simpleString() for f in REGISTRY_SCHEMA.fields}
    return ", ".join(f"{c} {types[c]}" for c in ["id", *STATE, *RECORD]) + ", created boolean, removed boolean"


def write_changes(changes: DataFrame, root: str, version: int) -> None:
    """``changes``: id, state_kind, state_message, next_update_time, and optionally removed, created
    and other registry columns (for created records)."""
    types = {f.name: f.dataType for f in REGISTRY_SCHEMA.fields}
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in changes.columns else F.lit(False).alias(c) for c in ("created", "removed")]
    record = [F.col(c) if c in changes.columns else F.lit(None).cast(types[c]).alias(c) for c in RECORD]
    changes.select("id", *STATE, *record, *flags).write.mode("overwrite").parquet(f"{root}/changes/v={version}")


def version_complete(spark: SparkSession, root: str, version: int) -> bool:
    return snapshot_complete(spark, f"{root}/v={version}") or snapshot_complete(spark, f"{root}/changes/v={version}")


def base_of(spark: SparkSession, root: str, version: int) -> int:
    """The latest base up to ``version``; raises if a version after it is missing."""
    for v in range(version, -1, -1):
        if snapshot_complete(spark, f"{root}/v={v}"):
            return v
        if not snapshot_complete(spark, f"{root}/changes/v={v}"):
            break
    raise RuntimeError(f"{root}: version {version} isn't complete")


def changes_since(spark: SparkSession, root: str, base: int, version: int) -> DataFrame:
    """One row per id changed after ``base`` up to ``version``: its newest state, whether it was
    created since, and then the record it was created with."""
    every = None
    for v in range(base + 1, version + 1):
        one = spark.read.schema(_schema()).parquet(f"{root}/changes/v={v}").withColumn("v", F.lit(v))
        every = one if every is None else every.unionByName(one)
    made = F.max_by(F.when(F.col("created"), F.struct(*RECORD)), F.when(F.col("created"), F.col("v")))
    return every.groupBy("id").agg(F.max_by(F.struct(*STATE, "removed"), "v").alias("s"), made.alias("r"), F.max("created").alias("created")).select(
        "id", *[F.col(f"s.{c}").alias(c) for c in STATE], *[F.col(f"r.{c}").alias(c) for c in RECORD], "created", F.col("s.removed").alias("removed"))


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The registry at ``version``.

    The base isn't shuffled while the changes since it are within BROADCAST_ROWS (their files are
    counted, which reads no rows); beyond that they meet in a shuffle join."""
    base = base_of(spark, root, version)
    registry = read_registry(spark, f"{root}/v={base}")
    if base == version:
        return registry
    changes = changes_since(spark, root, base, version)
    rows = sum(spark.read.schema(_schema()).parquet(f"{root}/changes/v={v}").count() for v in range(base + 1, version + 1))
    if rows > BROADCAST_ROWS:
        return apply_changes(registry, changes.drop("created"))
    new = F.broadcast(changes.select("id", F.struct(*STATE, "removed").alias("_c")))
    old = registry.join(new, "id", "left").where(~F.coalesce(F.col("_c.removed"), F.lit(False)))
    hit = F.col("_c").isNotNull()
    old = old.select(*[F.when(hit, F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c) if c in STATE else F.col(c) for c in registry.columns])
    made = changes.where("created and not removed")
    known = registry.select("id").join(F.broadcast(made.select("id")), "id", "left_semi")  # created ids that the base has after all
    return old.unionByName(made.join(F.broadcast(known), "id", "left_anti").select(*registry.columns))


def write_version(registry: DataFrame, changes: DataFrame, root: str, version: int, compact_every: int) -> None:
    """Version ``version`` from the one before it (``registry``) and what changes: every
    ``compact_every``-th is a base, any other a change set."""
    if version % compact_every == 0:
        write_registry(apply_changes(registry, changes), f"{root}/v={version}")
    else:
        write_changes(changes, root, version)

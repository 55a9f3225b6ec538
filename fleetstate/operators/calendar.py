"""Calendar layout of a registry snapshot (B3, D10): a timing wheel of partitions by due time.

``due_slot`` is the record's next update time in units of ``slot_seconds``: one slot for everything
overdue when the snapshot was written, ``slots`` slots ahead, one for later times, and none (NULL) for
records that are never due. Both columns are partition columns, so the due filter reads the
directories of the slots that have begun and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstate.model import REGISTRY_SCHEMA, Params

SLOT_SECONDS, SLOTS = 60, 120


def write_calendar(registry: DataFrame, path: str, p: Params, slot_seconds: int = SLOT_SECONDS, slots: int = SLOTS, mode: str = "overwrite") -> None:
    """Write a snapshot by due slot, as seen at ``p.now``.

    The rebalance hint lets the runtime split a slot that holds much (the overdue one, or the records
    that are never due) over several files, and put small ones together."""
    now = p.now // slot_seconds
    slot = F.least(F.greatest(F.floor(F.col("next_update_time") / slot_seconds), F.lit(now - 1)), F.lit(now + slots)).cast("bigint")
    slot = F.when(F.col("next_update_time").isNotNull(), slot)
    df = registry.select(*[f.name for f in REGISTRY_SCHEMA.fields], F.lit(slot_seconds).cast("bigint").alias("slot_seconds"), slot.alias("due_slot"))
    df.hint("rebalance", F.col("due_slot")).write.mode(mode).partitionBy("slot_seconds", "due_slot").parquet(path)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot with slot_seconds and due_slot; ``registry.due_records`` uses them."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in REGISTRY_SCHEMA.fields)
    return spark.read.schema(f"{schema}, slot_seconds bigint, due_slot bigint").parquet(path)

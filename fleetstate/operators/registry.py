"""Registry operators: scan, lookups, due filter, compare-and-set, delete, write-back, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetstate.functions.columns import debug_text
from fleetstate.model import REGISTRY_SCHEMA, Params
from fleetstate.session import materialize


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A1: a registry snapshot with an explicit schema (never inferred)."""
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path)


def write_registry(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a snapshot directory (a new path per round). It is whole once its _SUCCESS file is there,
    which is written last: see ``snapshot_complete``."""
    df.select(*[f.name for f in REGISTRY_SCHEMA.fields]).write.mode(mode).parquet(path)


def snapshot_complete(spark: SparkSession, path: str) -> bool:
    """Whether the write of a snapshot directory ended: its _SUCCESS file exists."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def point_lookup(registry: DataFrame, engine_id: str) -> DataFrame:
    """B1: one record by id; the equality reaches the parquet scan as a pushed filter."""
    return registry.where(F.col("id") == F.lit(engine_id))


def bulk_lookup(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """B2: look up many ids at once; absent ids come back with status NotFound."""
    r = registry.select("id", "state_kind", "state_message", F.lit(True).alias("_found"))
    return ids.join(r, "id", "left").select(
        ids["*"],
        F.when(F.col("_found"), "Found").otherwise("NotFound").alias("status"),
        "state_kind", "state_message",
        F.when(F.col("_found").isNull(),
               F.concat(F.lit("Not found: Engine "), F.col("id"), F.lit(" not found"))).alias("error"),
    )


def due_filter(next_update_time: str = "next_update_time", now: int | None = None):
    return F.col(next_update_time).isNotNull() & (F.col(next_update_time) < F.lit(now))


def due_records(registry: DataFrame, p: Params) -> DataFrame:
    """Records whose next update time is set and strictly before now (whole seconds). Of a
    snapshot in calendar layout only the slots that have begun are read: the others, the records that
    are never due among them, are pruned as partitions."""
    if {"due_slot", "slot_seconds"} <= set(registry.columns):
        registry = registry.where(F.col("due_slot").isNotNull() & (F.col("due_slot") * F.col("slot_seconds") < F.lit(p.now)))
    return registry.where(due_filter(now=p.now))


def due_counts(registry: DataFrame, p: Params) -> DataFrame:
    """Due records per state (partial aggregation before the shuffle)."""
    return due_records(registry, p).groupBy("state_kind").agg(F.count(F.lit(1)).alias("n_due"))


def cas_update(updates: DataFrame, registry: DataFrame) -> DataFrame:
    """Compare-and-set. The whole state (kind and message) must equal the expected one.

    ``updates``: id, before_kind, before_message, after_kind, after_message, next_update_time.
    Returns one row per update with outcome Success / Fail (with the current state) / NotFound,
    and the state the record holds afterwards. Several updates of one id in a batch must be
    ordered and folded instead (see ``fleetstate.operators.replay``).
    """
    cur = registry.select("id", F.col("state_kind").alias("current_kind"),
                          F.col("state_message").alias("current_message"),
                          F.col("next_update_time").alias("current_next"))
    j = updates.join(cur, "id", "left")
    match = ((F.col("before_kind") == F.col("current_kind"))
             & F.col("before_message").eqNullSafe(F.col("current_message")))
    outcome = (F.when(F.col("current_kind").isNull(), "NotFound")
               .when(match, "Success").otherwise("Fail"))
    return j.select(
        "id", "before_kind", "before_message", "after_kind", "after_message",
        outcome.alias("outcome"),
        "current_kind", "current_message",
        F.when(outcome == "Success", F.col("after_kind"))
        .when(outcome == "Fail", F.col("current_kind")).alias("state_kind"),
        F.when(outcome == "Success", F.col("after_message"))
        .when(outcome == "Fail", F.col("current_message")).alias("state_message"),
        F.when(outcome == "Success", F.col("next_update_time"))
        .when(outcome == "Fail", F.col("current_next")).alias("next_update_time"),
    )


def conditional_delete(deletes: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete when the expected state matches. Returns (outcomes, registry without the deleted ids)."""
    out = cas_update(
        deletes.select("id", "before_kind", "before_message",
                       F.lit(None).cast("string").alias("after_kind"),
                       F.lit(None).cast("string").alias("after_message"),
                       F.lit(None).cast("bigint").alias("next_update_time")),
        registry,
    ).select("id", "before_kind", "before_message", "outcome", "current_kind", "current_message")
    gone = out.where(F.col("outcome") == "Success").select("id")
    return out, registry.join(gone, "id", "left_anti")


def apply_changes(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """A4: keyed write-back: insert, update and delete in one full outer join.

    ``changes``: id, state_kind, state_message, next_update_time, removed, and for new records any
    other registry column. A change of an id that the registry has sets its state (or removes it);
    one of a new id creates the record, unless it is a removal. With a column ``created`` the two are
    told apart: a row that says so only makes a new record and leaves one that exists as it is (a
    request that came again must not reset its engine), and a row that doesn't only changes one that
    exists. Two changes of one id are an error (fold them first), raised by the plan itself. Produces
    the next snapshot; write it to a new directory, or MERGE it where the table format supports that.
    """
    extra = [c for c in changes.columns if c in registry.columns and c not in ("id", "state_kind", "state_message", "next_update_time")]
    flagged = "created" in changes.columns
    created = F.coalesce(F.col("created"), F.lit(False)) if flagged else F.lit(False)
    first = F.first(F.struct("state_kind", "state_message", "next_update_time",
                             F.coalesce(F.col("removed"), F.lit(False)).alias("removed"), created.alias("created"), *extra)).alias("_c")
    many = F.concat(F.lit("more than one change for id "), F.coalesce(F.col("id"), F.lit("NULL")))
    c = changes.groupBy("id").agg(first, F.count(F.lit(1)).alias("_n")).select(
        F.col("id").alias("_id"), F.when(F.col("_n") > 1, F.raise_error(many).cast("boolean")).otherwise(F.lit(True)).alias("_hit"), "_c")
    j = registry.withColumn("_old", F.lit(True)).join(c, F.col("id") == F.col("_id"), "full")
    hit, old = F.coalesce(F.col("_hit"), F.lit(False)), F.coalesce(F.col("_old"), F.lit(False))
    kept = j.where(~(hit & F.coalesce(F.col("_c.removed"), F.lit(False))))
    if flagged:
        kept = kept.where(old | F.col("_c.created"))
        hit = hit & ~(old & F.col("_c.created"))
    cols = []
    for f in registry.columns:
        if f == "id":
            cols.append(F.coalesce("id", "_id").alias("id"))
        elif f in ("state_kind", "state_message", "next_update_time"):
            cols.append(F.when(hit, F.col(f"_c.{f}")).otherwise(F.col(f)).alias(f))
        elif f in extra:
            cols.append(F.when(old, F.col(f)).otherwise(F.col(f"_c.{f}")).alias(f))
        else:
            cols.append(F.col(f))
    return kept.select(*cols)


def creates(records: DataFrame, registry: DataFrame) -> DataFrame:
    """A3 against a registry: each new record's id with its outcome. Created, Exists (a request that
    was processed before; its record stays as it is) or Duplicate (comes again within ``records``, by
    id; one of them counts)."""
    known = registry.select("id", F.lit(True).alias("_known"))
    return records.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).join(known, "id", "left").select(
        "id", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i"), "_known").select(
        "id", F.when(F.col("_known"), "Exists").when(F.col("_i") > 1, "Duplicate").otherwise("Created").alias("outcome"))


def list_ids(registry: DataFrame, partitions: int | None = None) -> DataFrame:
    """All ids in byte order with their position, without a single-task window.

    Range-partition by id (sampled boundaries), number rows inside each partition, and
    add the row count of all earlier partitions (a table with one row per partition).
    """
    spark = registry.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # materialized once: the partition ids are read by two branches and must agree
    ranged = materialize(registry.select("id").repartitionByRange(n, "id")
                         .withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy("id")))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: bounded by the partition count, never by the data
    offsets = counts.select(
        "_part",
        (F.sum("_cnt").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    return (local.join(F.broadcast(offsets), "_part")
            .select("id", (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_rn")).cast("bigint").alias("pos")))


def refusal_text(id_col, kind_col, msg_col, verb):
    """'Not allowed: Engine {id} is in {state:?} state, cannot be {verb}'."""
    verb_c = F.lit(verb) if isinstance(verb, str) else verb
    return F.concat(F.lit("Not allowed: Engine "), F.col(id_col), F.lit(" is in "),
                    debug_text(kind_col, msg_col), F.lit(" state, cannot be "), verb_c)

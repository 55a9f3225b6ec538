"""Session helpers: local sessions for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on: a pinned UTC clock (epoch seconds and
# formatted times must not depend on the host), AQE for runtime re-planning
# (partition coalescing, skew-join splitting, broadcast of sides proven small
# at runtime).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "fleetstate") -> SparkSession:
    """A local session for tests and the benchmark. Clusters bring their own session."""
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.driver.memory", os.environ.get("FLEETSTATE_DRIVER_MEMORY", "16g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> SparkSession:
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is;
    a machine-local folder is only chosen for local sessions (tests).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        sc = None
    current = (sc.getCheckpointDir() if sc else None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    master = sc.master if sc else spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):  # local-cluster is a cluster
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="fleetstate-ckpt-", dir="/tmp")
    if sc:
        sc.setCheckpointDir(path)
        where = sc._jvm.org.apache.hadoop.fs.Path(path)  # the scratch folder goes with the session
        where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df):
    """Cut lineage with a reliable checkpoint in the session's checkpoint folder.

    Used where one nondeterministic assignment (a range partition id) is read by more than
    one branch of a plan: every branch must see the same assignment, and a lost executor must
    not re-derive a different one.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the files under ``paths`` (the file system's own summary; nothing is read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return int(total)


def size_for_input(spark: SparkSession, paths: list[str], target_bytes: int = 128 << 20,
                   min_partitions: int | None = None) -> int:
    """Size shuffles for the data at hand: about ``target_bytes`` of input per shuffle partition
    (a start for AQE, which coalesces small ones and splits skewed ones at runtime).

    At 100 TB and 128 MB this gives ~800k partitions; scans use the same split size. Returns the
    partition count it set.
    """
    floor = min_partitions or spark.sparkContext.defaultParallelism
    n = max(floor, -(-input_bytes(spark, paths) // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    return n

"""Launch configuration of a record: derived names (C1), preset map (C2), reserved keys (C3),
argument list (C4) and the version allow-list (C5), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: launch settings ---------------------------------------------
SUPPORTED_VERSIONS = ["3.5.3", "3.5.4"]
MASTER_URL = "k8s://https://kubernetes:443"
DEPLOY_MODE = "client"
IMAGE_PREFIX = "apache/spark:"
CONNECT_PACKAGE_PREFIX = "org.apache.spark:spark-connect_2.12:"
DRIVER_JAVA_OPTIONS = "-Divy.cache.dir=/tmp -Divy.home=/tmp"
DRIVER_SUFFIX = "-driver"
# Preset keys a user may not set, in key (byte) order.
RESERVED_KEYS = [
    "spark.app.id",
    "spark.driver.extraJavaOptions",
    "spark.driver.host",
    "spark.kubernetes.container.image",
    "spark.kubernetes.driver.pod.name",
    "spark.kubernetes.executor.podNamePrefix",
]
# --- end of fixed values -----------------------------------------------------------

DEFAULT_APP_PREFIX = "fleet-spark-"
assert RESERVED_KEYS == sorted(RESERVED_KEYS)


def app_id(id_col: Column, prefix: str = DEFAULT_APP_PREFIX) -> Column:
    return F.concat(F.lit(prefix), id_col)


def derived_names(id_col: Column, version: Column, prefix: str = DEFAULT_APP_PREFIX) -> dict[str, Column]:
    """Application id, driver pod name, service name, image and connect package."""
    a = app_id(id_col, prefix)
    return {
        "app_id": a,
        "driver_name": F.concat(a, F.lit(DRIVER_SUFFIX)),
        "service_name": a,
        "image": F.concat(F.lit(IMAGE_PREFIX), version),
        "package": F.concat(F.lit(CONNECT_PACKAGE_PREFIX), version),
    }


def preset_values(id_col: Column, version: Column, prefix: str = DEFAULT_APP_PREFIX) -> list[Column]:
    """Values of the preset keys, aligned with RESERVED_KEYS."""
    n = derived_names(id_col, version, prefix)
    return [n["app_id"], F.lit(DRIVER_JAVA_OPTIONS), n["service_name"], n["image"], n["driver_name"], n["app_id"]]


def reserved_key(config: Column) -> Column:
    """The first reserved key (in key order) the user config sets, or NULL."""
    return F.array_min(F.array_intersect(F.array(*[F.lit(k) for k in RESERVED_KEYS]), F.map_keys(config)))


def version_supported(version: Column) -> Column:
    """Only listed versions can be launched (checked before the reserved keys)."""
    return F.coalesce(version.isin(*SUPPORTED_VERSIONS), F.lit(False))


def _conf_pairs(entries: Column) -> Column:
    return F.flatten(F.transform(entries, lambda e: F.array(F.lit("--conf"), F.concat(e["key"], F.lit("="), e["value"]))))


def launch_args(id_col: Column, version: Column, config: Column, prefix: str = DEFAULT_APP_PREFIX) -> Column:
    """C4: six fixed arguments, then ``--conf k=v`` for the preset keys, then for the user keys in key order.

    The two maps are rendered one after the other, never merged (a reserved key is refused first).
    """
    fixed = F.array(F.lit("--master"), F.lit(MASTER_URL), F.lit("--deploy-mode"), F.lit(DEPLOY_MODE),
                    F.lit("--packages"), derived_names(id_col, version, prefix)["package"])
    preset = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"))
                        for k, v in zip(RESERVED_KEYS, preset_values(id_col, version, prefix))])
    user = F.array_sort(F.map_entries(F.coalesce(config, F.create_map().cast("map<string,string>"))))
    return F.concat(fixed, _conf_pairs(preset), _conf_pairs(user))


def _verdict(version: Column, rk: Column) -> tuple[Column, Column]:
    """(status, error) of a launch, from its version and the reserved key that its config sets."""
    ok_v = version_supported(version)
    versions = "[" + ", ".join(f'"{v}"' for v in SUPPORTED_VERSIONS) + "]"
    status = F.when(~ok_v, "bad_version").when(rk.isNotNull(), "reserved_key").otherwise("ok")
    error = (F.when(~ok_v, F.concat(F.lit("Not allowed: Spark version "), F.coalesce(version, F.lit("")),
                                    F.lit(f" is not supported. Supported versions: {versions}")))
             .when(rk.isNotNull(), F.concat(F.lit("Not allowed: The config "), rk,
                                            F.lit(" is not allowed as it is reserved."))))
    return status, error


def launch_plan(id_col: Column, version: Column, config: Column, prefix: str = DEFAULT_APP_PREFIX) -> Column:
    """struct(status, error, args): the version check, then the reserved-key check, then the arguments."""
    rk = reserved_key(F.coalesce(config, F.create_map().cast("map<string,string>")))
    status, error = _verdict(version, rk)
    return F.struct(status.alias("status"), error.alias("error"),
                    F.when(status == "ok", launch_args(id_col, version, config, prefix)).alias("args"))


def with_launch_plan(records, prefix: str = DEFAULT_APP_PREFIX):
    """``records`` (id, version, config, ...) with status, error and args of their launch. The
    reserved key is looked up once a record, and arguments are made only where they are used."""
    key = "_reserved"
    found = records.withColumn(key, reserved_key(F.coalesce(F.col("config"), F.create_map().cast("map<string,string>"))))
    status, error = _verdict(F.col("version"), F.col(key))
    out = found.withColumn("status", status).withColumn("error", error)
    return out.withColumn("args", F.when(F.col("status") == "ok", launch_args(F.col("id"), F.col("version"), F.col("config"), prefix))).drop(key)

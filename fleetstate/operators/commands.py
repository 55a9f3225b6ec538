"""Request log to commands (A6) and command responses with status codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstate.functions.columns import ERROR_KINDS, error_display, error_status
from fleetstate.model import Params, literal_rows
from fleetstate.operators.planning import plan_commands

# --- fixed values: the service's routes (method, template, operation) -------
ROUTES = [
    ("POST", "/engine", "create"),
    ("GET", "/engine", "list"),
    ("GET", "/engine/{id}", "get"),
    ("DELETE", "/engine/{id}", "delete"),
    ("POST", "/engine/{id}/stop", "stop"),
    ("POST", "/engine/{id}/restart", "restart"),
]
# --- end of fixed values -----------------------------------------------------

ROUTE_SCHEMA = T.StructType([
    T.StructField("method", T.StringType(), False),
    T.StructField("template", T.StringType(), False),
    T.StructField("operation", T.StringType(), False),
])


def routes_df(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, ROUTES, ROUTE_SCHEMA)


def error_kinds_df(spark: SparkSession) -> DataFrame:
    """The 11-row error-kind dimension: kind, display text, HTTP status."""
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("display", T.StringType()), T.StructField("http_status", T.IntegerType())])
    return literal_rows(spark, ERROR_KINDS, schema)


def route_requests(log: DataFrame) -> DataFrame:
    """(method, path) -> operation and id via a broadcast join to the 6-row route table.

    A path matching no template is NotFound (404); a known template with another method is
    MethodNotAllowed (405). A query string doesn't count, and the id is percent-decoded (an id
    that isn't valid percent-encoding stays as it is).
    """
    # the path is split once, and its segments are compared
    split = log.withColumn("_seg", F.split(F.substring_index(F.substring_index("path", "?", 1), "#", 1), "/"))
    seg = lambda i: F.get("_seg", F.lit(i))
    under = (seg(0) == "") & (seg(1) == "engine")
    n = F.size("_seg")
    has_id = under & (seg(2) != "")
    template = (F.when(under & (n == 2), "/engine")
                .when(has_id & (n == 3), "/engine/{id}")
                .when(has_id & (n == 4) & (seg(3) == "stop"), "/engine/{id}/stop")
                .when(has_id & (n == 4) & (seg(3) == "restart"), "/engine/{id}/restart"))
    # url_decode reads forms, where a plus is a space; in a path it is a plus
    decoded = F.when(seg(2).contains("%"), F.coalesce(F.try_url_decode(F.replace(seg(2), F.lit("+"), F.lit("%2B"))), seg(2))).otherwise(seg(2))
    j = split.withColumn("template", template).join(F.broadcast(routes_df(log.sparkSession)), ["method", "template"], "left")
    return j.select(
        log["*"], "template", F.when(F.col("template").contains("{id}"), decoded).alias("id"), "operation",
        F.when(F.col("operation").isNotNull(), "routed")
        .when(F.col("template").isNotNull(), "MethodNotAllowed").otherwise("NotFound").alias("route_status"),
    )


def command_responses(routed: DataFrame, registry: DataFrame, p: Params) -> DataFrame:
    """Answer every routed get/stop/restart/delete against the snapshot, with status and text.

    All requests meet the snapshot in one join (``plan_commands``; a GET has no edge and only
    needs the lookup). The error kind maps to its HTTP status and display text through the
    fixed error-kind table: 'Not allowed: Engine ... cannot be stopped', 'Not found: ...'.
    """
    sig = F.try_element_at(F.create_map(*[F.lit(x) for x in
                                      ["stop", "STOP", "restart", "RESTART", "delete", "DELETE", "get", "GET"]]),
                       F.col("operation"))
    cmds = routed.where(F.col("operation").isin("get", "stop", "restart", "delete")).select(
        "event_id", "id", "operation", sig.alias("signal"))
    r = plan_commands(cmds, registry, p)
    kind = (F.when(F.col("outcome") == "NotFound", "NotFound")
            .when(F.col("signal") == "GET", "Ok")
            .when(F.col("outcome") == "Success", "Ok").otherwise(F.col("outcome")))
    r = r.withColumn("kind", kind)
    return r.select(
        "event_id", "id", "operation", "kind",
        F.when(F.col("kind") == "Ok", F.lit(200)).otherwise(error_status("kind")).alias("http_status"),
        F.when(F.col("kind") == "Ok", F.lit(None).cast("string")).otherwise(F.col("error")).alias("message"),
        F.when(F.col("kind") == "Ok", F.lit(None).cast("string")).otherwise(error_display("kind")).alias("kind_display"),
        F.when(F.col("signal") == "GET", F.col("current_kind")).otherwise(F.col("new_kind")).alias("state_kind"),
    )

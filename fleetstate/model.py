"""Lifecycle model: states, classes, signals and the transition table.

The transition table (``EDGES``) is the single source of truth. Everything
else - the broadcast ``edges`` DataFrame, the dense lookup arrays used by the
ordered fold, the state-class dimension - is derived from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values (must equal the managed-service lifecycle we model) -------
# The twelve lifecycle states, in declaration order.
STATES = [
    "WaitToStart", "TriggerStart", "StartInProgress", "Running",
    "WaitToTerminate", "TriggerTermination", "TerminateInProgress", "Terminated",
    "ErrorWaitToClean", "ErrorTriggerClean", "ErrorCleanInProgress", "ErrorClean",
]
# State classes and flows.
WAITING = ["WaitToStart", "WaitToTerminate", "ErrorWaitToClean"]
TRIGGER = ["TriggerStart", "TriggerTermination", "ErrorTriggerClean"]
IN_PROGRESS = ["StartInProgress", "Running", "TerminateInProgress", "ErrorCleanInProgress"]
STABLE = ["Terminated", "ErrorClean"]
FLOW_START = ["WaitToStart", "TriggerStart", "StartInProgress", "Running"]
FLOW_TERMINATE = ["WaitToTerminate", "TriggerTermination", "TerminateInProgress", "Terminated"]
FLOW_ERROR = ["ErrorWaitToClean", "ErrorTriggerClean", "ErrorCleanInProgress", "ErrorClean"]
# Pod phases an observation may carry; a missing pod reads as NotExisted.
PHASES = ["NotExisted", "Pending", "Running", "Succeeded", "Failed", "Unknown"]
# Messages written by observation edges.
MSG_FAILS_TO_START = "Engine fails to start."
MSG_RESTARTS_UNEXPECTED = "Engine restarts unexpected."
MSG_TERMINATES_DURING_RUNNING = "Engine terminates during running."
# Separator used when a clean-up error is appended to an existing error.
ERROR_SEPARATOR = "\n\n"
# Command verbs used in refusal texts.
COMMAND_VERBS = {"STOP": "stopped", "RESTART": "restarted", "DELETE": "deleted"}
# --- end of fixed values ----------------------------------------------------

# A deleted record; not a lifecycle state, but the fold needs a sink for DELETE.
REMOVED = "Removed"
FOLD_STATES = STATES + [REMOVED]

STATE_CLASS = {
    **{s: "waiting" for s in WAITING},
    **{s: "trigger" for s in TRIGGER},
    **{s: "in_progress" for s in IN_PROGRESS},
    **{s: "stable" for s in STABLE},
}
STATE_FLOW = {
    **{s: "start" for s in FLOW_START},
    **{s: "terminate" for s in FLOW_TERMINATE},
    **{s: "error_clean" for s in FLOW_ERROR},
}


def is_error_state(kind: str) -> bool:
    return kind.startswith("Error")


# Signals the fold understands (CREATE only makes new records and is not folded).
SIGNALS = [
    "STOP", "RESTART", "DELETE", "ACQUIRE", "RELEASE_OK", "RELEASE_ERR", "TIMEOUT",
] + [f"PHASE_{p}" for p in ["Pending", "Running", "Succeeded", "Failed", "Unknown", "NotExisted"]]

# Message rules: what a transition does to the state message.
#   clear  - the new state carries no message
#   keep   - message carried over unchanged
#   set    - message := the signal's text (an action error)
#   append - message := old + ERROR_SEPARATOR + signal text
#   const  - message := fixed text of the edge
# Next-update rules: none (never again), now, interval (now + check interval),
# timeout (now + trigger timeout).


@dataclass(frozen=True)
class Edge:
    from_kind: str | None
    signal: str
    to_kind: str
    msg_rule: str
    next_rule: str
    actor: str
    const_message: str | None = None


def _monitor_next(to_kind: str) -> str:
    """Next-update rule of every monitor write: a function of the new state's class."""
    if to_kind == REMOVED:
        return "none"
    return {"waiting": "now", "trigger": "timeout", "in_progress": "interval", "stable": "none"}[
        STATE_CLASS[to_kind]
    ]


def _build_edges() -> list[Edge]:
    e: list[Edge] = []
    srv = "server"
    # Commands issued through the service API.
    e.append(Edge(None, "CREATE", "WaitToStart", "clear", "now", srv))
    e.append(Edge("WaitToStart", "STOP", "Terminated", "clear", "none", srv))
    for s in ["StartInProgress", "Running"]:
        e.append(Edge(s, "STOP", "WaitToTerminate", "clear", "now", srv))
    # Restart of a terminating engine asks for an immediate check (now, not now+interval).
    e.append(Edge("WaitToTerminate", "RESTART", "Running", "clear", "now", srv))
    e.append(Edge("Terminated", "RESTART", "WaitToStart", "clear", "now", srv))
    for s in ["WaitToStart", "Terminated", "ErrorClean"]:
        e.append(Edge(s, "DELETE", REMOVED, "clear", "none", srv))

    mon = "monitor"
    acquire = {"WaitToStart": "TriggerStart", "WaitToTerminate": "TriggerTermination",
               "ErrorWaitToClean": "ErrorTriggerClean"}
    for s, t in acquire.items():
        e.append(Edge(s, "ACQUIRE", t, "keep" if is_error_state(t) else "clear", _monitor_next(t), mon))
    release = [
        ("TriggerStart", "RELEASE_OK", "StartInProgress", "clear"),
        ("TriggerStart", "RELEASE_ERR", "ErrorClean", "set"),
        ("TriggerTermination", "RELEASE_OK", "TerminateInProgress", "clear"),
        ("TriggerTermination", "RELEASE_ERR", "ErrorWaitToClean", "set"),
        ("ErrorTriggerClean", "RELEASE_OK", "ErrorCleanInProgress", "keep"),
        ("ErrorTriggerClean", "RELEASE_ERR", "ErrorWaitToClean", "append"),
    ]
    for s, sig, t, rule in release:
        e.append(Edge(s, sig, t, rule, _monitor_next(t), mon))
    for t, s in acquire.items():  # a timed-out trigger goes back to waiting
        e.append(Edge(s, "TIMEOUT", t, "keep" if is_error_state(t) else "clear", _monitor_next(t), mon))

    obs = "observer"

    def o(s, phases, t, rule, const=None):
        for p in phases:
            e.append(Edge(s, f"PHASE_{p}", t, rule, _monitor_next(t), obs, const))

    gone = ["Succeeded", "Failed", "NotExisted"]
    o("StartInProgress", ["Pending", "Unknown"], "StartInProgress", "keep")
    o("StartInProgress", ["Running"], "Running", "clear")
    o("StartInProgress", gone, "ErrorClean", "const", MSG_FAILS_TO_START)
    o("Running", ["Pending"], "ErrorCleanInProgress", "const", MSG_RESTARTS_UNEXPECTED)
    o("Running", ["Running", "Unknown"], "Running", "keep")
    o("Running", gone, "ErrorClean", "const", MSG_TERMINATES_DURING_RUNNING)
    o("TerminateInProgress", ["NotExisted"], "Terminated", "clear")
    o("TerminateInProgress", [p for p in PHASES if p != "NotExisted"], "TerminateInProgress", "keep")
    o("ErrorCleanInProgress", ["NotExisted"], "ErrorClean", "keep")
    o("ErrorCleanInProgress", [p for p in PHASES if p != "NotExisted"], "ErrorCleanInProgress", "keep")
    return e


EDGES: list[Edge] = _build_edges()
FOLD_EDGES = [x for x in EDGES if x.from_kind is not None]
assert len(FOLD_EDGES) == 44, len(FOLD_EDGES)
assert len({(x.from_kind, x.signal) for x in FOLD_EDGES}) == 44

MSG_RULES = ["clear", "keep", "set", "append", "const"]
NEXT_RULES = ["none", "now", "interval", "timeout"]

EDGE_SCHEMA = T.StructType([
    T.StructField("from_kind", T.StringType()),
    T.StructField("signal", T.StringType(), False),
    T.StructField("to_kind", T.StringType(), False),
    T.StructField("msg_rule", T.StringType(), False),
    T.StructField("next_rule", T.StringType(), False),
    T.StructField("actor", T.StringType(), False),
    T.StructField("const_message", T.StringType()),
])


def edges_df(spark: SparkSession, include_create: bool = False) -> DataFrame:
    """The transition table as literal rows: a relation of known, fixed size; safe to broadcast."""
    rows = [
        (x.from_kind, x.signal, x.to_kind, x.msg_rule, x.next_rule, x.actor, x.const_message)
        for x in (EDGES if include_create else FOLD_EDGES)
    ]
    return literal_rows(spark, rows, EDGE_SCHEMA)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A VALUES relation of string and integer literals; no Python rows, and the planner knows its size."""
    def text(v) -> str:
        if v is None or isinstance(v, int):
            return "NULL" if v is None else str(v)
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    cols = ", ".join(f"CAST(c{i} AS {f.dataType.simpleString()}) AS {f.name}" for i, f in enumerate(schema.fields))
    names = ", ".join(f"c{i}" for i in range(len(schema.fields)))
    return spark.sql(f"SELECT {cols} FROM VALUES {values} AS t({names})")


def dense_tables() -> dict[str, list]:
    """Row-major [state * len(SIGNALS) + signal] arrays for the fold.

    ``next`` holds the target state index or -1 when the signal is not allowed.
    """
    n_s, n_g = len(FOLD_STATES), len(SIGNALS)
    nxt = [-1] * (n_s * n_g)
    msg = [0] * (n_s * n_g)
    nr = [0] * (n_s * n_g)
    const: list[str | None] = [None] * (n_s * n_g)
    for x in FOLD_EDGES:
        k = FOLD_STATES.index(x.from_kind) * n_g + SIGNALS.index(x.signal)
        nxt[k] = FOLD_STATES.index(x.to_kind)
        msg[k] = MSG_RULES.index(x.msg_rule)
        nr[k] = NEXT_RULES.index(x.next_rule)
        const[k] = x.const_message
    return {"next": nxt, "msg": msg, "next_rule": nr, "const": const}


def state_dimension_rows() -> list[tuple]:
    """(state_kind, state_index, state_class, flow, has_message) for the 12 states."""
    return [(s, i, STATE_CLASS[s], STATE_FLOW[s], is_error_state(s)) for i, s in enumerate(STATES)]


@dataclass(frozen=True)
class Params:
    """Explicit clock and monitor settings; operators never read the wall clock."""

    now: int = 883612800  # 1998-01-01 00:00:00 UTC, whole seconds
    interval: int = 5  # check interval, 0..255
    timeout: int = 60  # trigger-state timeout, 0..65535

    def __post_init__(self):
        if not 0 <= self.interval <= 255:
            raise ValueError("check interval must be in 0..255 seconds")
        if not 0 <= self.timeout <= 65535:
            raise ValueError("trigger timeout must be in 0..65535 seconds")


DEFAULT_PARAMS = Params()

REGISTRY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("engine_type", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("state_kind", T.StringType(), False),
    T.StructField("state_message", T.StringType()),
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("create_time", T.TimestampType()),
    T.StructField("next_update_time", T.LongType()),
])

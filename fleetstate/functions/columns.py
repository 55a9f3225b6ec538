"""Column expressions for lifecycle values (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetstate.model import IN_PROGRESS, STABLE, STATE_CLASS, STATE_FLOW, STATES, TRIGGER, WAITING

# --- fixed values: error kinds, their display text and HTTP status ----------
ERROR_KINDS = [
    ("NotFound", "Not found", 404),
    ("Unauthorized", "Unauthorized", 401),
    ("NotAllowed", "Not allowed", 403),
    ("FailToStartServer", "Fail to start server", 500),
    ("FailToStartStateMonitor", "Fail to start state monitor", 500),
    ("FailToStartEngine", "Fail to start engine", 500),
    ("FailToDeleteEngine", "Fail to delete engine", 500),
    ("FailToConnectDatabase", "Fail to connect to database", 500),
    ("FailToUpdateDatabase", "Fail to update database", 500),
    ("FailToReadDatabase", "Fail to read database", 500),
    ("FailToLoadConfig", "Fail to load config", 500),
]
# --- end of fixed values -----------------------------------------------------

UNIT_STATES = [s for s in STATES if not s.startswith("Error")]
ERROR_STATES = [s for s in STATES if s.startswith("Error")]


def _lit_map(d: dict) -> Column:
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def state_class(kind: Column | str) -> Column:
    return F.try_element_at(_lit_map(STATE_CLASS), col_(kind))


def state_flow(kind: Column | str) -> Column:
    return F.try_element_at(_lit_map(STATE_FLOW), col_(kind))


def next_update_time(kind: Column | str, now: Column | int, interval: int, timeout: int) -> Column:
    """Monitor rule: waiting -> now, trigger -> now+timeout, in progress -> now+interval, stable -> NULL."""
    k = col_(kind)
    now_c = now if isinstance(now, Column) else F.lit(now).cast("bigint")
    return (F.when(k.isin(*WAITING), now_c)
            .when(k.isin(*TRIGGER), now_c + F.lit(timeout))
            .when(k.isin(*IN_PROGRESS), now_c + F.lit(interval))
            .when(k.isin(*STABLE), F.lit(None).cast("bigint")))


def encode_state(kind: Column | str, message: Column | str) -> Column:
    """Wire form: a JSON string for unit states, {"ErrorX": "msg"} for error states."""
    k, m = col_(kind), col_(message)
    # to_json refuses a bare string; state names need no escaping, so quote by hand
    return F.when(k.isin(*ERROR_STATES), F.to_json(F.create_map(k, m))).otherwise(F.concat(F.lit('"'), k, F.lit('"')))


def debug_text(kind: Column | str, message: Column | str) -> Column:
    """Debug rendering used in refusal texts: WaitToStart, ErrorClean("msg")."""
    k, m = col_(kind), col_(message)
    esc = m
    for a, b in [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
        esc = F.replace(esc, F.lit(a), F.lit(b))
    return F.when(k.isin(*ERROR_STATES), F.concat(k, F.lit('("'), esc, F.lit('")'))).otherwise(k)


def format_time(ts: Column | str) -> Column:
    """UTC time as 'YYYY-MM-DD HH:MM:SS +00:00:00'."""
    return F.concat(F.date_format(col_(ts), "yyyy-MM-dd HH:mm:ss"), F.lit(" +00:00:00"))


def parse_time(text: Column | str) -> Column:
    """Parse the offset form above (any +HH:MM:SS offset); NULL when malformed."""
    return F.try_to_timestamp(col_(text), F.lit("yyyy-MM-dd HH:mm:ss XXXXX"))


def elapsed_seconds(ts: Column | str, now: int) -> Column:
    return F.lit(now).cast("bigint") - F.unix_seconds(col_(ts))


def error_display(kind: Column | str) -> Column:
    return F.try_element_at(_lit_map({k: d for k, d, _ in ERROR_KINDS}), col_(kind))


def error_status(kind: Column | str) -> Column:
    return F.try_element_at(_lit_map({k: s for k, _, s in ERROR_KINDS}), col_(kind))

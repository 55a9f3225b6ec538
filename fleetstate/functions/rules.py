"""The rule compiler: an edges table becomes the dense arrays that folds and streams use.

The arrays are indexed by state * n_signals + signal. A table is small by nature (one edge per state
and signal); ``compile_rules`` checks that, and what else would make a fold ambiguous, before it
collects anything. ``rule_report`` looks at a table as a graph, on Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetstate.model import FOLD_EDGES, FOLD_STATES, MSG_RULES, NEXT_RULES, REMOVED, SIGNALS, STATE_CLASS, literal_rows

MAX_EDGES = 10_000  # a table beyond this isn't a rule table
CLEAR, KEEP, SET, APPEND, CONST = range(len(MSG_RULES))


@dataclass(frozen=True, eq=False)
class RuleTable:
    """States and signals by number, and per (state, signal): next state (-1: not allowed), message
    rule, next-update rule and fixed message. ``removed`` is the state of deleted records."""

    states: list[str]
    signals: list[str]
    next: np.ndarray
    msg: np.ndarray
    rule: np.ndarray
    const: list[str | None]

    @property
    def removed(self) -> int:
        return self.states.index(REMOVED)

    @property
    def maps(self) -> np.ndarray:
        """[signal + 1][state] -> state after it; row 0 (no such signal) and missing edges change nothing."""
        n = len(self.states)
        after = self.next.reshape(n, len(self.signals)).T
        stay = np.arange(n)
        return np.vstack([stay, np.where(after < 0, stay, after)])

    @property
    def triggers(self) -> set[int]:
        return {i for i, s in enumerate(self.states) if STATE_CLASS.get(s) == "trigger"}


def _table(edges: list[tuple]) -> RuleTable:
    """From (from_kind, signal, to_kind, msg_rule, next_rule, const_message) rows."""
    states = FOLD_STATES + sorted({x for e in edges for x in (e[0], e[2])} - set(FOLD_STATES))
    signals = SIGNALS + sorted({e[1] for e in edges} - set(SIGNALS))
    n = len(states) * len(signals)
    nxt, msg, rule = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    const: list[str | None] = [None] * n
    for a, signal, b, m, r, text in edges:
        k = states.index(a) * len(signals) + signals.index(signal)
        nxt[k], msg[k], rule[k], const[k] = states.index(b), MSG_RULES.index(m), NEXT_RULES.index(r), text
    return RuleTable(states, signals, nxt, msg, rule, const)


BUILT_IN = _table([(x.from_kind, x.signal, x.to_kind, x.msg_rule, x.next_rule, x.const_message) for x in FOLD_EDGES])


def compile_rules(edges: DataFrame | None = None) -> RuleTable:
    """The built-in rules, or a caller's table (D12; columns as ``model.EDGE_SCHEMA``).

    States and signals that the model doesn't have are added. Edges without a from_kind make records
    (CREATE) and aren't folded. Raises ValueError for a table of more than MAX_EDGES rows, two edges
    of one state and signal, a missing value, an unknown message or next-update rule, a fixed message
    that is missing, and an edge out of the removed state."""
    if edges is None:
        return BUILT_IN
    cols = ["from_kind", "signal", "to_kind", "msg_rule", "next_rule", "const_message"]
    rows = [tuple(r) for r in edges.where("from_kind is not null").select(*cols).limit(MAX_EDGES + 1).collect()]
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges")
    seen = set()
    for a, signal, b, m, r, text in rows:
        where = f"edge {a} -{signal}->"
        if signal is None or b is None:
            raise ValueError(f"{where} {b}: signal and target must be given")
        if m not in MSG_RULES or r not in NEXT_RULES:
            raise ValueError(f"{where} {b}: unknown rule {m if m not in MSG_RULES else r}")
        if m == "const" and text is None:
            raise ValueError(f"{where} {b}: a fixed message must be given")
        if a == REMOVED:
            raise ValueError(f"{where} {b}: a removed record has no transitions")
        if (a, signal) in seen:
            raise ValueError(f"{where}: more than one edge")
        seen.add((a, signal))
    return _table(sorted(rows, key=lambda e: e[:2]))


def rule_report(edges: DataFrame, start: str = "WaitToStart") -> DataFrame:
    """One row per state of an edges table: n_out (its edges), n_conflicts (signals with several),
    reachable (from ``start``), distance (least number of transitions), dead_end (no way out, and not
    the removed state).

    The table is a rule table of MAX_EDGES rows at most (ValueError beyond); it may be one that
    ``compile_rules`` refuses, and this says why."""
    rows = [tuple(r) for r in edges.where("from_kind is not null and to_kind is not null").select("from_kind", "signal", "to_kind").limit(MAX_EDGES + 1).collect()]
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges")
    out: dict[str, list] = {}
    for a, signal, b in rows:
        out.setdefault(a, []).append((signal, b))
        out.setdefault(b, [])
    distance, front = {start: 0}, [start]
    while front:  # closure, one transition further each time
        front = sorted({b for a in front for _, b in out.get(a, []) if b not in distance})
        distance |= {b: max(distance.values()) + 1 for b in front}
    report = [(s, len(out[s]), len(out[s]) - len({g for g, _ in out[s]}), int(s in distance), distance.get(s), int(not out[s] and s != REMOVED)) for s in sorted(out)]
    schema = T._parse_datatype_string("state string, n_out bigint, n_conflicts bigint, reachable boolean, distance bigint, dead_end boolean")
    return literal_rows(edges.sparkSession, report, schema) if report else edges.sparkSession.createDataFrame([], schema)

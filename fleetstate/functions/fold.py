"""The ordered fold in numpy: a segmented parallel prefix over function composition.

A signal is a function on states, written as a vector of next states; functions compose, and
composition is associative, so the states after every row of many runs come from one pairwise scan
(about two compositions a row, a logarithmic number of numpy calls). What a run does to message and
next-update time follows from its last writers. No step loops over rows; only appended messages, whose
texts grow with each other, are joined one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from fleetstate.functions.rules import APPEND, CONST, KEEP, SET, RuleTable
from fleetstate.model import ERROR_SEPARATOR, Params


def prefix(maps: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Row i: the composition of the functions from the start of row i's run up to row i.

    ``maps`` [row][state] -> state; ``head`` marks the first row of each run."""
    n, width = maps.shape
    if n < 2:
        return maps
    m = n // 2 * 2
    first, second, reset = maps[0:m:2], maps[1:m:2], head[1:m:2]
    pair = _after(second, first)
    pair[reset] = second[reset]
    done = prefix(pair, head[0:m:2] | reset)
    out = np.empty_like(maps)
    out[0], out[1:m:2] = maps[0], done
    rest, alone = maps[2:n:2], head[2:n:2]
    got = _after(rest, done[: len(rest)])
    got[alone] = rest[alone]
    out[2:n:2] = got
    return out


def _after(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    n, width = outer.shape
    return np.take(np.ascontiguousarray(outer).reshape(-1), inner + (np.arange(n) * width)[:, None])


def last_true(flag: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per run (``first``: its first row) the last row with ``flag``, or -1."""
    return np.maximum.reduceat(np.where(flag, np.arange(len(flag)), -1), first)


def last_so_far(flag: np.ndarray, first: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Per row the last row with ``flag`` up to it in its run, or -1."""
    at = np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))
    return np.where(at >= first[run], at, -1)


@dataclass
class Walk:
    """What happens at each row, from given start states."""

    before: np.ndarray
    after: np.ndarray
    edge: np.ndarray  # place in the rule table
    applied: np.ndarray


class Fold:
    """The rules with a batch of rows: signal number ``g`` (-1: unknown), second ``t``, text ``msg``,
    and runs by first row."""

    def __init__(self, rules: RuleTable, p: Params, g: np.ndarray, t: np.ndarray, msg: pa.Array, first: np.ndarray):
        self.rules, self.g, self.t, self.msg, self.first = rules, g, t, msg, first
        self.n = len(g)
        head = np.zeros(self.n, bool)
        head[first] = True
        self.run = np.cumsum(head) - 1
        self.states = prefix(rules.maps[g + 1], head)
        self.wait = np.array([0, 0, p.interval, p.timeout])
        # texts that a message may be: fixed ones, "" (nothing added yet), then the rows' own
        self.texts = [pa.array([*rules.const, ""], pa.string()), msg.cast(pa.string())]
        self.nothing = len(rules.const)

    def walk(self, start: np.ndarray) -> Walk:
        """``start``: the state that each run begins with."""
        after = self.states[np.arange(self.n), start[self.run]]
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[self.first] = start
        edge = before * len(self.rules.signals) + np.maximum(self.g, 0)
        applied = (self.g >= 0) & (self.rules.next[edge] >= 0)
        return Walk(before, after, edge, applied)

    def _rule(self, w: Walk) -> tuple[np.ndarray, np.ndarray]:
        """Message rule of each row, and the place of the text that it sets (-1: none)."""
        rule = np.where(w.applied, self.rules.msg[w.edge], KEEP)
        text = np.where(rule == SET, self.nothing + 1 + np.arange(self.n), np.where(rule == CONST, w.edge, -1))
        return rule, text

    def next_times(self, w: Walk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, is null) of the next-update time that the transitions at rows ``at`` set."""
        kind = self.rules.rule[w.edge[at]]
        return self.t[at] + self.wait[kind], kind == 0

    def ends(self, start: np.ndarray) -> dict:
        """What each run does: end state s; number of transitions; whether message and next-update
        time are kept from the start, else what they are. A kept message may have text added."""
        w = self.walk(start)
        rule, text = self._rule(w)
        last = np.append(self.first[1:], self.n) - 1
        mover = last_true(w.applied, self.first)
        value, null = self.next_times(w, np.maximum(mover, 0))
        writer = last_true((rule != KEEP) & (rule != APPEND), self.first)
        place = np.where(writer < 0, self.nothing, text[np.maximum(writer, 0)])
        mt = _take(self.texts, place)
        added = np.flatnonzero((rule == APPEND) & (np.arange(self.n) > writer[self.run]))
        if len(added):
            parts: dict[int, list] = {}
            for r, x in zip(self.run[added].tolist(), self.msg.take(pa.array(added)).to_pylist()):
                parts.setdefault(r, []).append(x)
            mt = mt.to_pylist()
            for r, xs in parts.items():
                mt[r] = None if None in (mt[r], *xs) else ERROR_SEPARATOR.join([mt[r], *xs])
            mt = pa.array(mt, pa.string())
        return {"s": w.after[last], "na": np.add.reduceat(w.applied.astype(np.int64), self.first), "nk": mover < 0, "nv": np.where(null, 0, value), "nn": null, "mk": writer < 0, "mt": mt}

    def rows(self, start: np.ndarray, m0: pa.Array, n0: pa.Array) -> dict:
        """State, message and next-update time before and after every row; ``m0`` and ``n0`` are those
        that the runs begin with."""
        w = self.walk(start)
        rule, text = self._rule(w)
        mover = last_so_far(w.applied, self.first, self.run)
        value, null = self.next_times(w, np.maximum(mover, 0))
        begin = n0.take(pa.array(self.run))
        known = np.where(mover >= 0, value, begin.fill_null(0).to_numpy(zero_copy_only=False))
        missing = np.where(mover >= 0, null, begin.is_null().to_numpy(zero_copy_only=False))
        event = last_so_far(rule != KEEP, self.first, self.run)
        held = sum(len(x) for x in self.texts)
        place = np.where(rule == APPEND, 0, text)
        texts = [*self.texts, m0.cast(pa.string())]
        added = np.flatnonzero(rule == APPEND)
        if len(added):
            own = np.full(self.n, -1)  # number of an appended message
            own[added] = np.arange(len(added))
            before = np.where(added > self.first[self.run[added]], event[np.maximum(added - 1, 0)], -1)
            older = _take(texts, np.where(before >= 0, place[np.maximum(before, 0)], held + self.run[added])).to_pylist()
            chain = np.where(before >= 0, own[np.maximum(before, 0)], -1).tolist()
            made: list = []
            for x, old, c in zip(self.msg.take(pa.array(added)).to_pylist(), older, chain):
                old = made[c] if c >= 0 else old
                made.append(None if old is None or x is None else old + ERROR_SEPARATOR + x)
            place[added] = held + len(m0) + np.arange(len(added))
            texts.append(pa.array(made, pa.string()))
        place = np.where(event >= 0, place[np.maximum(event, 0)], held + self.run)
        return {"before": w.before, "after": w.after, "applied": w.applied, "message": _take(texts, place), "next": pa.array(known, pa.int64(), mask=missing)}


def _take(texts: list[pa.Array], place: np.ndarray) -> pa.Array:
    """The text at each place of the arrays one after the other; -1 is null."""
    return pa.concat_arrays(texts).take(pa.array(np.maximum(place, 0), mask=place < 0))

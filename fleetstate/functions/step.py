"""One transition of the fold, for the places that run per key in Python (stream state).

The dense tables come from a compiled rule table; a state is (s, message, next_update_time).
"""

from __future__ import annotations

from fleetstate.functions.rules import BUILT_IN, RuleTable
from fleetstate.model import ERROR_SEPARATOR, FOLD_STATES, SIGNALS, Params

N_STATES = len(FOLD_STATES)
N_SIGNALS = len(SIGNALS)
REMOVED_INDEX = FOLD_STATES.index("Removed")
SIGNAL_INDEX = {s: i for i, s in enumerate(SIGNALS)}


class Stepper:
    def __init__(self, p: Params, rules: RuleTable = BUILT_IN):
        self.next, self.msg, self.rule, self.const = rules.next.tolist(), rules.msg.tolist(), rules.rule.tolist(), rules.const
        self.n_signals, self.removed = len(rules.signals), rules.removed
        self.p = p

    def step(self, s: int, m, n, g: int, x_msg, t: int):
        """Apply signal ``g`` (index, -1 if unknown) at epoch second ``t``.

        Returns (s, m, n, outcome) with outcome Applied / NotAllowed / NotFound.
        """
        k = s * self.n_signals + g
        if g < 0 or self.next[k] < 0:
            return s, m, n, ("NotFound" if s == self.removed else "NotAllowed")
        r = self.msg[k]
        if r == 0:
            m = None
        elif r == 2:
            m = x_msg
        elif r == 3:
            m = None if m is None or x_msg is None else m + ERROR_SEPARATOR + x_msg
        elif r == 4:
            m = self.const[k]
        q = self.rule[k]
        p = self.p
        n = None if q == 0 else int(t) + (0 if q == 1 else p.interval if q == 2 else p.timeout)
        return self.next[k], m, n, "Applied"

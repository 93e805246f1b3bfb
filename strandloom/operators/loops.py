"""Expected counts of motif models by windows instead of states.

A motif between visits of one background state is a hub with loops: from the
hub (state 0) each loop's states follow in a fixed order and lead back to it.
What a visit of a loop weighs depends on the symbols in its window alone. So
the recursions need the hub only, and all expected counts follow from the
posterior weight of each window text. This is exact: sums are the same as those
of all states, taken in another order.

Windows also hang over the ends of a sequence (it may begin and end within a
motif); places outside of it have a symbol of their own. Step t is the return to
the hub at place t, from the window before it; there are as many steps behind
the end as a loop has states. Weights are odds against staying in the hub.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import numpy as np

from ..models.hidden import HiddenModel

#: Window texts up to which tables are kept, and steps between two scalings.
MOST_TEXTS = 50_000
BLOCK = 32


def loops_of(model: HiddenModel) -> np.ndarray | None:
    """States of the loops in the order of their visits, a row for each, or None where the model is no hub with loops of one length and few window texts."""
    linked = model.a_at >= 0
    if not linked[0, 0] or (linked[1:].sum(1) != 1).any():
        return None
    after, got = linked.argmax(1), []
    for first in (np.flatnonzero(linked[0, 1:]) + 1).tolist():
        states = [first]
        while after[states[-1]] and len(states) < model.states:
            states.append(int(after[states[-1]]))
        got.append(states)
    if len({len(x) for x in got}) != 1 or sorted(sum(got, [])) != list(range(1, model.states)):
        return None
    return np.array(got) if (model.symbols + 2) ** len(got[0]) <= MOST_TEXTS and len(got[0]) < BLOCK else None


@lru_cache(2)
def _outside(symbols: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many places at the begin and at the end of each window text lie outside of the sequence."""
    out = np.stack(np.unravel_index(np.arange(symbols**length), (symbols,) * length)) == symbols - 1
    return out.cumprod(0).sum(0), out[::-1].cumprod(0).sum(0)


class Windows:
    """Adds up the expected counts of groups of sequences as ``train._in_steps`` has them."""

    def __init__(self, model: HiddenModel, loops: np.ndarray) -> None:
        self.model, self.loops = model, loops
        n, self.length = loops.shape
        self.symbols = model.symbols + 2  # also the unknown one and the outside
        self.texts = self.symbols**self.length
        emit = np.hstack([model.b_unknown, np.ones((model.states, 1))])
        self.hub, self.stay = emit[0], model.a[0, 0]
        lead, trail = _outside(self.symbols, self.length)
        with np.errstate(all="ignore"):
            odds = np.ones((n, 1))
            for states in loops.T:
                odds = (odds[:, :, None] * (emit[states] / self.hub)[:, None]).reshape(n, -1)
            inner = odds * model.a[0, loops[:, 0]][:, None] * self.stay ** -(self.length + 1.0)
            begin = odds * model.pi[loops][:, np.minimum(lead, self.length - 1)] * self.stay ** (lead - float(self.length))
            end = self.stay ** (1.0 + trail)
            #: Of each loop and window text: inside, over the end, at the begin, both.
            self.weights = np.stack([inner, inner * end, begin, begin * end])
            self.table = np.append(self.weights.sum(1), 0.0)
            self.usable = bool((self.hub > 0).all() and self.stay > 0 and BLOCK * np.log1p(self.table.max()) < 600)  # False where a weight is infinite or none
        self.found, self.stays, self.ll = np.zeros(4 * self.texts), np.zeros(self.symbols), 0.0
        self.first, self.moved = 0.0, 0.0
        self.space: dict[str, np.ndarray] = {}

    def _room(self, name: str, size: int, kind: type = float) -> np.ndarray:
        """An array whose memory is used again for the next group, as fresh memory costs more than what is done with it."""
        if name not in self.space or len(self.space[name]) < size:
            self.space[name] = np.empty(size, kind)
        return self.space[name][:size]

    def add(self, counts: np.ndarray, codes: np.ndarray) -> bool:
        """Adds a group; False, and nothing added, where the odds do not hold all of its sequences. Only where the weights are ``usable``."""
        length, rows, outside = self.length, int(counts[0]), self.symbols - 1
        ends = np.cumsum(counts)
        every = np.arange(rows)
        sizes = np.searchsorted(-counts, -every)
        inside = [*counts.tolist(), *[0] * length]
        held = [*[rows] * length, *counts.tolist(), 0]
        at = np.cumsum([0, *held[:-1]])
        spans = [slice(i, j) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        steps = len(spans)
        size = int(at[-1])
        symbols = self._room("symbols", size, np.int32)
        symbols.fill(outside)
        for span, n, j in zip(spans, inside, ends.tolist()):
            symbols[span.start : span.start + n] = codes[j - n : j]

        oldest = np.multiply(symbols, np.int32(self.texts), out=self._room("oldest", size, np.int32))
        texts = self._room("texts", size, np.int32)
        texts[:rows] = self.texts - 1
        for t in range(1, steps):
            n, own = held[t], texts[spans[t]]
            np.multiply(texts[spans[t - 1]][:n], self.symbols, out=own)
            own += symbols[spans[t - 1]][:n]
            own -= oldest[spans[t - 1 - length]][:n] if t > length else outside * self.texts
        texts[rows : at[length + 1]] += 2 * self.texts
        np.add(texts, self.texts, out=texts, where=np.equal(symbols, outside, out=self._room("over", size, bool)))
        texts[:rows] = 4 * self.texts
        index = self._room("index", size, np.intp)
        index[:] = texts
        weight = self.table.take(index, mode="clip", out=self._room("weight", size))

        flow, hub, back = (self._room(x, size) for x in ("flow", "hub", "back"))
        flow[:rows], hub[:rows] = 0, self.model.pi[0]
        before = deque([hub[:rows]], length + 1)
        logs, scales = np.zeros(rows), {}
        with np.errstate(all="ignore"):
            for t in range(1, steps):
                n, span = held[t], spans[t]
                if t > length:
                    np.multiply(weight[span], before[0][:n], out=flow[span])
                else:
                    flow[span] = weight[span]
                np.add(before[-1][:n], flow[span], out=hub[span])
                before.append(hub[span])
                if t % BLOCK == 0:  # later steps are scaled by the hub of this one
                    scales[t] = hub[span].copy()
                    before = deque((x[:n] / scales[t] for x in before), length + 1)
                    logs[: held[t + 1]] += np.log(scales[t][: held[t + 1]])
            total = hub[at[sizes + length - 1] + every]
            if not (np.isfinite(total) & np.isfinite(logs) & (total > 0)).all():
                return False

        ahead: deque[np.ndarray] = deque(maxlen=length + 1)
        after, ended = np.empty(0), 1 / total
        for t in range(steps - 1, -1, -1):
            n, span, n_on = held[t], spans[t], held[t + 1]
            if t in scales:
                after = after / scales[t][:n_on]
                ahead = deque((x / scales[t][: len(x)] for x in ahead), length + 1)
            here = back[span]
            here[:n_on] = after
            here[n_on:] = ended[n_on:n]
            if len(ahead) > length:
                here[: len(ahead[0])] += ahead[0]
            after = here
            ahead.append(weight[span] * here)

        flow *= back
        hub *= back
        self.found += np.bincount(index, flow, 4 * self.texts + 1)[:-1]
        index[:] = symbols
        self.stays += np.bincount(index, hub, self.symbols)
        self.first += hub[:rows].sum()
        self.moved -= hub[at[sizes - 1] + every].sum()
        known = np.bincount(codes, minlength=self.symbols)[: self.symbols]
        self.ll += np.log(total).sum() + logs.sum() + known @ np.log(self.hub) + (len(codes) - rows) * np.log(self.stay)
        return True

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
        """Expected counts of starts, transitions and emissions, and the log-likelihood, of all groups added."""
        n, m, length = self.model.states, self.model.symbols, self.length
        pi, a, b = np.zeros(n), np.zeros((n, n)), np.zeros((n, m))
        lead, _ = _outside(self.symbols, length)
        all_loops = self.table[:-1].reshape(4, 1, -1)
        shares = np.divide(self.weights, all_loops, out=np.zeros_like(self.weights), where=all_loops > 0) * self.found.reshape(4, 1, -1)
        pi[0], b[0] = self.first, self.stays[:m]
        for states, visits in zip(self.loops, shares.swapaxes(0, 1)):
            pi[states] = np.bincount(lead, visits[2:].sum(0), length + 1)[:length]
            a[0, states[0]] = visits[:2].sum()
            a[states[-1], 0] = visits[::2].sum()
            by_text = visits.sum(0).reshape((self.symbols,) * length)
            for k, state in enumerate(states):
                there = np.moveaxis(by_text, k, 0)
                b[state] = there[:m].reshape(m, -1).sum(1)
                if k + 1 < length:
                    a[state, states[k + 1]] = np.moveaxis(there, k + 1, 1)[:-1, :-1].sum()
        a[0, 0] = max(0.0, self.stays[:-1].sum() + self.moved - a[0].sum())
        return pi, a, b, float(self.ll), 0


__all__ = ["Windows", "loops_of"]

"""Motif and background models.

A motif model has background states first, then the places of the motif on the
forward strand and then on the reverse strand, whose states share the forward
emissions with the alphabet reversed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from .hidden import HiddenModel, Prior, States, as_model

Rows = Sequence[Sequence[float]]


class Emissions:
    """Adds states over order-n codes to a model under construction."""

    def __init__(self, order: int = 0, alphabet: int = 4) -> None:
        self.order, self.alphabet = order, alphabet
        self.symbols = alphabet ** (order + 1)

    def empty(self) -> States:
        return States(self.symbols, self.order)

    def full_state(self, to: States, pi: float | None = 1.0, p: Sequence[float] | None = None) -> int:
        """A state with a parameter for each code."""
        values = [1 / self.symbols] * self.symbols if p is None else p
        if len(values) != self.symbols:
            raise ValueError(f"{self.symbols} emissions are needed")
        return to.state(None if pi is None else to.parameter(pi), [to.parameter(x) for x in values])

    def symbol_state(self, to: States, pi: float | None = 1.0, p: Sequence[float] | None = None) -> int:
        """A state whose codes share the parameter of their newest symbol."""
        values = [1 / self.alphabet] * self.alphabet if p is None else p
        if len(values) != self.alphabet:
            raise ValueError(f"{self.alphabet} emissions are needed")
        shared = [to.parameter(x) for x in values]
        return to.state(None if pi is None else to.parameter(pi), [shared[m % self.alphabet] for m in range(self.symbols)])

    def reverse_state(self, to: States, forward: int, pi: float | None = 1.0) -> int:
        """A state with the emissions of ``forward`` for complementary symbols."""
        k = self.alphabet
        shared = [to.b[forward][k - 1 - m % k] for m in range(self.symbols)]
        return to.state(None if pi is None else to.parameter(pi), shared)


def uniform_background(order: int = 0, alphabet: int = 4) -> States:
    """One state, all emissions equal."""
    got = Emissions(order, alphabet).empty()
    s = Emissions(order, alphabet).full_state(got, 1.0)
    got.link(s, s, got.parameter(1.0))
    return got


def mosaic_background(order: int, mosaics: int, p_change: float = 0.01, strength: float = 100.0, seed: int = 0) -> States:
    """``mosaics`` states with Dirichlet emissions; staying and changing have one parameter each."""
    make, rng = Emissions(order), np.random.default_rng(seed)
    got = make.empty()
    change, stay = got.parameter(p_change), got.parameter(1 - p_change)
    for _ in range(mosaics):
        make.full_state(got, 1.0, rng.dirichlet(np.full(make.symbols, strength)).tolist())
    for i in range(mosaics):
        for j in range(mosaics):
            got.link(i, j, stay if i == j else change)
    return got


def extend(model: States, extension: States) -> int:
    """Copies states and parameters of ``extension`` into ``model``; gives the number of its first state."""
    if model.symbols != extension.symbols:
        raise ValueError("the alphabets differ")
    p0, s0 = len(model.theta), len(model.pi)
    model.theta += extension.theta
    shift = lambda p: p if p < 0 else p + p0
    for pi, b in zip(extension.pi, extension.b):
        model.state(shift(pi), [shift(x) for x in b])
    for i, links in enumerate(extension.links):
        for j, p in links.items():
            model.link(s0 + i, s0 + j, shift(p))
    return s0


def with_background(motif: States, entries: Sequence[int], exits: Sequence[int], p_site: float) -> HiddenModel:
    """A motif between visits of a single background state."""
    got = uniform_background(motif.order, 4)
    got.pi[0] = got.parameter(1.0)
    first = extend(got, motif)
    into, out = got.parameter(p_site / len(entries)), got.parameter(1.0)
    for i in entries:
        got.link(0, first + i, into)
    for i in exits:
        got.link(first + i, 0, out)
    return got.model()


def motif_model(p_site: float, rows: Rows) -> HiddenModel:
    """One background state, L forward and L reverse states, numbered along the motif on both strands."""
    n, make = len(rows), Emissions()
    got = make.empty()
    make.full_state(got, 1 - p_site, [0.25] * 4)
    share = p_site / (2 * n)
    for row in rows:
        make.symbol_state(got, share, row)
    for i in range(n):
        make.reverse_state(got, 1 + i, share)
    got.link(0, 0, got.parameter(1 - p_site))
    got.link(0, 1, got.parameter(p_site / 2))
    got.link(0, 2 * n, got.parameter(p_site / 2))
    for i in range(n):
        on = got.parameter(1.0)
        got.link(1 + i, 0 if i == n - 1 else 2 + i, on)
        got.link(1 + n + i, 0 if i == 0 else n + i, on)
    return got.model()


def random_motif_model(p_site: float, length: int, strength: float = 0.01, seed: int = 0) -> HiddenModel:
    return motif_model(p_site, np.random.default_rng(seed).dirichlet(np.full(4, strength), length).tolist())


def shifted_motif_model(model: HiddenModel, offset: int, fill: Sequence[float]) -> HiddenModel:
    """The motif moved by ``offset`` places; places that come in have the emissions ``fill``."""
    n = (model.states - 1) // 2
    b, pi = model.b, model.pi
    old = [i + offset for i in range(n)]
    inside = [0 <= i < n for i in old]
    got = motif_model(model.a[0, 1] * 2, [b[1 + i].tolist() if ok else list(fill) for i, ok in zip(old, inside)])
    new = (1 - pi[0]) / (2 * model.states)
    starts = [pi[0], *[pi[1 + i] if ok else new for i, ok in zip(old, inside)], *[pi[1 + n + i] if ok else new for i, ok in zip(old, inside)]]
    for i, p in enumerate(starts):
        got.set("pi", i, p)
    for k in range(4):
        got.set("b", 0, k, b[0, k])
    got.theta[got.pi_at] /= got.theta[got.pi_at].sum()
    return got


def chain_of_places(got: States, make: Emissions, rows: Rows, p_site: float) -> tuple[list[int], list[int]]:
    """Forward states of the rows and their reverse states, each in the order in which they are visited."""
    forward = [make.symbol_state(got, p_site, row) for row in rows]
    return forward, [make.reverse_state(got, s, p_site) for s in forward][::-1]


def information_content(rows: np.ndarray, background: float = 0.25) -> float:
    """Nats against a uniform background."""
    p = np.asarray(rows, float)
    return float(np.where(p > 0, p * (np.log(np.where(p > 0, p, 1)) - np.log(background)), 0).sum())


@dataclass
class Motif:
    """Builds models of a motif of ``length`` places among ``mosaics`` background states."""

    length: int
    p_site: float = 0.01
    order: int = 0
    mosaics: int = 1
    prior_strength: float = 0.0
    least_information: float = 0.3
    seed: int = 0

    @property
    def places(self) -> int:
        return self.length

    @property
    def states(self) -> int:
        return self.mosaics + 2 * self.places

    @property
    def background(self) -> list[int]:
        return list(range(self.mosaics))

    def reverse_of(self) -> dict[int, int]:
        """Forward state of each reverse state by its place in the numbering of the strands."""
        return {s: s - self.places for s in range(self.mosaics + self.places, self.states)}

    def rows(self, strength: float = 10.0) -> list[list[float]]:
        return np.random.default_rng(self.seed).dirichlet(np.full(4, strength), self.places).tolist()

    def connect(self, got: States, forward: list[int], reverse: list[int]) -> None:
        on = got.parameter(1.0)
        for strand in (forward, reverse):
            for a, b in zip(strand[:-1], strand[1:]):
                got.link(a, b, on)

    def model(self, rows: Rows | None = None) -> HiddenModel:
        rows = self.rows() if rows is None else rows
        if len(rows) != self.places:
            raise ValueError(f"{self.places} rows are needed")
        got, make = mosaic_background(self.order, self.mosaics, seed=self.seed), Emissions(self.order)
        forward, reverse = chain_of_places(got, make, rows, self.p_site)
        into = got.parameter(self.p_site / 2)
        for bg in self.background:
            got.link(bg, forward[0], into)
            got.link(bg, reverse[0], into)
        self.connect(got, forward, reverse)
        out = got.parameter(1 / self.mosaics)
        for bg in self.background:
            got.link(forward[-1], bg, out)
            got.link(reverse[-1], bg, out)
        return got.model()

    def prior(self, model: HiddenModel) -> Prior:
        return Prior.around(model, self.prior_strength)

    def matrix(self, model: HiddenModel) -> np.ndarray:
        return as_model(model).b[self.mosaics : self.mosaics + self.places, :4]

    def p_binding(self, model: HiddenModel) -> float:
        return 2 * float(model.a[0, self.mosaics])

    def set_p_binding(self, model: HiddenModel, p: float) -> None:
        model.set("a", 0, self.mosaics, p / 2)
        model.set("a", 0, 0, 1 - p)

    def shifted(self, model: HiddenModel, by: int) -> HiddenModel:
        """Emissions moved one place: ``by`` = 1 to the right, -1 to the left; the open place is uniform."""
        old = self.matrix(model)
        new = np.full_like(old, 0.25)
        new[max(0, by) : self.places + min(0, by)] = old[max(0, -by) : self.places + min(0, -by)]
        return self._with(model, new)

    def _with(self, model: HiddenModel, rows: np.ndarray) -> HiddenModel:
        got = model.copy()
        for i, row in enumerate(rows):
            for k in range(got.symbols):
                got.set("b", self.mosaics + i, k, row[k % 4])
        return got

    def alternatives(self, model: HiddenModel) -> list[HiddenModel]:
        """The motif moved away from its richer end."""
        rows = self.matrix(model)
        return [self.shifted(model, 1 if information_content(rows[:1]) > information_content(rows[-1:]) else -1)]

    def is_interesting(self, model: HiddenModel) -> bool:
        return information_content(self.matrix(model)) > self.least_information * self.length

    def generator(self, strength: float = 0.05) -> HiddenModel:
        """A model to sample from, which starts in the background."""
        got = self.model(self.rows(strength))
        for i in range(self.states):
            got.set("pi", i, 1 / self.mosaics if i < self.mosaics else 0.0)
        return got


@dataclass
class GappedMotif(Motif):
    """A motif with an optional place after each but the last."""

    p_gap: float = 0.35
    least_information: float = 0.5

    @property
    def places(self) -> int:
        return 2 * self.length - 1

    def place(self, k: int, reverse: bool = False) -> int:
        if not 0 <= k < self.length:
            raise IndexError("no such place")
        return self.mosaics + 2 * k + (self.places if reverse else 0)

    def gap(self, k: int, reverse: bool = False) -> int:
        if not 0 <= k < self.length - 1:
            raise IndexError("no such gap")
        return self.mosaics + 2 * k + 1 + (self.places if reverse else 0)

    def connect(self, got: States, forward: list[int], reverse: list[int]) -> None:
        n = self.length - 1
        on = got.parameter(1.0)
        gaps = [(got.parameter(self.p_gap), got.parameter(1 - self.p_gap)) for _ in range(n)]
        for strand, order in ((forward, gaps), (reverse, gaps[::-1])):
            for k, (into, past) in enumerate(order):
                got.link(strand[2 * k], strand[2 * k + 1], into)
                got.link(strand[2 * k], strand[2 * k + 2], past)
                got.link(strand[2 * k + 1], strand[2 * k + 2], on)

    def gap_probability(self, model: HiddenModel, k: int) -> float:
        return float(model.a[self.place(k), self.gap(k)])

    def gap_prior(self, k: int, strength: float, p_gap: float = 0.5) -> np.ndarray:
        """Pseudo-counts of the transitions at gap ``k`` on the forward strand."""
        a = np.zeros((self.states, self.states))
        a[self.place(k), self.gap(k)] = p_gap * strength
        a[self.place(k), self.place(k + 1)] = (1 - p_gap) * strength
        return a

    def background_prior(self, p_site: float, p_change: float) -> np.ndarray:
        """Transition probabilities from the background, to be used as pseudo-counts."""
        a, n = np.zeros((self.states, self.states)), self.mosaics
        for i in range(n):
            a[i, :n] = p_change / (n - 1) if n > 1 else 0
            a[i, self.place(0)] = a[i, self.place(0, True)] = p_site / 2
            a[i, i] = 0
            a[i, i] = 1 - a[i].sum()
        return a

    def information_per_base(self, model: HiddenModel) -> float:
        rows = self.matrix(model)
        weights = np.array([1.0 if i % 2 == 0 else self.gap_probability(model, i // 2) for i in range(self.places)])
        return float(sum(w * information_content(r[None]) for w, r in zip(weights, rows)) / weights.sum())

    def is_interesting(self, model: HiddenModel) -> bool:
        return self.information_per_base(model) > self.least_information

    def alternatives(self, model: HiddenModel) -> list[HiddenModel]:
        return []

    def rows_with_mer(self, mer: Sequence[int], strength: float = 9.0, dirichlet: float = 10.0) -> list[list[float]]:
        """Random rows with a mer laid over the middle places."""
        rows = np.array(self.rows(dirichlet))
        first = (self.length - len(mer)) // 2
        for i, x in enumerate(mer):
            rows[2 * (i + first), x] += strength
        return (rows / rows.sum(1, keepdims=True)).tolist()


@dataclass
class SingleGap:
    """A motif of ``length`` places of which one in the middle, ``gap``, may be left out."""

    length: int
    gap: int
    order: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.gap <= self.length - 2:
            raise ValueError("the gap lies inside of the motif")

    def index(self, k: int, forward: bool = True) -> int:
        return k if forward else k + self.length

    def position(self, state: int) -> tuple[int, bool]:
        return state % self.length, state < self.length

    def create(self, p_gap: float, rows: Rows) -> tuple[States, list[int], list[int]]:
        """Model, states to enter by and states to leave by; ``p_gap`` is the probability to visit the gap's place."""
        if len(rows) != self.length:
            raise ValueError(f"{self.length} rows are needed")
        got, make, n = States(4 ** (self.order + 1), self.order), Emissions(self.order), self.length
        for row in rows:
            make.symbol_state(got, None, row)
        for k in range(n):
            make.reverse_state(got, k, None)
        on, into, past = (got.parameter(p) for p in (1.0, p_gap, 1 - p_gap))
        for strand, gap in ((list(range(n)), self.gap), ([n + k for k in range(n)][::-1], n + self.gap)):
            for a, b in zip(strand, strand[1:]):
                got.link(a, b, into if b == gap else on)
            at = strand.index(gap)
            got.link(strand[at - 1], strand[at + 1], past)
        return got, [0, 2 * n - 1], [n - 1, n]

    def complete(self, p_gap: float, rows: Rows, p_site: float) -> HiddenModel:
        return with_background(*self.create(p_gap, rows), p_site)

    def emissions_and_gaps(self, model: HiddenModel, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the places and the probability to visit each."""
        visits = np.ones(self.length)
        visits[self.gap] = model.a[first + self.gap - 1, first + self.gap]
        return model.b[first : first + self.length], visits


def model_of_mer(mer: str, length: int, gap: int, p_gap: float = 0.5, p_site: float = 0.01, pseudo: float = 0.4) -> HiddenModel:
    """A start for training a single-gap motif: a mer around the gap with pseudo-counts."""
    known: list[int | None] = ["acgt".index(c) if c in "acgt" else None for c in mer.lower()]
    left = (length - 1 - len(known)) // 2
    laid = [None] * left + known + [None] * (length - 1 - len(known) - left)
    laid.insert(gap, None)
    rows = [[pseudo + (x == s) for s in range(4)] for x in laid]
    return SingleGap(length, gap).complete(p_gap, [[v / sum(r) for v in r] for r in rows], p_site)

"""Hidden Markov models with shared parameters, as arrays on the driver.

``theta`` holds the free parameters. The index arrays ``pi_at`` (N), ``a_at``
(N x N) and ``b_at`` (N x M) name the parameter of each cell; -1 means that the
cell is structurally zero. Cells may share a parameter. Each distribution (pi,
a row of A, a block of ``alphabet`` emissions with the same earlier symbols)
is scaled to sum 1, so theta itself need not be.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.order import alphabet_of


def _scaled(rows: np.ndarray) -> np.ndarray:
    total = rows.sum(axis=-1, keepdims=True)
    if (total == 0).any() or not np.isfinite(total).all():
        raise ValueError("a distribution has no weight")
    return rows / total


@dataclass
class HiddenModel:
    theta: np.ndarray
    pi_at: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    order: int = 0
    alphabet: int = field(init=False)

    def __post_init__(self) -> None:
        self.theta = np.asarray(self.theta, float).copy()
        self.pi_at, self.a_at, self.b_at = (np.asarray(x, int).copy() for x in (self.pi_at, self.a_at, self.b_at))
        n = len(self.pi_at)
        if self.a_at.shape != (n, n) or self.b_at.shape[0] != n:
            raise ValueError("the index arrays do not fit each other")
        if max(x.max(initial=-1) for x in (self.pi_at, self.a_at, self.b_at)) >= len(self.theta):
            raise ValueError("a cell names a parameter that does not exist")
        self.alphabet = alphabet_of(self.symbols, self.order)

    @property
    def states(self) -> int:
        return len(self.pi_at)

    @property
    def symbols(self) -> int:
        return self.b_at.shape[1]

    def _values(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.theta[np.maximum(at, 0)], 0.0)

    @property
    def pi(self) -> np.ndarray:
        return _scaled(self._values(self.pi_at))

    @property
    def a(self) -> np.ndarray:
        return _scaled(self._values(self.a_at))

    @property
    def b(self) -> np.ndarray:
        blocks = self._values(self.b_at).reshape(self.states, -1, self.alphabet)
        return _scaled(blocks).reshape(self.states, self.symbols)

    @property
    def b_unknown(self) -> np.ndarray:
        """Emissions with a last column of ones for the unknown symbol."""
        return np.hstack([self.b, np.ones((self.states, 1))])

    def logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logs of pi, A and B (with the unknown column); -inf for 0."""
        with np.errstate(divide="ignore"):
            return np.log(self.pi), np.log(self.a), np.log(self.b_unknown)

    def get(self, kind: str, *cell: int) -> float:
        """Probability of a cell of ``pi``, ``a`` or ``b``; an error outside of the model."""
        values = {"pi": self.pi, "a": self.a, "b": self.b}[kind]
        if len(cell) != values.ndim or any(not 0 <= i < m for i, m in zip(cell, values.shape)):
            raise IndexError(f"{kind}{cell} lies outside of the model")
        return float(values[cell])

    def set(self, kind: str, *cell_and_value: float) -> None:
        """Writes the parameter of a cell; an error if the cell has none."""
        *cell, value = cell_and_value
        p = getattr(self, f"{kind}_at")[tuple(cell)]
        if p < 0:
            raise ValueError(f"{kind}{tuple(cell)} has no parameter")
        self.theta[p] = value

    def set_emissions(self, state: int, values: np.ndarray) -> None:
        if len(values) != self.symbols:
            raise ValueError(f"a state has {self.symbols} emissions")
        for k, v in enumerate(values):
            self.set("b", state, k, v)

    def set_parameter_index(self, kind: str, *cell_and_index: int | None) -> None:
        """Lets a cell use another parameter, or none."""
        *cell, p = cell_and_index
        getattr(self, f"{kind}_at")[tuple(cell)] = -1 if p is None else p

    def normalise(self) -> None:
        """Makes theta itself normalised where no two distributions share a parameter; the probabilities stay."""
        pi, a, b = self.pi, self.a, self.b
        for at, values in ((self.b_at, b), (self.a_at, a), (self.pi_at, pi)):
            self.theta[at[at >= 0]] = values[at >= 0]

    def successors(self) -> np.ndarray:
        """Structural transitions as a boolean matrix, whatever their value."""
        return self.a_at >= 0

    def check(self, tolerance: float = 0.01) -> None:
        """An error unless all values are probabilities and all distributions sum to 1."""
        for x, sums in ((self.pi, self.pi.sum()), (self.a, self.a.sum(1)), (self.b, self.b.reshape(self.states, -1, self.alphabet).sum(2))):
            if not ((x >= 0) & (x <= 1 + tolerance)).all() or not np.allclose(sums, 1, atol=tolerance):
                raise ValueError("not a distribution")

    def copy(self) -> HiddenModel:
        return HiddenModel(self.theta, self.pi_at, self.a_at, self.b_at, self.order)

    def same_as(self, other: HiddenModel) -> bool:
        return self.order == other.order and all(np.array_equal(getattr(self, x), getattr(other, x)) for x in ("theta", "pi_at", "a_at", "b_at"))

    # ---- storage and export

    def to_json(self) -> str:
        return json.dumps({"order": self.order, **{x: getattr(self, x).tolist() for x in ("theta", "pi_at", "a_at", "b_at")}})

    @staticmethod
    def from_json(text: str) -> HiddenModel:
        got = json.loads(text)
        return HiddenModel(**{x: np.array(got[x]) for x in ("theta", "pi_at", "a_at", "b_at")}, order=got["order"])

    def save(self, path: str, binary: bool = True) -> None:
        """Writes the model as NumPy arrays, or as text."""
        if binary:
            with open(path, "wb") as f:
                np.savez(f, theta=self.theta, pi_at=self.pi_at, a_at=self.a_at, b_at=self.b_at, order=self.order)
        else:
            with open(path, "w") as f:
                f.write(self.to_json())

    @staticmethod
    def load(path: str, binary: bool = True) -> HiddenModel:
        if binary:
            with np.load(path) as x:
                return HiddenModel(x["theta"], x["pi_at"], x["a_at"], x["b_at"], int(x["order"]))
        with open(path) as f:
            return HiddenModel.from_json(f.read())

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        """Probabilities as rows: ``i, p`` of pi, ``i, j, p`` of the structural cells of A, ``i, k, p`` of B."""
        if kind == "pi":
            return spark.createDataFrame([(i, float(p)) for i, p in enumerate(self.pi)], "i int, p double")
        at, values, second = (self.a_at, self.a, "j") if kind == "a" else (self.b_at, self.b, "k")
        rows = [(int(i), int(j), float(values[i, j])) for i, j in zip(*np.nonzero(at >= 0))]
        return spark.createDataFrame(rows, f"i int, {second} int, p double")

    def edges(self, spark: SparkSession) -> DataFrame:
        """Transitions with p > 0 as ``src, dst, p``, parallel ones added."""
        from pyspark.sql import functions as F

        return self.table(spark, "a").where("p > 0").groupBy(F.col("i").alias("src"), F.col("j").alias("dst")).agg(F.sum("p").alias("p"))


@dataclass
class Prior:
    """Pseudo-counts for pi (N), A (N x N) and B (N x M)."""

    pi: np.ndarray
    a: np.ndarray
    b: np.ndarray

    @staticmethod
    def none(model: HiddenModel) -> Prior:
        return Prior(np.zeros(model.states), np.zeros((model.states,) * 2), np.zeros((model.states, model.symbols)))

    @staticmethod
    def around(model: HiddenModel, strength: float) -> Prior:
        """Pseudo-counts in proportion to a model's probabilities."""
        return Prior(strength * model.pi, strength * model.a, strength * model.b)

    def check(self, model: HiddenModel) -> None:
        if self.pi.shape != (model.states,) or self.a.shape != model.a_at.shape or self.b.shape != model.b_at.shape:
            raise ValueError("the prior does not fit the model")


class States:
    """A model put together state by state; states are numbered as they are added."""

    def __init__(self, symbols: int, order: int = 0) -> None:
        self.symbols, self.order = symbols, order
        self.theta: list[float] = []
        self.pi: list[int] = []
        self.b: list[list[int]] = []
        self.links: list[dict[int, int]] = []

    def parameter(self, value: float) -> int:
        self.theta.append(float(value))
        return len(self.theta) - 1

    def state(self, pi: int | None = None, emissions: list[int] | None = None) -> int:
        """Adds a state by the indexes of its parameters."""
        self.pi.append(-1 if pi is None else pi)
        self.b.append(list(emissions) if emissions is not None else [-1] * self.symbols)
        if len(self.b[-1]) != self.symbols:
            raise ValueError(f"a state has {self.symbols} emissions")
        self.links.append({})
        return len(self.pi) - 1

    def link(self, state: int, successor: int, parameter: int) -> None:
        if not 0 <= successor < len(self.pi):
            raise ValueError("no such state")
        self.links[state][successor] = parameter

    def predecessors(self) -> list[list[int]]:
        return [[i for i, x in enumerate(self.links) if j in x] for j in range(len(self.pi))]

    def model(self) -> HiddenModel:
        n = len(self.pi)
        a = np.full((n, n), -1)
        for i, x in enumerate(self.links):
            for j, p in x.items():
                a[i, j] = p
        return HiddenModel(np.array(self.theta), np.array(self.pi), a, np.array(self.b), self.order)

    @staticmethod
    def of(model: HiddenModel) -> States:
        got = States(model.symbols, model.order)
        got.theta = model.theta.tolist()
        for i in range(model.states):
            got.state(int(model.pi_at[i]), model.b_at[i].tolist())
        for i, j in zip(*np.nonzero(model.a_at >= 0)):
            got.link(int(i), int(j), int(model.a_at[i, j]))
        return got


def as_model(x: HiddenModel | States) -> HiddenModel:
    return x if isinstance(x, HiddenModel) else x.model()


def as_states(x: HiddenModel | States) -> States:
    return x if isinstance(x, States) else States.of(x)


def dense(pi: np.ndarray, a: np.ndarray, b: np.ndarray, order: int = 0) -> HiddenModel:
    """A model with a parameter of its own for each cell."""
    pi, a, b = (np.asarray(x, float) for x in (pi, a, b))
    n, m = b.shape
    theta = np.concatenate([pi, a.ravel(), b.ravel()])
    return HiddenModel(theta, np.arange(n), n + np.arange(n * n).reshape(n, n), n + n * n + np.arange(n * m).reshape(n, m), order)


def random_dense(states: int, symbols: int, order: int = 0, seed: int = 0) -> HiddenModel:
    """A fully connected model with Dirichlet(1) draws."""
    rng = np.random.default_rng(seed)
    k = alphabet_of(symbols, order)
    draw = lambda n, m: rng.dirichlet(np.ones(m), n)
    return dense(draw(1, states)[0], draw(states, states), draw(states * (symbols // k), k).reshape(states, symbols), order)


def sum_parameters(theta: np.ndarray, at: np.ndarray) -> float:
    return float(theta[at[at >= 0]].sum())


def normalise_parameters(theta: np.ndarray, at: np.ndarray) -> None:
    """Scales the named parameters to sum 1 in place; uniform if they sum to 0."""
    at = at[at >= 0]
    total = theta[at].sum()
    theta[at] = theta[at] / total if total > 0 else 1 / len(at)

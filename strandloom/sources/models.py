"""Models as text, and a cache of background models by order, states and dataset."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np

from ..models.hidden import HiddenModel, dense


def read_text(lines: Iterable[str], order: int = 0) -> HiddenModel:
    """A model of lines ``MODEL:N,M``, ``TRANSITION:i;j;p`` and ``EMISSIONS:i;b1,...,bM``.

    ``#`` begins a comment; every state starts with the same probability. Other
    lines are an error.
    """
    pi = a = b = None
    for raw in lines:
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        kind, _, rest = line.partition(":")
        if kind == "MODEL":
            n, m = (int(x) for x in rest.split(","))
            pi, a, b = np.full(n, 1 / n), np.zeros((n, n)), np.zeros((n, m))
        elif kind == "TRANSITION" and a is not None:
            i, j, p = rest.split(";")
            a[int(i), int(j)] = float(p)
        elif kind == "EMISSIONS" and b is not None:
            i, values = rest.split(";")
            b[int(i)] = [float(x) for x in values.split(",")]
        else:
            raise ValueError(f"not a line of a model: {raw.strip()!r}")
    if pi is None:
        raise ValueError("no model")
    got = dense(pi, a, b, order)
    got.a_at = np.where(a > 0, got.a_at, -1)
    return got


def text_lines(model: HiddenModel, keep: Callable[[int], bool] = lambda s: True) -> list[str]:
    """The model in the same format; states that are not kept are left out and the others renumbered."""
    states = [s for s in range(model.states) if keep(s)]
    number = {s: i for i, s in enumerate(states)}
    a, b = model.a, model.b
    lines = [f"MODEL:{len(states)},{model.symbols}"]
    lines += [f"TRANSITION:{number[i]};{number[j]};{a[i, j]!r}".replace("np.float64(", "").replace(")", "") for i in states for j in states if model.a_at[i, j] >= 0]
    return lines + [f"EMISSIONS:{number[i]};" + ",".join(repr(float(x)) for x in b[i]) for i in states]


class BackgroundModels:
    """Models kept in memory and in a folder, made by ``train(order, mosaics, dataset)`` when missing."""

    def __init__(self, folder: str, train: Callable[[int, int, str], HiddenModel]) -> None:
        self.folder, self.train, self.known = Path(folder), train, {}

    def get(self, order: int, mosaics: int, dataset: str) -> HiddenModel:
        key = (order, mosaics, dataset)
        if key not in self.known:
            path = self.folder / f"{dataset}-{order}-{mosaics}.json"
            if path.exists():
                self.known[key] = HiddenModel.from_json(path.read_text())
            else:
                self.known[key] = self.train(*key)
                os.makedirs(self.folder, exist_ok=True)
                path.write_text(self.known[key].to_json())
        return self.known[key]

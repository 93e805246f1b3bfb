"""Training of hidden Markov models: one Spark job for each iteration.

The E-step walks every sequence on the executors and sends one row of partial
sums for each task (N + N*N + N*M numbers, whatever the number of sequences);
Spark adds them up cell by cell. The M-step on the driver divides sums by sums
within each distribution, for all cells that share a parameter together.

Empty sequences add nothing. A sequence that the model cannot produce is left
out of the sums and makes the log-likelihood -inf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.hidden import HiddenModel, Prior
from . import infer, loops

CELLS = "part string, cell int, value double"

#: Tasks up to which each one's sums go straight to the driver.
MOST_TASKS = 1000


@dataclass
class Sums:
    """Expected (or hard) counts of starts, transitions and emissions, the objective, and sequences left out."""

    pi: np.ndarray
    a: np.ndarray
    b: np.ndarray
    ll: float
    impossible: int


def _in_steps(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many sequences reach each time step, and the codes step by step, those of the longest sequence first.

    So the sequences inside at a step are always the first ones, and nothing is filled up.
    """
    order = np.argsort(-sizes, kind="stable")
    sizes, codes = sizes[order], codes[order].T
    return np.searchsorted(-sizes, -np.arange(len(codes))), codes[np.arange(len(codes))[:, None] < sizes[None]]


def _expected(model: HiddenModel, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Expected counts of the sequences of ``_in_steps``, all of a step at once; only alpha is kept."""
    n, m = model.states, model.symbols
    pi, a, emit = model.pi, model.a, np.ascontiguousarray(model.b_unknown)
    ends = np.cumsum(counts).tolist()
    steps = list(zip([0, *ends], ends))
    alpha, sums = np.empty((n, len(codes))), np.empty(len(codes))
    for t, (i, j) in enumerate(steps):
        into = emit.take(codes[i:j], axis=1, mode="clip")
        into *= pi[:, None] if t == 0 else a.T @ alpha[:, steps[t - 1][0] : steps[t - 1][0] + j - i]
        total = into.sum(0, out=sums[i:j])
        np.divide(into, np.where(total > 0, total, 1), out=alpha[:, i:j])
    if len(codes) and not (sums > 0).all():  # a sequence that the model cannot produce has no weight left at its end
        row = np.concatenate([np.arange(j - i) for i, j in steps])
        good = np.ones(counts[0], bool)
        good[row[~(sums > 0)]] = False
        kept = good[row]
        *rest, _, _ = _expected(model, np.array([good[: j - i].sum() for i, j in steps]), codes[kept])
        return *rest, -np.inf, int((~good).sum())
    moved, beta = np.zeros((n, n)), np.empty((n, 0))
    for t in range(len(steps) - 1, -1, -1):
        (i, j), on = steps[t], beta.shape[1]
        here = np.empty((n, j - i))
        here[:, on:] = 1
        if on:
            ahead = slice(*steps[t + 1])
            beta *= emit.take(codes[ahead], axis=1, mode="clip")
            beta /= sums[ahead]
            moved += alpha[:, i : i + on] @ beta.T
            np.matmul(a, beta, out=here[:, :on])
        alpha[:, i:j] *= here
        beta = here
    first = alpha[:, : steps[0][1]].sum(1) if steps else np.zeros(n)
    b = np.array([np.bincount(codes, x, m + 1)[:m] for x in alpha])
    return first, moved * a, b, float(np.log(sums).sum()), 0


def _hard(model: HiddenModel, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    n, m = model.states, model.symbols
    scores, paths = infer.viterbi_batch(model, codes, sizes)
    pi, a, b = np.zeros(n), np.zeros((n, n)), np.zeros((n, m))
    held = [(np.array(path), codes[r, : len(path)]) for r, path in enumerate(paths) if path]
    if held:
        q, o = (np.concatenate(x) for x in zip(*held))
        first = np.cumsum([0, *[len(x) for x, _ in held[:-1]]])
        inner = np.ones(len(q), bool)
        inner[first] = False
        later = np.flatnonzero(inner)
        known = o < m
        pi = np.bincount(q[first], minlength=n).astype(float)
        a = np.bincount(q[later - 1] * n + q[later], minlength=n * n).reshape(n, n).astype(float)
        b = np.bincount(q[known] * m + o[known], minlength=n * m).reshape(n, m).astype(float)
    return pi, a, b, float(scores[sizes >= 0].sum()), sum(p is None and s > 0 for p, s in zip(paths, sizes))


def packed(sequences: DataFrame, model: HiddenModel) -> DataFrame:
    """``counts, codes``: groups of sequences of similar length as ``_in_steps`` has them, in one byte for each code of a small alphabet.

    A group holds so many sequences that NumPy's calls do not count, and so few that its alpha, or its window texts and weights, have 48 MB at most.
    """
    kind = np.uint8 if model.symbols < 256 else np.int32
    states = model.states if loops.loops_of(model) is None else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in infer._batches(batch.column(0), cells=6_000_000, states=states):
                counts, codes = _in_steps(*infer.padded(batch.column(0).take(pa.array(rows)), model.symbols))
                if len(codes):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (counts.astype(np.int32), codes.astype(kind))], ["counts", "codes"])

    return infer.integral(sequences).select("obs").mapInArrow(run, "counts binary, codes binary")


def held(sequences: DataFrame, model: HiddenModel) -> DataFrame:
    """``packed``, cached for many iterations. The sequences are spread evenly, as an iteration waits for its longest task.

    There are as many tasks as cores, as each has its costs in every iteration; of large tables a multiple, a quarter of ``spark.sql.shuffle.partitions``.
    """
    spark = sequences.sparkSession
    cores = spark.sparkContext.defaultParallelism
    tasks = cores * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // (4 * cores))
    return packed(infer.integral(sequences).select("obs").repartition(tasks), model).cache()


def _added(model: HiddenModel, parts: Iterator[tuple]) -> pa.RecordBatch:
    """``part, cell, value``: the sums of a task."""
    total = {"pi": np.zeros(model.states), "a": np.zeros(model.states**2), "b": np.zeros(model.states * model.symbols), "ll": np.zeros(1), "bad": np.zeros(1)}
    for part in parts:
        for key, x in zip(total, part):
            total[key] += np.ravel(x)
    cells = [(k, i, float(v)) for k, x in total.items() for i, v in enumerate(x) if v != 0]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells) if cells else [(), (), ()], (pa.string(), pa.int32(), pa.float64()))], ["part", "cell", "value"])


def _packed_parts(model: HiddenModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """Gives the sums of ``packed`` sequences, part by part; those of motifs around one background state by windows."""
    kind = np.uint8 if model.symbols < 256 else np.int32
    around = loops.loops_of(model)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        windows = None if around is None else loops.Windows(model, around)
        if windows is not None and not windows.usable:
            windows = None
        for batch in batches:
            for group in zip(*batch.columns):
                counts, codes = (np.frombuffer(x.as_buffer(), t) for x, t in zip(group, (np.int32, kind)))
                if windows is None or not windows.add(counts, codes):
                    yield _expected(model, counts, codes)
        if windows is not None:
            yield windows.sums()

    return parts


def packed_sums(groups: DataFrame, model: HiddenModel) -> DataFrame:
    """``partial_sums`` of the expected counts, over ``packed`` sequences."""
    parts = _packed_parts(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _added(model, parts(batches))

    return groups.mapInArrow(run, CELLS).groupBy("part", "cell").agg(F.sum("value").alias("value"))


def packed_totals(groups: DataFrame, model: HiddenModel) -> Sums:
    """The E-step over sequences that are ``held``. Few tasks send their sums as one row each, which needs no second stage."""
    spark = groups.sparkSession
    if max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) > MOST_TASKS:
        return _collected(packed_sums(groups, model), model)
    n, m, parts = model.states, model.symbols, _packed_parts(model)
    cuts = np.cumsum([n, n * n, n * m, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cuts[-1] + 1)
        for part in parts(batches):
            total += np.concatenate([np.ravel(x) for x in part])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    rows = groups.mapInArrow(run, "sums binary").collect()  # one for each task
    pi, a, b, ll, bad = np.split(sum((np.frombuffer(r["sums"]) for r in rows), np.zeros(cuts[-1] + 1)), cuts)
    return Sums(pi, a.reshape(n, n), b.reshape(n, m), float(ll[0]), int(bad[0]))


def partial_sums(sequences: DataFrame, model: HiddenModel, hard: bool = False) -> DataFrame:
    """``part, cell, value``: sums over all sequences of starts (``pi``), transitions (``a``), emissions (``b``), objective (``ll``) and sequences left out (``bad``)."""
    if not hard:
        return packed_sums(packed(sequences, model), model)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for rows in infer._batches(batch.column(0), states=4 * model.states):
                yield _hard(model, *infer.padded(batch.column(0).take(pa.array(rows)), model.symbols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _added(model, parts(batches))

    return infer.integral(sequences).select("obs").mapInArrow(run, CELLS).groupBy("part", "cell").agg(F.sum("value").alias("value"))


def estimate(sequences: DataFrame, model: HiddenModel, hard: bool = False) -> Sums:
    """The E-step (or counts along the best paths)."""
    return _collected(partial_sums(sequences, model, hard), model)


def _collected(sums: DataFrame, model: HiddenModel) -> Sums:
    n, m = model.states, model.symbols
    got = {k: np.zeros(s) for k, s in (("pi", n), ("a", n * n), ("b", n * m), ("ll", 1), ("bad", 1))}
    for r in sums.collect():  # at most one row for each cell of the model
        got[r["part"]][r["cell"]] = r["value"]
    return Sums(got["pi"], got["a"].reshape(n, n), got["b"].reshape(n, m), float(got["ll"][0]), int(got["bad"][0]))


def maximise(model: HiddenModel, sums: Sums, prior: Prior | None = None) -> HiddenModel:
    """The M-step: each parameter is the sum over its cells by the sum over their distributions.

    A parameter whose distributions have no counts keeps its value.
    """
    prior = prior or Prior.none(model)
    prior.check(model)
    num, den = np.zeros(len(model.theta)), np.zeros(len(model.theta))
    blocks = (model.states * (model.symbols // model.alphabet), model.alphabet)
    for at, counts in (
        (model.pi_at[None], (prior.pi + sums.pi)[None]),
        (model.a_at, prior.a + sums.a),
        (model.b_at.reshape(blocks), (prior.b + sums.b).reshape(blocks)),
    ):
        counts = np.where(at >= 0, counts, 0)
        totals = np.broadcast_to(counts.sum(1, keepdims=True), counts.shape)
        np.add.at(num, at[at >= 0], counts[at >= 0])
        np.add.at(den, at[at >= 0], totals[at >= 0])
    got = model.copy()
    got.theta = np.where(den > 0, num / np.where(den > 0, den, 1), model.theta)
    return got


def iterate(sequences: DataFrame, model: HiddenModel, prior: Prior | None = None, hard: bool = False) -> tuple[HiddenModel, float]:
    """One iteration: the new model and the objective of the old one."""
    sums = estimate(sequences, model, hard)
    return maximise(model, sums, prior), sums.ll


def train(
    sequences: DataFrame, model: HiddenModel, prior: Prior | None = None, hard: bool = False, most: int = 0, tolerance: float = 1e-5, each: Callable[[int, float], bool | None] | None = None
) -> tuple[HiddenModel, list[float]]:
    """Iterates until the objective changes by ``tolerance`` at most; the model and the objectives, each from before its update.

    ``most`` caps the iterations (0: no cap). ``each`` is called with the
    number of iterations and the objective and stops the training with False.
    The sequences are cached for the time of the training, packed for the
    E-step. Those that come from ``packed`` stay as they are.
    """
    ready = sequences.columns == ["counts", "codes"]
    rows = sequences if ready else infer.integral(sequences).select("obs").cache() if hard else held(sequences, model)
    history: list[float] = []
    try:
        while True:
            sums = _collected(partial_sums(rows, model, hard), model) if hard else packed_totals(rows, model)
            model, ll = maximise(model, sums, prior), sums.ll
            history.append(ll)
            if most and len(history) >= most or each and each(len(history), ll) is False:
                break
            if len(history) > 1 and abs(history[-1] - history[-2]) <= tolerance:
                break
    finally:
        if not ready:
            rows.unpersist()
    return model, history


def levelled(history: list[float], tolerance: float) -> bool:
    """Six values at least, the last step within the tolerance and the last five steps not growing."""
    if len(history) < 6:
        return False
    steps = np.diff(history[-6:])
    return bool(abs(steps[-1]) <= tolerance and (np.diff(steps) <= 0).all())


def history_rows(sequences: DataFrame, histories: list[list[float]]) -> DataFrame:
    """Objectives of several runs as ``run, iteration, ll``."""
    rows = [(r, i, float(x)) for r, h in enumerate(histories) for i, x in enumerate(h)]
    return sequences.sparkSession.createDataFrame(rows, "run int, iteration int, ll double")


def fold_of(index, folds: int):  # noqa: ANN001, ANN201
    """Fold of a row number."""
    return F.pmod(index, F.lit(folds))


def per_known(sequences: DataFrame, model: HiddenModel, tolerance: float = 1e-4) -> float:
    """A tolerance for each known symbol as one for all sequences."""
    known = F.size(F.filter("obs", lambda x: x < model.symbols))
    return tolerance * (sequences.where("obs is not null").agg(F.sum(known)).first()[0] or 0)  # one row


def cross_validated(sequences: DataFrame, model: HiddenModel, folds: int, most: int = 3, prior: Prior | None = None, tolerance: float | None = None) -> DataFrame:
    """``fold, ll, n_known, ll_per_known`` of each fold (``seq_id`` modulo ``folds``) under a model trained on the others.

    ``tolerance`` is that of ``train`` for each known symbol; without it, its own default holds.
    """
    held = infer.integral(sequences).select("seq_id", "obs").cache()  # for the time of the training
    parts = []
    try:
        for k in range(folds):
            own = fold_of(F.col("seq_id"), folds) == k
            rest = held.where(~own)
            bound = {} if tolerance is None else {"tolerance": per_known(rest, model, tolerance)}
            trained, _ = train(rest, model, prior, most=most, **bound)
            parts.append(infer.total_log_likelihood(sequences.where(own), trained).withColumn("fold", F.lit(k)))
    finally:
        held.unpersist()
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    return got.select("fold", "ll", "n_known", "ll_per_known")


def log_parameters(model: HiddenModel) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(model.theta)


def with_log_parameters(model: HiddenModel, values: np.ndarray) -> HiddenModel:
    got = model.copy()
    got.theta = np.exp(values)
    return got


def optimise(sequences: DataFrame, model: HiddenModel, which: list[int], steps: int = 60, size: float = 0.5) -> tuple[HiddenModel, float]:
    """Maximises the log-likelihood over chosen parameters in logit space, by a simplex search on the driver.

    Every evaluation is one distributed job; a model without a finite
    likelihood counts as -1e300.
    """
    logit = lambda p: np.log(p / (1 - p))
    at = np.array(which)

    def placed(x: np.ndarray) -> HiddenModel:
        got = model.copy()
        got.theta[at] = 1 / (1 + np.exp(-np.clip(x, -36, 36)))
        return got

    held = infer.integral(sequences).select("seq_id", "obs").cache()

    def cost(x: np.ndarray) -> float:
        ll = infer.total_log_likelihood(held, placed(x)).first()["ll"]
        return -ll if ll is not None and np.isfinite(ll) else 1e300

    start = logit(np.clip(model.theta[at], 1e-6, 1 - 1e-6))
    points = [start] + [start + size * np.eye(len(at))[i] for i in range(len(at))]
    values = [cost(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < 1e-6:
            break
        centre = np.mean(points[:-1], axis=0)
        tried = centre + (centre - points[-1])
        v = cost(tried)
        if v < values[0]:
            further = centre + 2 * (centre - points[-1])
            w = cost(further)
            points[-1], values[-1] = (further, w) if w < v else (tried, v)
        elif v < values[-2]:
            points[-1], values[-1] = tried, v
        else:
            nearer = centre + 0.5 * (points[-1] - centre)
            w = cost(nearer)
            if w < values[-1]:
                points[-1], values[-1] = nearer, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [cost(p) for p in points[1:]]
    held.unpersist()
    best = int(np.argmin(values))
    return placed(points[best]), -values[best]

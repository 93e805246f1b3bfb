"""Likelihoods, posteriors and best paths of sequences under a hidden Markov model.

Sequences are rows ``seq_id, obs`` (codes 0 .. M-1, M = unknown). The model
travels to the executors: as literals of a native fold for the likelihood under
few states, in the closure of an Arrow function otherwise. There a batch of
sequences is walked through time step by step with all its rows at once.

An empty sequence has log-likelihood 0 and an empty path. A sequence that the
model cannot produce has log-likelihood -inf and no path (null). Null codes and
codes beyond M are refused. A null sequence gives nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..models.hidden import HiddenModel

#: States up to which the likelihood is a native fold.
FOLD_STATES = 8


def integral(sequences: DataFrame, column: str = "obs") -> DataFrame:
    """The sequences with codes as INT; an error if the codes are no whole numbers."""
    kind = sequences.schema[column].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{column} is {kind.simpleString()}, not an array of whole numbers")
    return sequences.withColumn(column, F.col(column).cast("array<int>"))


def log_likelihood(obs: Column, model: HiddenModel) -> Column:
    """Forward log-likelihood as a fold over the array, scaled at every step."""
    pi, a, b = model.pi, model.a, model.b_unknown
    n = model.states
    emit = [F.array(*[F.lit(float(x)) for x in row]) for row in b]

    def scaled(raw: list[Column], ll: Column) -> Column:
        """Struct of the scaled probabilities and the sum of logs; ``raw`` is bound once."""

        def close(r: Column) -> Column:
            total = sum((r[i] for i in range(1, n)), r[0])
            alpha = F.transform(r, lambda x: F.when(total > 0, x / total).otherwise(0.0))
            return F.struct(alpha.alias("alpha"), (ll + F.when(total > 0, F.log(F.when(total > 0, total))).otherwise(F.lit(float("-inf")))).alias("ll"))

        return F.transform(F.array(F.array(*raw)), close)[0]

    first = F.element_at(obs, 1)
    start = scaled([F.lit(float(pi[i])) * F.get(emit[i], first) for i in range(n)], F.lit(0.0))

    def step(acc: Column, x: Column) -> Column:
        raw = []
        for j in range(n):
            terms = [acc["alpha"][i] * float(a[i, j]) for i in range(n) if a[i, j] > 0]
            raw.append(sum(terms[1:], terms[0]) * F.get(emit[j], x) if terms else F.lit(0.0))
        return scaled(raw, acc["ll"])

    return F.when(F.size(obs) == 0, 0.0).when(F.size(obs) > 0, F.aggregate(F.slice(obs, 2, F.size(obs)), start, step, lambda s: s["ll"]))


def log_likelihoods(sequences: DataFrame, model: HiddenModel) -> DataFrame:
    """``seq_id, ll``; a native fold under few states, else an Arrow function that keeps one time step."""
    if model.states <= FOLD_STATES:
        return integral(sequences).select("seq_id", log_likelihood(F.col("obs"), model).alias("ll"))
    return _scored(sequences, model, forward_ll_batch)


def total_log_likelihood(sequences: DataFrame, model: HiddenModel) -> DataFrame:
    """One row ``ll, n_known, ll_per_known``: the collection's log-likelihood, also for each known symbol."""
    known = F.size(F.filter("obs", lambda x: x < model.symbols))
    if model.states <= FOLD_STATES:
        lls = sequences.select(log_likelihood(F.col("obs"), model).alias("ll"), known.alias("known"))
    else:  # the count travels beside its sequence, so that it is read once
        lls = _scored(sequences.select(known.alias("seq_id"), "obs"), model, forward_ll_batch).select("ll", F.col("seq_id").alias("known"))
    return lls.agg(F.sum("ll").alias("ll"), F.sum("known").cast("bigint").alias("n_known")).withColumn("ll_per_known", F.try_divide("ll", "n_known"))


# ---- Arrow kernels


def padded(lists: pa.ListArray, unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes as a matrix (row, time), filled up with unknowns, and the lengths; -1 for null lists."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and (np.isnan(flat.astype(float)).any() or flat.min() < 0 or flat.max() > unknown):
        raise ValueError("a code lies outside of the model")
    sizes = np.array([-1 if x is None else x for x in pc.list_value_length(lists).to_pylist()], int)
    width = max(0, sizes.max(initial=0))
    codes = np.full((len(sizes), width), unknown)
    codes[np.arange(width)[None, :] < sizes[:, None]] = flat
    return codes, sizes


def forward_batch(model: HiddenModel, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled alpha (row, time, state) and sums s (row, time), 1 behind a sequence's end."""
    pi, a, emit = model.pi, model.a, model.b_unknown.T
    rows, width = codes.shape
    alpha, sums = np.zeros((rows, width, model.states)), np.ones((rows, width))
    for t in range(width):
        raw = (pi[None] if t == 0 else alpha[:, t - 1] @ a) * emit[codes[:, t]]
        inside = sizes > t
        total = raw.sum(1)
        sums[:, t] = np.where(inside, total, 1.0)
        alpha[:, t] = np.where(inside[:, None], raw / np.where(total > 0, total, 1)[:, None], 0)
    return alpha, sums


def forward_ll_batch(model: HiddenModel, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log-likelihoods by the forward recursion; only one time step is kept."""
    pi, a, emit = model.pi, model.a, model.b_unknown.T
    ll, alpha = np.zeros(len(codes)), None
    for t in range(codes.shape[1]):
        raw = (pi[None] if alpha is None else alpha @ a) * emit[codes[:, t]]
        total = raw.sum(1)
        with np.errstate(divide="ignore"):
            ll += np.where(sizes > t, np.log(total), 0.0)
        alpha = raw / np.where(total > 0, total, 1)[:, None]
    return ll


def backward_ll_batch(model: HiddenModel, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log-likelihoods by the backward recursion alone, scaled by its own sums; only one time step is kept."""
    pi, a, emit = model.pi, model.a, model.b_unknown.T
    ll, beta = np.zeros(len(codes)), np.ones((len(codes), model.states))
    for t in range(codes.shape[1] - 1, -1, -1):
        ahead = emit[codes[:, t]] * beta
        before = ahead @ (pi[:, None] if t == 0 else a.T)
        total = before.sum(1)
        inside = sizes > t
        with np.errstate(divide="ignore"):
            ll += np.where(inside, np.log(total), 0.0)
        if t:
            beta = np.where(inside[:, None], before / np.where(total > 0, total, 1)[:, None], 1.0)
    return ll


def backward_batch(model: HiddenModel, codes: np.ndarray, sizes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """beta scaled by the forward sums, so that alpha * beta is the posterior."""
    a, emit = model.a, model.b_unknown.T
    rows, width = codes.shape
    beta = np.zeros((rows, width, model.states))
    for t in range(width - 1, -1, -1):
        last = sizes == t + 1
        if t + 1 < width:
            s = np.where(sums[:, t + 1] > 0, sums[:, t + 1], 1)[:, None]
            beta[:, t] = (emit[codes[:, t + 1]] * beta[:, t + 1]) @ a.T / s
        beta[last, t] = 1.0
    return beta


def viterbi_states(model: HiddenModel, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities, and the states of the best paths as a matrix (row, time) that holds each row up to its end.

    Of equal predecessors the highest counts, of equal last states the lowest.
    Only structural predecessors are compared: the k-th of all states at once.
    """
    log_pi, log_a, log_b = model.logs()
    rows, width = codes.shape
    n = model.states
    before = [np.flatnonzero(x) for x in (model.a_at >= 0).T]
    ways = []
    for k in range(max(map(len, before), default=0)):
        src = np.array([x[k] if k < len(x) else 0 for x in before])
        ways.append((src, np.array([log_a[i, j] if k < len(x) else -np.inf for j, (i, x) in enumerate(zip(src, before))])[:, None]))
    back = np.zeros((width, n, rows), np.min_scalar_type(n))
    scores, states = np.zeros(rows), np.zeros((width, rows), np.int32)
    phi = np.full((n, rows), -np.inf)
    for t in range(width):
        if t == 0:
            phi = log_pi[:, None] + log_b.take(codes[:, 0], axis=1)
        else:
            best = np.full((n, rows), -np.inf)
            for src, weight in ways:
                way = phi.take(src, axis=0)
                way += weight
                np.copyto(back[t], src[:, None], where=way >= best, casting="unsafe")
                np.maximum(best, way, out=best)
            best += log_b.take(codes[:, t], axis=1)
            phi = best
        ends = np.flatnonzero(sizes == t + 1)
        if len(ends):
            last = phi[:, ends]
            scores[ends], states[t, ends] = last.max(0), last.argmax(0)
    every = np.arange(rows)
    for t in range(width - 1, 0, -1):
        came = back[t, states[t], every]
        states[t - 1] = np.where(sizes > t, came, states[t - 1])
    return scores, states.T


def viterbi_batch(model: HiddenModel, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[list[int] | None]]:
    """Log-probabilities and states of the best paths; none for null rows and those that the model cannot produce."""
    scores, states = viterbi_states(model, codes, sizes)
    return scores, [x[:n].tolist() if ok else None for x, n, ok in zip(states, sizes, _possible(scores, sizes))]


def _possible(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return (sizes == 0) | (sizes > 0) & np.isfinite(scores)


def _batches(lists: pa.ListArray, cells: int = 2_000_000, states: int = 1) -> Iterator[np.ndarray]:
    """Row numbers in groups of similar length with a bounded number of cells."""
    sizes = np.array([x or 0 for x in pc.list_value_length(lists).to_pylist()], int)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * (sizes[order[to]] + 1) * states <= cells:
            to += 1
        yield order[at:to]
        at = to


def _scored(sequences: DataFrame, model: HiddenModel, kernel: Callable[[HiddenModel, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``seq_id, ll`` by a kernel over batches of codes."""
    kind = sequences.schema["seq_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _batches(batch.column(1)):
                part = batch.take(pa.array(rows))
                codes, sizes = padded(part.column(1), model.symbols)
                ll = kernel(model, codes, sizes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ll, pa.float64(), mask=sizes < 0)], ["seq_id", "ll"])

    return integral(sequences).select("seq_id", "obs").mapInArrow(run, f"seq_id {kind}, ll double")


def best_paths(sequences: DataFrame, model: HiddenModel) -> DataFrame:
    """``seq_id, log_p, path``."""
    kind = dict(sequences.dtypes)["seq_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _batches(batch.column(1), states=model.states):
                part = batch.take(pa.array(rows))
                codes, sizes = padded(part.column(1), model.symbols)
                scores, states = viterbi_states(model, codes, sizes)
                good = _possible(scores, sizes)
                lengths = np.where(good, sizes, 0)
                flat = states[np.arange(states.shape[1])[None] < lengths[:, None]]
                paths = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(~good))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64(), mask=sizes < 0), paths], ["seq_id", "log_p", "path"])

    return integral(sequences).select("seq_id", "obs").mapInArrow(run, f"seq_id {kind}, log_p double, path array<int>")


def trellis(sequences: DataFrame, model: HiddenModel) -> DataFrame:
    """``seq_id, ll, alpha, beta, gamma, sums``: scaled forward and backward values, posteriors and scale sums, as arrays over time (and state)."""
    kind = dict(sequences.dtypes)["seq_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _batches(batch.column(1), states=3 * model.states):
                part = batch.take(pa.array(rows))
                codes, sizes = padded(part.column(1), model.symbols)
                alpha, sums = forward_batch(model, codes, sizes)
                beta = backward_batch(model, codes, sizes, sums)
                with np.errstate(divide="ignore"):
                    ll = np.log(sums).sum(1)
                cut = lambda x: [x[r, : max(n, 0)].tolist() if n >= 0 else None for r, n in enumerate(sizes)]  # noqa: E731,B023
                lists = pa.list_(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([None if n < 0 else float(x) for x, n in zip(ll, sizes)], pa.float64()), pa.array(cut(alpha), lists), pa.array(cut(beta), lists), pa.array(cut(alpha * beta), lists), pa.array(cut(sums), pa.list_(pa.float64()))],
                    ["seq_id", "ll", "alpha", "beta", "gamma", "sums"],
                )

    wide = "array<array<double>>"
    return integral(sequences).select("seq_id", "obs").mapInArrow(run, f"seq_id {kind}, ll double, alpha {wide}, beta {wide}, gamma {wide}, sums array<double>")


def posteriors(sequences: DataFrame, model: HiddenModel) -> DataFrame:
    """``seq_id, t, i, gamma``: probability of state i at place t."""
    rows = trellis(sequences, model).select("seq_id", F.posexplode("gamma").alias("t", "g"))
    return rows.select("seq_id", "t", F.posexplode("g").alias("i", "gamma"))


def backward_log_likelihood(sequences: DataFrame, model: HiddenModel) -> DataFrame:
    """``seq_id, ll`` from the backward values alone; one row for each row, whatever its id."""
    return _scored(sequences, model, backward_ll_batch)


def consistent(sequences: DataFrame, model: HiddenModel, tolerance: float = 1e-6) -> DataFrame:
    """``seq_id, ok``: whether forward and backward values agree at every place, that is, the posteriors sum to 1."""
    sums = F.transform("gamma", lambda g: F.aggregate(g, F.lit(0.0), lambda s, x: s + x))
    return trellis(sequences, model).select("seq_id", F.forall(sums, lambda s: F.abs(s - 1) <= tolerance).alias("ok"))


def indicators(path: Column, background: list[int]) -> Column:
    """1 where a path is outside of the background states, else 0."""
    return F.transform(path, lambda s: (~s.isin(background)).cast("int"))


def sample(wanted: DataFrame, model: HiddenModel, seed: int) -> DataFrame:
    """``seq_id, states, symbols``: a sequence drawn from a model for each row ``seq_id, length``.

    The uniforms depend on seed, sequence and place alone, not on partitions. A
    null or negative length counts as 0.

    Under order m the context of a symbol is the m symbols drawn before it;
    before there are so many, the missing ones count as symbol 0.
    """
    from ..functions.symbols import uniform

    k, contexts = model.alphabet, model.symbols // model.alphabet
    cum_pi = np.cumsum(model.pi)
    cum_a = np.cumsum(model.a, axis=1)
    cum_b = np.cumsum(model.b.reshape(model.states, contexts, k), axis=2)

    def pick(cum: Column, u: Column, size: int) -> Column:
        below = F.size(F.filter(cum, lambda c: c <= u))
        return F.least(below, F.lit(size - 1))

    numbers = lambda x: F.array(*[numbers(y) if isinstance(y, list) else F.lit(float(y)) for y in x])
    starts, moves, emits = numbers(cum_pi.tolist()), numbers(cum_a.tolist()), numbers(cum_b.tolist())
    u = lambda what, t: uniform(seed, F.col("seq_id"), F.lit(what), t)

    def step(acc: Column, t: Column) -> Column:
        q = F.when(t == 0, pick(starts, u("q", t), model.states)).otherwise(pick(F.get(moves, acc["q"]), u("q", t), model.states))
        x = pick(F.get(F.get(emits, q), acc["ctx"]), u("o", t), k)
        ctx = ((acc["ctx"] * k + x) % contexts).cast("int")
        # the newest symbol has weight 1, so older ones move up
        return F.struct(q.alias("q"), ctx.alias("ctx"), F.concat(acc["states"], F.array(q)).alias("states"), F.concat(acc["symbols"], F.array(x)).alias("symbols"))

    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("q"), F.lit(0).alias("ctx"), none.alias("states"), none.alias("symbols"))
    places = F.when(F.col("length") > 0, F.sequence(F.lit(0), F.col("length").cast("int") - 1)).otherwise(none)
    return wanted.withColumn("s", F.aggregate(places, zero, step)).select("seq_id", "s.states", "s.symbols")

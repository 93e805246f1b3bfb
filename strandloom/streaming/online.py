"""Operators over streams of events: counts of k-mers and likelihoods that grow with each event.

Both keep a small state for each sequence: the last symbols, or the forward
probabilities. Events of one sequence in a micro-batch are ordered by ``at``;
events that come later than others already taken are taken as they come. With
``idle`` (milliseconds) the state of a sequence without events for so long is
dropped; if it comes back it begins anew. Without, states are kept for ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..models.hidden import HiddenModel


def _timeout(idle: int | None) -> str:
    return "ProcessingTimeTimeout" if idle else "NoTimeout"


def kmers_of_stream(events: DataFrame, k: int, idle: int | None = None) -> DataFrame:
    """Running ``mer, total`` over streams ``seq_id, at, sym``; symbols are single characters.

    The last k-1 symbols of a sequence are carried over from batch to batch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(frames)).sort_values("at")["sym"].astype(str)
        text = (state.get[0] if state.exists else "") + "".join(new)
        state.update((text[max(0, len(text) - k + 1) :] if k > 1 else "",))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({"mer": [text[i : i + k] for i in range(len(text) - k + 1)]})

    mers = events.groupBy("seq_id").applyInPandasWithState(step, "mer string", "tail string", "append", _timeout(idle))
    return mers.groupBy("mer").count().withColumnRenamed("count", "total")


def likelihood_of_stream(events: DataFrame, model: HiddenModel, idle: int | None = None) -> DataFrame:
    """Streams ``seq_id, at, sym`` (codes) to ``seq_id, n, ll``: events so far and their log-likelihood, once for each batch and sequence."""
    pi, a, emit = model.pi, model.a, model.b_unknown.T

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        alpha, n, ll = state.get if state.exists else (None, 0, 0.0)
        alpha = None if alpha is None else np.array(alpha)
        for x in pd.concat(list(frames)).sort_values("at")["sym"]:
            raw = (pi if alpha is None else alpha @ a) * emit[int(x)]
            total = raw.sum()
            ll, n = (ll + np.log(total) if total > 0 else -np.inf), n + 1
            alpha = raw / total if total > 0 else raw
        state.update((None if alpha is None else alpha.tolist(), n, float(ll)))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({"seq_id": [key[0]], "n": [n], "ll": [float(ll)]})

    kind = dict(events.dtypes)["seq_id"]
    return events.groupBy("seq_id").applyInPandasWithState(step, f"seq_id {kind}, n bigint, ll double", "alpha array<double>, n bigint, ll double", "append", _timeout(idle))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Events by symbol in tumbling windows of ``at``; events later than ``late`` are dropped by the watermark."""
    from pyspark.sql import functions as F

    return events.withWatermark("at", late).groupBy(F.window("at", size), "sym").count().select("window.start", "sym", "count")

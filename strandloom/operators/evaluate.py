"""Comparison of predicted with true sites, and statistics of collections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..models.builders import Motif
from ..models.hidden import HiddenModel
from . import infer

#: Places that a bin of the interval join holds.
BIN = 64


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlapping intervals of the same sequence: ``seq_id, a_start, a_end, b_start, b_end, o_start, o_end``.

    Intervals are half-open rows ``seq_id, start, end``. Both sides are put into
    the bins they touch, so that the join is an equality on sequence and bin,
    also for a sequence with very many intervals; a pair counts in the bin where
    its overlap begins. Nested intervals overlap in the inner one. Empty
    intervals overlap nothing.
    """

    def binned(df: DataFrame, side: str) -> DataFrame:
        s, e = F.col("start"), F.col("end")
        touched = F.sequence(F.floor(s / BIN), F.floor((e - 1) / BIN))
        return df.where(s < e).select("seq_id", s.alias(f"{side}_start"), e.alias(f"{side}_end"), F.explode(touched).alias("bin"))

    first = F.greatest("a_start", "b_start")
    both = binned(a, "a").join(binned(b, "b"), ["seq_id", "bin"]).where("a_start < b_end and b_start < a_end").where(F.floor(first / BIN) == F.col("bin"))
    return both.select("seq_id", "a_start", "a_end", "b_start", "b_end", first.alias("o_start"), F.least("a_end", "b_end").alias("o_end"))


def site_assessment(truth: DataFrame, predicted: DataFrame, share: float = 0.25) -> DataFrame:
    """One row for each site: ``seq_id, start, end, truth, predicted``.

    A true site is found if a prediction covers ``share`` of it; a prediction
    that covers so much of no true site is a false one.
    """
    hits = overlaps(truth.distinct(), predicted.distinct()).where(F.col("o_end") - F.col("o_start") >= share * (F.col("a_end") - F.col("a_start")))
    found = hits.select("seq_id", F.col("a_start").alias("start"), F.col("a_end").alias("end")).distinct()
    right = hits.select("seq_id", F.col("b_start").alias("start"), F.col("b_end").alias("end")).distinct()
    key = ["seq_id", "start", "end"]
    true_sites = truth.distinct().select(*key).join(found.withColumn("predicted", F.lit(True)), key, "left")
    false_sites = predicted.distinct().select(*key).join(right, key, "left_anti")
    return true_sites.select(*key, F.lit(True).alias("truth"), F.coalesce("predicted", F.lit(False)).alias("predicted")).unionByName(
        false_sites.select(*key, F.lit(False).alias("truth"), F.lit(True).alias("predicted"))
    )


def confusion(truth: Column, predicted: Column) -> list[Column]:
    """Aggregates ``tp, tn, fp, fn`` of booleans."""
    t, p = truth.cast("boolean"), predicted.cast("boolean")
    return [F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")]


def site_roc(truth: DataFrame, predicted: DataFrame, share: float = 0.25) -> DataFrame:
    """Counts over all sites; there are no true negatives."""
    return site_assessment(truth, predicted, share).agg(*confusion(F.col("truth"), F.col("predicted")))


def base_roc(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts over all symbols of arrays of 0 and 1 of equal length."""
    pairs = rows.select(F.explode(F.arrays_zip(F.col(truth).alias("t"), F.col(predicted).alias("p"))).alias("x"))
    return pairs.agg(*confusion(F.col("x.t"), F.col("x.p")))


def is_hit(path: Column, background: list[int], length: int) -> Column:
    """More than half a motif's length (in whole numbers) outside of the background."""
    return F.size(F.filter(path, lambda s: ~s.isin(background))) > length // 2


def hit_flags(sequences: DataFrame, models: list[tuple[HiddenModel, list[int], int]]) -> DataFrame:
    """``seq_id, hits``: for each model (with background states and motif length) whether it hits the sequence; all models in one pass.

    ``seq_id`` may be a struct that carries other columns. A sequence without a path has no hit.
    """
    kind = sequences.schema["seq_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in infer._batches(batch.column(1), states=max([m.states for m, _, _ in models], default=1)):
                part = batch.take(pa.array(rows))
                flags = np.zeros((len(rows), len(models)), bool)
                for i, (model, background, length) in enumerate(models):
                    codes, sizes = infer.padded(part.column(1), model.symbols)
                    _, paths = infer.viterbi_batch(model, codes, sizes)
                    flags[:, i] = [path is not None and len(path) - np.isin(path, background).sum() > length // 2 for path in paths]
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(models))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flags.ravel()))], ["seq_id", "hits"])

    return infer.integral(sequences).select("seq_id", "obs").mapInArrow(run, f"seq_id {kind}, hits array<boolean>")


def hits(sequences: DataFrame, models: list[tuple[HiddenModel, list[int], int]]) -> DataFrame:
    """``seq_id, hit``: whether any of the models (with background states and motif length) hits the sequence."""
    return hit_flags(sequences, models).select("seq_id", F.exists("hits", lambda h: h).alias("hit"))


def roc_by_dataset(rows: DataFrame, dataset: str, truth: str, predicted: str) -> DataFrame:
    """Counts for each dataset and, with null, for all together; datasets without a name count as ``(none)``."""
    named = rows.withColumn(dataset, F.coalesce(F.col(dataset), F.lit("(none)")))
    return named.rollup(dataset).agg(*confusion(F.col(truth), F.col(predicted)))


def sweep(high: float = 0.1, low: float = 0.0001, n: int = 16) -> list[float]:
    """``n`` falling values with equal ratios, from ``high`` down to above ``low``."""
    return [high * (low / high) ** (i / n) for i in range(n)]


def roc_sweep(sequences: DataFrame, motif: Motif, model: HiddenModel, truth: str, values: list[float]) -> DataFrame:
    """``p, tp, tn, fp, fn`` of hits with the binding probability set to each value; ``sequences`` has the column ``truth``.

    Every sequence is read once and decoded under all values in turn.
    """
    models = []
    for p in values:
        own = model.copy()
        motif.set_p_binding(own, p)
        models.append((own, motif.background, motif.length))
    found = hit_flags(sequences.select(F.struct(F.col(truth).alias("truth")).alias("seq_id"), "obs"), models)
    each = found.select("seq_id.truth", F.posexplode("hits").alias("i", "hit")).groupBy("i").agg(*confusion(F.col("truth"), F.col("hit")))
    names = F.array(*[F.lit(float(p)) for p in values])
    return each.select(F.get(names, F.col("i")).alias("p"), "tp", "tn", "fp", "fn")


def matched_negatives(positives: DataFrame, negatives: DataFrame, text: str = "seq", strict: bool = True) -> DataFrame:
    """The n-th negative cut to the length of the n-th positive: ``ord, seq``.

    Both are ``ord, seq`` with a running number. A positive without a negative
    of its length is an error, or, unless ``strict``, a row with a null text.
    """
    p = positives.select("ord", F.length(text).alias("n"))
    joined = p.join(negatives.select("ord", F.col(text).alias("neg")), "ord", "left")
    short = F.lit(None)
    if strict:
        short = F.raise_error(F.concat(F.lit("no negative is long enough for "), F.col("ord").cast("string")))
    return joined.select("ord", F.when(F.length("neg") >= F.col("n"), F.substr("neg", F.lit(1), F.col("n"))).otherwise(short.cast("string")).alias(text))


def _by_falling_length(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with their length ``n`` and running number ``rank`` from 0, the longest first; numbered within each length, so no task holds all rows."""
    rows = rows.withColumn("n", F.length(text)).where("n is not null")
    longer = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each length
    before = rows.groupBy("n").agg(F.count("*").alias("rows")).select("n", F.coalesce(F.sum("rows").over(longer), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("n").orderBy("ord")) - 1
    return rows.withColumn("own", own).join(before, "n").withColumn("rank", F.col("before") + F.col("own")).drop("before", "own")


def paired_negatives(positives: DataFrame, negatives: DataFrame, text: str = "seq") -> DataFrame:
    """A negative for every positive, cut to its length: ``ord, seq``.

    Both are ``ord, seq``. They are paired by their rank of falling length; a
    positive whose rank has no negative that is long enough takes one of those
    that are, in turn. A positive longer than any negative has a null text.
    Rows with a null text are left out of both.
    """
    p, q = _by_falling_length(positives.select("ord", text), text), _by_falling_length(negatives.select("ord", text), text)
    lengths = p.select("n", F.lit(0).alias("rows")).distinct().unionByName(q.groupBy("n").agg(F.count("*").alias("rows")))
    upto = Window.orderBy(F.desc("n")).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # two rows for each length at most
    enough = lengths.withColumn("enough", F.sum("rows").over(upto)).select("n", "enough").distinct()
    taken = p.drop(text).join(enough, "n").withColumn("rank", F.when(F.col("enough") > 0, F.col("rank") % F.col("enough")))
    return taken.join(q.select("rank", F.col(text).alias("neg")), "rank", "left").select("ord", F.substr("neg", F.lit(1), F.col("n")).alias(text))


def summary(sequences: DataFrame, dataset: str, digits: str = "digits") -> DataFrame:
    """Sequences, symbols, known symbols and their percentage (whole, rounded down) for each dataset; null texts count as sequences."""
    n, known = F.length(digits), F.length(F.translate(digits, "4", ""))
    rows = sequences.groupBy(dataset).agg(F.count("*").alias("n_seqs"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_bases"), F.coalesce(F.sum(known), F.lit(0)).cast("bigint").alias("n_known"))
    return rows.withColumn("percent", F.floor(F.try_divide(100 * F.col("n_known"), F.col("n_bases"))).cast("bigint"))


def ranked(rows: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """Rows with ``score``, the geometric mean of two scores, the best first."""
    return rows.withColumn("score", F.sqrt(F.col(one) * F.col(two))).orderBy(F.desc("score"), key)

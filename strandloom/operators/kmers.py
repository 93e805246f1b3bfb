"""Counts of k-mers in collections of sequences.

``sequences`` holds ``seq_id`` and ``digits``, text of symbol codes 0 to 4 (4 =
unknown). Long texts are cut into chunks that overlap by k-1, so that taking
substrings stays cheap and one long text is not bound to be one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import log_factorial, reverse_complement
from ..runtime import stable

CHUNK = 256


def windows(sequences: DataFrame, k: int) -> DataFrame:
    """``seq_id, mer`` of every window; none for null texts and texts shorter than k."""
    starts = F.sequence(F.lit(1), F.length("digits") - k + 1, F.lit(CHUNK))
    chunks = sequences.where(F.length("digits") >= k).select("seq_id", F.explode(starts).alias("s"), "digits").select("seq_id", F.expr(f"substring(digits, s, {CHUNK + k - 1})").alias("chunk"))
    mers = F.transform(F.sequence(F.lit(1), F.length("chunk") - k + 1), lambda i: F.substr("chunk", i, F.lit(k)))
    return chunks.select("seq_id", F.explode(mers).alias("mer"))


def one_strand(mer: Column) -> Column:
    """The smaller of a mer and its reverse complement; mers with unknowns are all ``N``."""
    return F.when(mer.contains("4"), "N").otherwise(F.least(mer, reverse_complement(mer)))


def count_mers(sequences: DataFrame, k: int) -> DataFrame:
    """``mer, total``; unknowns are ordinary symbols."""
    return windows(sequences, k).groupBy("mer").agg(F.count("*").alias("total"))


def count_mers_and_sequences(sequences: DataFrame, k: int, collapse: bool = False) -> DataFrame:
    """``mer, total, num_seqs``, with both strands together if wanted.

    A sequence with a mer and its reverse complement counts once. Counting by
    mer and sequence first keeps the number of distinct sequences exact without
    a set for each mer.
    """
    rows = windows(sequences, k)
    if collapse:
        rows = rows.select("seq_id", one_strand(F.col("mer")).alias("mer"))
    each = rows.groupBy("mer", "seq_id").agg(F.count("*").alias("n"))
    return each.groupBy("mer").agg(F.sum("n").alias("total"), F.count("*").alias("num_seqs"))


def largest(counted: DataFrame, n: int) -> DataFrame:
    """The ``n`` mers of most sequences, then of most occurrences, then the smallest."""
    return counted.orderBy(F.desc("num_seqs"), F.desc("total"), "mer").limit(n)


def top_mers_by_sequences(sequences: DataFrame, k: int, n: int) -> DataFrame:
    return largest(count_mers_and_sequences(sequences, k, collapse=True), n)


def known_only(counted: DataFrame) -> DataFrame:
    return counted.where(~F.col("mer").contains("4") & (F.col("mer") != "N"))


def top_known_by_sequences(sequences: DataFrame, k: int, n: int) -> DataFrame:
    """The ``n`` known mers of ``top_mers_by_sequences``, with as many in place of those with unknowns.

    All texts of a sequence are brought into one row first, so its mers are
    counted there and only sums for each group of rows are shuffled, not every
    mer of every sequence.
    """
    if k > 31:  # a mer is a number of two bits for each symbol
        return largest(known_only(count_mers_and_sequences(sequences, k, collapse=True)), n)

    def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mers as numbers, how often they stand, and in how many of the texts."""
        flat = np.frombuffer("|".join(texts).encode(), np.uint8).astype(np.int64) - ord("0")
        row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(flat)]
        size = max(0, len(flat) - k + 1)
        unknown = np.r_[0, np.cumsum((flat < 0) | (flat > 3))]
        at = np.flatnonzero(unknown[k:] == unknown[:size]) if size else np.zeros(0, np.int64)
        one, two = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for p in range(k):
            x = flat[at + p]
            one, two = one << 2 | x, two | (3 - x) << 2 * p
        mers, mer = np.unique(np.minimum(one, two), return_inverse=True)
        pairs, times = np.unique(row[at] * max(1, len(mers)) + mer, return_counts=True)
        of = pairs % max(1, len(mers))
        return mers, np.bincount(of, times, len(mers)).astype(np.int64), np.bincount(of, minlength=len(mers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2500):
                mers, total, seqs = counted(batch.column(0).slice(a, 2500).to_pylist())
                texts = (mers[:, None] >> 2 * np.arange(k - 1, -1, -1) & 3).astype(np.uint8) + ord("0")
                yield pa.RecordBatch.from_arrays([pa.array(texts.view(f"S{k}").ravel()).cast(pa.string()), pa.array(total), pa.array(seqs)], ["mer", "total", "num_seqs"])

    texts = sequences.where("digits is not null").groupBy("seq_id").agg(F.concat_ws("|", F.collect_list("digits")).alias("digits"))
    parts = texts.select("digits").mapInArrow(run, "mer string, total bigint, num_seqs bigint")
    return largest(parts.groupBy("mer").agg(F.sum("total").alias("total"), F.sum("num_seqs").alias("num_seqs")), n)


def most_common(sequences: DataFrame, k: int, n: int = 1) -> DataFrame:
    """The ``n`` most frequent mers without unknowns."""
    return known_only(count_mers(sequences, k)).orderBy(F.desc("total"), "mer").limit(n)


def collapse(counted: DataFrame) -> DataFrame:
    """``mer, total`` with reverse complements added to each other."""
    return counted.groupBy(one_strand(F.col("mer")).alias("mer")).agg(F.sum("total").alias("total"))


def significances(sequences: DataFrame, k: int, log_p: DataFrame | None = None) -> DataFrame:
    """``mer, total, logp`` of collapsed known mers: log binomial probability of the count, ascending is most significant.

    A mer's own probability is 0.25**k or comes from ``log_p`` (``mer, lp``).
    """
    counted = stable(known_only(collapse(known_only(count_mers(sequences, k)))))
    whole = counted.agg(F.sum("total")).first()[0] or 0
    rows = counted.withColumn("lp", F.lit(k) * F.log(F.lit(0.25))) if log_p is None else counted.join(log_p, "mer")
    c, t = F.col("total").cast("double"), F.lit(float(whole))
    choose = log_factorial(t) - log_factorial(c) - log_factorial(t - c)
    return rows.select("mer", "total", (choose + c * F.col("lp") + (t - c) * F.log1p(-F.exp("lp"))).alias("logp"))

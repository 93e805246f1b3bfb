"""Consensus codes: sets of symbols as bit masks, and counts of words over such sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def codes(spark: SparkSession, alphabet: int) -> DataFrame:
    """All 2**alphabet codes."""
    return spark.range(1 << alphabet).select(F.col("id").cast("int").alias("code"))


def matches(symbol: Column, code: Column) -> Column:
    return F.expr("1").bitwiseAND(shift_right(code, symbol)) == 1


def shift_right(code: Column, symbol: Column) -> Column:
    return F.floor(code / F.pow(F.lit(2.0), symbol)).cast("int")


def code_of_symbol(symbol: Column) -> Column:
    return F.pow(F.lit(2.0), symbol).cast("int")


def code_of_symbols(symbol: Column) -> Column:
    """Aggregate: the code of all symbols of a group."""
    return F.bit_or(code_of_symbol(symbol))


def symbols_of_code(code: Column, alphabet: int) -> Column:
    """Symbols in ascending order."""
    return F.filter(F.array(*[F.lit(i) for i in range(alphabet)]), lambda i: matches(i, code))


def codes_of_symbol(symbol: Column, alphabet: int) -> Column:
    """All codes that contain a symbol, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit((1 << alphabet) - 1)), lambda c: matches(symbol, c))


def n_symbols(code: Column) -> Column:
    return F.bit_count(code)


def word_counts(sequences: DataFrame, length: int, alphabet: int) -> DataFrame:
    """How often each consensus word of ``length`` codes matches: ``c1..cN, n``.

    ``sequences``: ``seq_id, obs``. Every window without unknowns counts for
    all words that match it. Windows are counted first, so a window's words are
    formed once for each different window and not for each occurrence.
    """
    starts = F.when(F.size("obs") >= length, F.sequence(F.lit(0), F.size("obs") - length)).otherwise(F.array().cast("array<int>"))
    wins = sequences.select("obs", F.explode(starts).alias("s")).select(*[F.get("obs", F.col("s") + i).alias(f"x{i + 1}") for i in range(length)])
    names = [f"x{i + 1}" for i in range(length)]
    known = reduce(lambda a, b: a & b, [F.col(x).between(0, alphabet - 1) for x in names])
    counted = wins.where(known).groupBy(*names).agg(F.count("*").alias("n"))
    for i in range(length):
        counted = counted.withColumn(f"c{i + 1}", F.explode(codes_of_symbol(F.col(f"x{i + 1}"), alphabet)))
    return counted.groupBy(*[f"c{i + 1}" for i in range(length)]).agg(F.sum("n").alias("n"))

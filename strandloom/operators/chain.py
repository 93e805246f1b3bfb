"""Variable-order Markov chains: tables of order n, n-1, ..., 0 as one long table.

A table row is ``ord, code, ctx, sym, cnt``: after context ``ctx`` (``ord``
symbols, the oldest most significant) symbol ``sym`` came ``cnt`` times. Every
symbol below ``alphabet`` is ordinary; to count unknowns, give them a symbol of
their own. Null symbols and symbols outside break a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import small

#: Cells of a chain that are broadcast at most; larger tables are joined by shuffling.
MOST_CELLS = 1_000_000


def _code(obs: Column, t: Column, order: int, alphabet: int) -> Column:
    """Code of the symbols t-order .. t, the newest with weight 1; null where one is missing or outside."""
    total, known = F.lit(0).cast("bigint"), F.lit(True)
    for d in range(order + 1):
        x = F.get(obs, t - d)
        known = known & x.between(0, alphabet - 1)
        total = total + x * (alphabet**d)
    return F.when(known, total)


def _places(obs: str, begin: int = 0) -> Column:
    return F.when(F.size(obs) > begin, F.sequence(F.lit(begin), F.size(obs) - 1)).otherwise(F.array().cast("array<int>"))


def domain(spark: SparkSession, alphabet: int, order: int) -> DataFrame:
    """All cells ``ord, code`` of all orders."""
    parts = [spark.range(alphabet ** (o + 1)).select(F.lit(o).alias("ord"), F.col("id").alias("code")) for o in range(order + 1)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df


def window_counts(sequences: DataFrame, alphabet: int, order: int) -> DataFrame:
    """``ord, code, cnt`` of the windows that occur, for all orders 0 to ``order`` in one pass."""
    cells = lambda t: F.array(*[F.struct(F.lit(o).alias("ord"), _code(F.col("obs"), t, o, alphabet).alias("code")) for o in range(order + 1)])
    rows = sequences.select(F.inline(F.flatten(F.transform(_places("obs"), cells)))).where("code is not null")
    return rows.groupBy("ord", "code").agg(F.count("*").alias("cnt"))


def counts(sequences: DataFrame, alphabet: int, order: int, pseudo: float = 0.0) -> DataFrame:
    """Counts of all cells of all orders with ``pseudo`` added to each."""
    seen = window_counts(sequences, alphabet, order)
    full = domain(sequences.sparkSession, alphabet, order).join(seen, ["ord", "code"], "left")
    return full.select(
        "ord", "code", F.floor(F.col("code") / alphabet).cast("bigint").alias("ctx"), (F.col("code") % alphabet).cast("int").alias("sym"),
        (F.coalesce("cnt", F.lit(0)) + F.lit(float(pseudo))).alias("cnt"),
    )


def probabilities(table: DataFrame, log: bool = True) -> DataFrame:
    """Counts with ``p`` and, if wanted, ``logp``: NaN for contexts never seen, -inf for p = 0."""
    total = F.sum("cnt").over(Window.partitionBy("ord", "ctx"))
    p = F.when(total > 0, F.col("cnt") / total).otherwise(F.lit(float("nan")))
    got = table.withColumn("p", p)
    return got.withColumn("logp", log_of(F.col("p"))) if log else got


def log_of(p: Column) -> Column:
    """ln, with -inf at 0 and NaN kept."""
    return F.when(F.isnan(p), p).when(p <= 0, F.lit(float("-inf"))).otherwise(F.log(F.when(p > 0, p)))


def model(sequences: DataFrame, alphabet: int, order: int, pseudo: float = 1.0) -> DataFrame:
    """Counts, probabilities and logs from sequences."""
    return probabilities(counts(sequences, alphabet, order, pseudo))


def lower_order(table: DataFrame, order: int) -> DataFrame:
    """The table of one order alone."""
    return table.where(F.col("ord") == order)


def evaluate(sequences: DataFrame, table: DataFrame, alphabet: int, order: int, log: bool = True, begin: int = 0, context: int = 0) -> DataFrame:
    """``seq_id, t, value`` of every place from ``begin`` on.

    Place t is conditioned on the longest known context, of min(t - context,
    order) symbols. The table has one row for each cell, alphabet**(order + 1)
    at most in its largest order; up to ``MOST_CELLS`` rows are broadcast.
    """

    def cell(t: Column) -> Column:
        depth = F.least(t - context, F.lit(order))
        code = F.coalesce(*[F.when(depth == o, _code(F.col("obs"), t, o, alphabet)) for o in range(order + 1)])
        return F.struct(t.alias("t"), depth.alias("ord"), code.alias("code"))

    at = sequences.select("seq_id", F.inline(F.transform(_places("obs", begin), cell)))
    cells = table.select("ord", "code", F.col("logp" if log else "p").alias("value"))
    return at.join(small(cells, MOST_CELLS), ["ord", "code"], "left").select("seq_id", "t", "value")


def cumulative(values: DataFrame) -> DataFrame:
    """Running sum of the values of each sequence; repartitioned by sequence once."""
    upto = Window.partitionBy("seq_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return values.withColumn("cumulative", F.sum("value").over(upto))


def score(values: DataFrame) -> DataFrame:
    """Sum of the values of each sequence."""
    return values.groupBy("seq_id").agg(F.sum("value").alias("value"))

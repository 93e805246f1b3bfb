"""Column expressions on nucleotide text, symbol codes and numbers.

Codes: a 0, c 1, g 2, t 3 in either case, anything else 4 (unknown). Null text
stays null, empty text stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = 4


def text_codes(text: Column) -> Column:
    """Digits 0 to 4, one for each character; digits in the text itself are unknowns."""
    return F.translate(F.regexp_replace(F.lower(text), "(?s)[^acgt]", "n"), "acgtn", "01234")


def codes_text(digits: Column) -> Column:
    """The nucleotides of a string of digits; an error for another character."""
    bad = F.raise_error(F.concat(F.lit("no symbol codes: "), digits)).cast("string")
    return F.when(digits.rlike("^[0-4]*$"), F.translate(digits, "01234", "acgtn")).when(digits.isNotNull(), bad)


def code_array(digits: Column) -> Column:
    """Array of codes of a string of digits."""
    return F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))


def complement(code: Column) -> Column:
    """3 - code; an unknown stays unknown."""
    return F.when(code == UNKNOWN, UNKNOWN).otherwise(3 - code)


def reverse_complement(digits: Column) -> Column:
    """Of a string of digits."""
    return F.reverse(F.translate(digits, "0123", "3210"))


def reverse_complement_array(codes: Column) -> Column:
    return F.transform(F.reverse(codes), complement)


def n_bases(digits: Column) -> Column:
    """Aggregate: all symbols."""
    return F.coalesce(F.sum(F.length(digits)), F.lit(0)).cast("bigint")


def n_known_bases(digits: Column) -> Column:
    """Aggregate: symbols other than unknowns."""
    return F.coalesce(F.sum(F.length(F.translate(digits, "4", ""))), F.lit(0)).cast("bigint")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts alone, not on the partition."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mask_unknown(codes: Column, key: Column, seed: int, p: float = 0.02, unknown: int = UNKNOWN) -> Column:
    """An array of codes where each place is made unknown with probability ``p``, independently."""
    return F.transform(codes, lambda x, i: F.when(uniform(seed, key, i) < p, F.lit(unknown)).otherwise(x))


def random_sequences(spark: SparkSession, n: int, mean: float, seed: int) -> DataFrame:
    """``n`` sequences ``seq_id, obs`` of uniform symbols with Poisson lengths.

    The length is where the running product of uniforms falls below
    exp(-mean), in parts of at most 50 so that exp does not vanish.
    """
    parts = max(1, math.ceil(mean / 50))
    most = int(50 + 12 * math.sqrt(50) + 20)
    limit = math.exp(-mean / parts)
    ids = spark.range(n).withColumnRenamed("id", "seq_id")

    def poisson(part: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(most))
        zero = F.struct(F.lit(1.0).alias("p"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((a["p"] * uniform(seed, F.col("seq_id"), part, i)).alias("p"), (a["n"] + F.when(a["p"] * uniform(seed, F.col("seq_id"), part, i) > limit, 1).otherwise(0)).alias("n"))
        return F.aggregate(steps, zero, step, lambda a: a["n"])

    size = F.aggregate(F.sequence(F.lit(1), F.lit(parts)), F.lit(0), lambda a, k: a + poisson(k))
    symbols = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.floor(uniform(seed + 1, F.col("seq_id"), i) * 4).cast("int"))
    return ids.withColumn("size", size).select("seq_id", F.when(F.col("size") > 0, symbols).otherwise(F.array().cast("array<int>")).alias("obs"))


def infinity() -> Column:
    return F.lit(float("inf"))


def not_a_number() -> Column:
    return F.lit(float("nan"))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), 0 below -36 and 1 above 36."""
    return F.when(x < -36, 0.0).when(x > 36, 1.0).otherwise(1 / (1 + F.exp(-x)))


def inverse_sigmoid(y: Column) -> Column:
    """Logit; -36 for 0 and less, 36 for 1 and more."""
    inner = F.when((y > 0) & (y < 1), y)
    return F.when(y <= 0, -36.0).when(y >= 1, 36.0).otherwise(F.log(inner) - F.log(1 - inner))


def is_close(a: Column, b: Column, tolerance: float) -> Column:
    """No further apart than ``tolerance``."""
    return F.abs(a - b) <= tolerance


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0, by Stirling's series eight places up."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    high = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series
    down = F.log(x)
    for i in range(1, 8):
        down = down + F.log(x + i)
    return high - down


def log_factorial(n: Column) -> Column:
    """ln n! with 0! = 1! = 1."""
    return F.when(n <= 1, 0.0).otherwise(log_gamma(n.cast("double") + 1))


def strings_of_distribution(columns: DataFrame, n: int) -> DataFrame:
    """``n`` strings whose letter frequencies at each place come close to a distribution.

    ``columns``: ``pos, a, c, g, t``. String i has at a place the first letter
    whose cumulated probability times ``n`` exceeds i.
    """
    i = F.col("i")
    cum = [F.col("a"), F.col("a") + F.col("c"), F.col("a") + F.col("c") + F.col("g")]
    letter = F.when(i < n * cum[0], "a").when(i < n * cum[1], "c").when(i < n * cum[2], "g").otherwise("t")
    rows = columns.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return rows.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("pos", letter.alias("x")))).alias("xs")).select(
        "i", F.concat_ws("", F.col("xs.x")).alias("seq")
    )

"""Sequence views of the test tables, all as ``seq_id`` with symbols in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symbols import code_array, text_codes
from ..runtime import bare, cleaned, once, small, spread, table

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
FLAGS = ("A", "N", "R")


def _code(c: str, names: tuple[str, ...]) -> Column:
    got = F.lit(len(names))
    for i, name in enumerate(names):
        got = F.when(F.col(c) == name, i).otherwise(got)
    return got


def _ordered(df: DataFrame, key: str, order: list[str], code: Column) -> DataFrame:
    """One row for each key: a sequence is a row, as recursions over it cannot be split."""
    rows = spread(df.where(F.col(key).isNotNull()), key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, code.alias("_o")))).alias("xs"))
    return rows.select(F.col(key).cast("bigint").alias("seq_id"), F.col("xs._o").alias("obs"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of each user's events in order of time; an unknown type is 5."""
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return _ordered(df, "user_id", ["ts", "event_id"], _code("event_type", EVENT_TYPES))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of each customer's orders in order of date; an unknown priority is 5."""
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    code = F.coalesce(F.expr("try_cast(substring(o_orderpriority, 1, 1) as int)") - 1, F.lit(5))
    return _ordered(df, "o_custkey", ["o_orderdate", "o_orderkey"], code)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags of each order's lines; an unknown flag is 3."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return _ordered(df, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], _code("l_returnflag", FLAGS))


def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq_id, fragment, seq, digits`` of the records, white space removed."""
    df = once(spread(table(spark, sf_dir, "fasta"), "fasta_id"), "fasta_id", fill=("fragment",))
    return df.select(F.col("fasta_id").alias("seq_id"), "fragment", bare("sequence").alias("seq")).withColumn("digits", text_codes(F.col("seq")))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq_id, obs`` of the records."""
    return fasta(spark, sf_dir).where("digits is not null").select("seq_id", code_array(F.col("digits")).alias("obs"))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq_id, fragment, train, test, digits, obs, path, k`` of the input sequences, unknowns stripped from the ends."""
    df = once(spread(table(spark, sf_dir, "sequences"), "seq_id"), "seq_id", fill=("fragment",))
    k = table(spark, sf_dir, "fragments").select("fragment", F.col("motif_len").alias("k"))
    digits = text_codes(cleaned("seq"))
    rows = df.select(
        "seq_id", "fragment", F.col("fragment_training_set_filename").alias("train"), F.col("fragment_test_set_filename").alias("test"), digits.alias("digits"), code_array(digits).alias("obs"), F.col("q_star").alias("path")
    )
    return rows.join(small(k, 10_000), "fragment", "left")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq_id, start, end`` of the reported sites, each once."""
    df = once(table(spark, sf_dir, "gettestdatasites"), "site_id")
    n = F.length(F.trim("sites"))
    return df.where("seq_id is not null and start is not null").where(n > 0).select("seq_id", "start", (F.col("start") + n).alias("end")).distinct()


def aligned_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq_id, obs``: the symbols of each reported site, the first of all sites under each other; ``seq_id`` is the site's."""
    df = once(table(spark, sf_dir, "gettestdatasites"), "site_id")
    return df.where("sites is not null").select(F.col("site_id").alias("seq_id"), code_array(text_codes(F.lower(F.trim("sites")))).alias("obs"))

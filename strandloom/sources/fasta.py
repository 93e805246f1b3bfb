"""FASTA text as DataFrames and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symbols import text_codes


def read(spark: SparkSession, path: str, line: str = "\n") -> DataFrame:
    """``id, header, seq``: one row for each record, in no certain order.

    Records are split by Spark's text source at ``line`` + ``>``, so a large
    file is read by many tasks. ``id`` is the header's first word. White space
    within sequences is dropped. Blank files give no rows, a record without
    sequence the empty text.
    """
    raw = spark.read.option("lineSep", f"{line}>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("r")).where("trim(r) <> ''")
    parts = F.split("r", r"\r?\n", 2)
    header = F.trim(parts[0])
    return raw.select(
        F.regexp_extract(header, r"^(\S*)", 1).alias("id"), header.alias("header"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s+", "").alias("seq")
    )


def stripped(seq: Column | str) -> Column:
    """Without the unknowns at both ends."""
    return F.regexp_replace(seq, "^[nN]+|[nN]+$", "")


def read_stripped(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of one or several files with stripped sequences, as ``id, seq, digits``."""
    df = None
    for p in paths:
        own = read(spark, p)
        df = own if df is None else df.unionByName(own)
    return df.select("id", stripped("seq").alias("seq")).withColumn("digits", text_codes(F.col("seq")))


def records(df: DataFrame, header: Column, seq: Column, width: int | None = None) -> DataFrame:
    """``value``: a record as text, with lines of ``width`` symbols if given."""
    body = seq if width is None else F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")
    return df.select(F.concat(F.lit(">"), header, F.lit("\n"), body).alias("value"))


def write(df: DataFrame, path: str, width: int | None = None) -> None:
    """Writes ``ord, seq`` as records ``sequence i`` counted from 1."""
    records(df, F.concat(F.lit("sequence "), F.col("ord").cast("string")), F.col("seq"), width).write.mode("overwrite").text(path)

"""Files of sites, of ROC points and of chain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITES = "site string, seq_id bigint, start int, is_rev_comp int, states string"
ROC = "p double, tp bigint, tn bigint, fp bigint, fn bigint"


def site_lines(sites: DataFrame) -> DataFrame:
    """Sites as rows of text columns: symbols as nucleotides, states with blanks between."""
    letters = F.translate(F.concat_ws("", F.transform("site", lambda x: x.cast("string"))), "01234", "acgtn")
    states = F.concat_ws(" ", F.transform("states", lambda s: s.cast("string")))
    return sites.select(letters.alias("site"), "seq_id", "start", F.col("is_rev_comp").cast("int").alias("is_rev_comp"), states.alias("states"))


def write_sites(sites: DataFrame, path: str) -> None:
    """Lines ``site;seq_id;start;is_rev_comp;states``."""
    site_lines(sites).write.mode("overwrite").option("sep", ";").csv(path)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Inverse of ``write_sites``; lines that begin with # are skipped."""
    rows = spark.read.schema(SITES).option("sep", ";").option("comment", "#").csv(path)
    return rows.withColumn("states", F.transform(F.filter(F.split("states", " "), lambda s: s != ""), lambda s: s.cast("int")))


def write_roc(rows: DataFrame, path: str) -> None:
    """Lines ``p;TP;TN;FP;FN`` with six places of p."""
    rows.select(F.format_string("%.6f", "p").alias("p"), "tp", "tn", "fp", "fn").write.mode("overwrite").option("sep", ";").csv(path)


def read_roc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROC).option("sep", ";").option("comment", "#").csv(path)


def write_chain(table: DataFrame, path: str) -> None:
    """A chain's table by order."""
    table.write.mode("overwrite").partitionBy("ord").parquet(path)


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

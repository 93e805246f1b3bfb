"""Queries of the numbered problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import once, table
from . import cuts, frequent, leaks, patterns, runs, spans, splits, tokens

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = once(table(spark, sf_dir, "sequences"), "seq_id", fill=("fragment",))
    sites = once(table(spark, sf_dir, "gettestdatasites"), "site_id")
    return runs.collapse_runs(sequences, sites, table(spark, sf_dir, "fragments"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of a hit have equal places and mers, so a second one adds nothing to a set of sequences."""
    hits = table(spark, sf_dir, "mer_count_with_seq_membership").where("total >= 1").withColumn("mer", F.lower(F.trim("mer")))
    return patterns.frequent_patterns(hits, "count_id", "seq_idx_membership", "pos", "mer", share=(1, 5), length=3)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "fasta").select("fasta_id", "sequence", "loaded_at"), "fasta_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(_records(spark, sf_dir), "fasta_id", "sequence", 40)


def p3_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return spans.shared_part(records, spans.shared_spans(records, "fasta_id", "sequence", 40), "fasta_id", "sequence")


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = "fragment_training_set_filename", "fragment_test_set_filename"
    rows = once(table(spark, sf_dir, "sequences").select("seq_id", train, test, "seq", "loaded_at"), "seq_id")
    return splits.overlapping_splits(rows, "seq_id", "seq", train, test, percent=4, least=60)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir).select("seq_id_a", "seq_id_b")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test sequences with a copy in training, per fold and fragment of the test sequence."""
    train, test = F.col("fragment_training_set_filename"), F.col("fragment_test_set_filename")
    rows = once(table(spark, sf_dir, "sequences").select("seq_id", "fragment", train, test, "loaded_at"), "seq_id", fill=("fragment",))
    role, fold = splits.split_of(train, test)
    tests = rows.select("seq_id", F.upper(F.trim("fragment")).alias("fragment"), fold.alias("fold"), role.alias("role")).where("role = 'test'")
    pairs = _splits(spark, sf_dir)
    hit = pairs.select(F.explode(F.array("seq_id_a", "seq_id_b")).alias("seq_id")).distinct().withColumn("hit", F.lit(1))
    return tests.join(hit, "seq_id", "left").groupBy("fold", "fragment").agg(F.count("*").alias("n_test"), F.count("hit").alias("n_leaked"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = frequent.frequent_items(table(spark, sf_dir, "top_mers_callback"), "call_id", frequent.one_strand(F.col("_k_mers")), F.lit(1), 0.004)
    totals = frequent.frequent_items(table(spark, sf_dir, "mer_count"), "mer_count_id", frequent.one_strand(F.col("mer")), F.col("total"), 0.005)
    cols = [F.col("item").alias("mer"), "weight", "total"]
    return calls.select(F.lit("_k_mers").alias("field"), *cols).unionByName(totals.select(F.lit("total").alias("field"), *cols))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_counts(spark, sf_dir).select("field", "mer")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(_overlaps(spark, sf_dir))


def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps with substituted words, of 13 words or more of which at least 80 % are the same."""
    return _overlaps(spark, sf_dir).where("n_words >= 13 and n_same >= 0.8 * n_words")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.cut_texts(table(spark, sf_dir, "documents")).select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return cuts.cut_rates(docs, cuts.cut_texts(docs))


def queries() -> dict[str, Query]:
    found = (p1_found, p2_found, p3_found, p3_share, p4_found, p4_report, p5_found, p5_counts, p6_ids, p7_found, p7_overlaps, p8_found, p8_rates)
    return {f.__name__: f for f in found}

import pytest

from sqlcheck import same
from strandloom.llm import oracle, queries

SQL = oracle.oracle_sql()
MAIN = [n for n in queries.queries() if n.endswith(("_found", "_ids"))]


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    if name in SQL:
        same(df, SQL[name], "/root/testdata/sf0.001")
    else:
        df.write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", MAIN)
def test_empty_tables(spark, tmp_path, name):
    for t in ("fragments", "sequences", "gettestdatasites", "fasta", "mer_count_with_seq_membership", "mer_count", "top_mers_callback", "documents", "eval_items"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", MAIN)
def test_rows_of_nulls_and_other_columns(spark, tmp_path, name):
    """A table whose every row has nulls everywhere but in one column, and columns with names that operators use."""
    from pyspark.sql import functions as F

    for t in ("fragments", "sequences", "gettestdatasites", "fasta", "mer_count_with_seq_membership", "mer_count", "top_mers_callback", "documents", "eval_items"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(30)
        df = df.withColumn("_r", F.monotonically_increasing_id())
        cols = [c for c in df.columns if c != "_r"]
        broken = df.select(*[F.when(F.col("_r") % len(cols) != i, F.col(c)).alias(c) for i, c in enumerate(cols)])
        empty = df.limit(1).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols])
        both = broken.unionByName(empty).unionByName(broken)
        for extra in ("key", "text", "words", "item", "weight", "id", "ptr", "place", "field", "hash", "run", "block", "start", "end", "fold", "role", "_k"):
            if extra not in [c.lower() for c in cols]:
                both = both.withColumn(extra, F.lit("x"))
        both.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    queries.queries()[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()

"""Session helpers shared by all operators: tables, checkpoints, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the tables that each application wrote.
_WRITTEN: dict[str, set[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach, where intermediate tables are written.

    It is the one that the session names in ``spark.checkpoint.dir``. Only a
    local session (tests, a laptop) may leave it unset and gets a temporary
    folder; on a cluster that would be lost with its machine, so it is refused.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandloom-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def stable(df: DataFrame, split: str | None = None) -> DataFrame:
    """``df`` written once as a table to the shared folder and read from there, so its lineage is cut.

    ``split`` names a column with few values; rows of each value lie in a
    folder of their own, and a filter on it reads only that folder.
    ``release`` deletes the table.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write if split is None else df.write.partitionBy(split)
    writer.parquet(folder)
    got = spark.read.schema(df.schema).parquet(folder)
    got._folder = folder
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(folder)
    return got


def release(df: DataFrame, part: str | None = None) -> None:
    """Deletes a table of ``stable``, or only its folder ``part`` (such as ``home=false``), once nothing reads it any more."""
    _delete(df.sparkSession, df._folder if part is None else f"{df._folder}/{part}")


def release_all(spark: SparkSession) -> None:
    """Deletes all tables that this session wrote; for the time when all results have been taken."""
    for folder in _WRITTEN.pop(spark.sparkContext.applicationId, set()):
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.get(sc.applicationId, set()).discard(folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hash-partitioned by its keys into ``spark.sql.shuffle.partitions`` parts.

    For costly work on each row: unlike partitions of an aggregation these are
    not coalesced when their bytes are few, and an aggregation by the same keys
    needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def once(df: DataFrame, key: str, loaded: str = "loaded_at", fill: tuple[str, ...] = ()) -> DataFrame:
    """One row for each id: the delivery loaded first.

    Rows without an id are left out, as nothing tells them apart. Columns named
    in ``fill`` take any known value of the id's deliveries where the first
    delivery has null. Deliveries loaded at the same time are ordered by their
    other columns, so the result does not depend on the order of the rows.
    """
    rest = [c for c in df.columns if c not in (key, loaded)]
    first = F.min(F.struct(F.col(loaded), *[F.col(c) for c in rest]))
    known = [F.max(F.col(c)).alias(f"_fill_{c}") for c in fill]
    got = df.where(F.col(key).isNotNull()).groupBy(key).agg(first.alias("_first"), *known)
    cols = [F.coalesce(f"_first.{c}", f"_fill_{c}").alias(c) if c in fill else F.col(f"_first.{c}") for c in rest]
    return got.select(key, *cols)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is.

    The count stops after ``most`` rows, so the check stays cheap on a large
    input, and beyond the bound Spark's own shuffled join remains.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bare(c: Column | str) -> Column:
    """Lower case without any white space."""
    got = F.col(c) if isinstance(c, str) else c
    for space in " \n\r\t\f\v":
        got = F.replace(got, F.lit(space))
    return F.lower(got)


def cleaned(c: Column | str) -> Column:
    """Lower case without white space and without the unknown symbols at both ends."""
    return F.btrim(bare(c), F.lit("n"))

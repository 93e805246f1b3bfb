"""All queries of the core and their SQL."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_SHIPPED = "strandloom.package"


def ship(spark: SparkSession, root: str) -> None:
    """Adds the package to the Python path of the session's executors, once for each session."""
    if os.path.isdir(os.path.join(root, "strandloom")) and not spark.conf.get(_SHIPPED, None):
        folder = tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "strandloom"), "zip", root, "strandloom"))
        spark.conf.set(_SHIPPED, "1")


def queries() -> dict[str, Query]:
    from . import queries as own

    return {f.__name__: f for f in own.ALL}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.oracle_sql()

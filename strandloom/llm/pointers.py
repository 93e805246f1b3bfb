"""Pointer doubling: the start of every chain of linked rows, by self-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import release, stable


def double_pointers(links: DataFrame, keys: list[str]) -> DataFrame:
    """Chain start of every row that has a predecessor: ``keys, id, ptr, steps``.

    ``links``: ``keys``, ``id``, ``ptr`` with one row for each id that follows
    another; ``ptr`` is the one before it and no two rows have the same
    ``ptr``. A column ``steps`` tells how far away ``ptr`` is (1 without it). An
    id that is not in ``links`` starts a chain. In the result ``ptr`` is the
    chain's start, ``steps`` away.

    Each round replaces pointers by their targets' pointers, which then reach
    twice as far, so a chain of n rows needs about log2(n) rounds. A pointer
    that has arrived is written once and leaves the probing side; the others
    all have different targets, so every join is on unique keys and no long
    chain gathers in one task. A round's pointers that had not arrived are
    deleted once the next round is written. Null keys, ids or pointers are left
    out. No links give no rows. Rows of a closed circle have no start and are
    left out: once a round lets no pointer arrive, only circles are left.
    """
    steps = F.col("steps") if "steps" in links.columns else F.lit(1)
    first = stable(links.select(*keys, "id", "ptr", steps.cast("bigint").alias("steps")).dropna())
    arrived: list[DataFrame] = []
    moving, old = first.withColumn("home", F.lit(False)), (first, None)
    n, before = first.count(), -1
    while n and n != before:
        far = moving
        for part in arrived:
            far = far.unionByName(part)
        far = far.select(*keys, F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("steps").alias("_steps"), F.col("home").alias("_home"))
        moved = moving.join(far, [*keys, "ptr"], "left").select(
            *keys, "id", F.coalesce("_ptr", "ptr").alias("ptr"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_home", F.lit(True)).alias("home")
        )
        table = stable(moved, split="home")
        release(*old)
        arrived.append(table.where("home"))
        moving, old = table.where(~F.col("home")), (table, "home=false")
        n, before = moving.count(), n
    got = moving.where("home")
    for part in arrived:
        got = got.unionByName(part)
    return got.drop("home")

"""Most frequent items of a column in bounded memory, by combinatorial group testing.

Every item is a 64-bit hash. Each of ``depth`` hash functions puts it into one
of ``width`` buckets, and a bucket keeps its total weight and, for each bit of
the hash, the weight of the items with that bit set. An item that holds more
than half of a bucket can be read off bit by bit. Sketches of partitions are
added bucket by bucket; what they decode to is then counted exactly in a second
pass, for the decoded candidates alone. Buckets that stay heavy without their
candidates may hide another item: only what falls into such a bucket on every
level is counted exactly, too, so no item is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stable

#: Odd multipliers of the bucket hashes, one for each level of the sketch (fixed values).
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
BITS = 64


def buckets_of(items: np.ndarray, level: int, width: int) -> np.ndarray:
    """Buckets of 64-bit hashes on a level."""
    return ((items.view(np.uint64) * np.uint64(MIXERS[level])) >> np.uint64(40)).astype(np.int64) % width


def add_to_sketch(sketch: np.ndarray, items: np.ndarray, weights: np.ndarray) -> None:
    """Adds weighted items to ``sketch`` (depth x width x 65, int64)."""
    items, inverse = np.unique(items, return_inverse=True)
    weights = np.bincount(inverse, weights=weights)
    raw = items.view(np.uint64)
    bits = np.unpackbits(raw.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cells = np.concatenate([np.ones((len(raw), 1), np.uint8), bits], axis=1)
    depth, width, _ = sketch.shape
    for level in range(depth):
        bucket = buckets_of(items, level, width)
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        sums = np.add.reduceat(cells[order] * weights[order, None], starts, axis=0)
        sketch[level, bucket[order][starts]] += sums.astype(np.int64)


def sketch_rows(items: DataFrame, depth: int, width: int) -> DataFrame:
    """One row ``level, bucket, cells`` for each bucket in use, summed over all partitions.

    ``items``: ``item`` and ``weight``, both BIGINT. A task sends at most
    depth x width rows, whatever the number of items. Neighbouring partitions
    are sketched together, so that there are at most two sketches for each core,
    however many partitions the input has.
    """
    items = items.coalesce(2 * items.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((depth, width, BITS + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                add_to_sketch(sketch, batch.column(0).to_numpy(), batch.column(1).to_numpy())
        level, bucket = np.nonzero(sketch[:, :, 0])
        for at in range(0, len(level), 1000):
            x, y = level[at : at + 1000], bucket[at : at + 1000]
            flat = pa.array(sketch[x, y].ravel())
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (BITS + 1)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), cells], ["level", "bucket", "cells"])

    parts = items.mapInArrow(run, "level int, bucket int, cells array<bigint>")
    summed = [F.sum(F.col("cells")[i]).alias(f"c{i}") for i in range(BITS + 1)]
    return parts.groupBy("level", "bucket").agg(*summed).select("level", "bucket", F.array(*[f"c{i}" for i in range(BITS + 1)]).alias("cells"))


def decode(sketch: DataFrame, least: float) -> DataFrame:
    """``level, bucket, total, item`` of the buckets whose total is at least ``least``; ``item`` is the one that holds more than half, if any does."""
    total = F.col("cells")[0]
    heavy = sketch.where(total >= F.lit(least))
    bit = F.lit(1).cast("bigint")
    item = F.lit(0).cast("bigint")
    for i in range(BITS):
        item = item.bitwiseOR(F.when(F.col("cells")[i + 1] * 2 > total, F.shiftleft(bit, i)).otherwise(F.lit(0).cast("bigint")))
    return heavy.select("level", "bucket", total.alias("total"), item.alias("item"))


def hidden_items(hashed: DataFrame, open_buckets: np.ndarray) -> DataFrame:
    """Rows of ``hashed`` (``hash`` first) whose hash falls into an open bucket on every level; ``open_buckets`` is depth x width of marks."""
    depth, width = open_buckets.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            kept = np.ones(len(hashes), bool)
            for level in range(depth):
                kept &= open_buckets[level, buckets_of(hashes, level, width)]
            yield batch.filter(pa.array(kept))

    return hashed.mapInArrow(run, hashed.schema)


def frequent_items(
    rows: DataFrame, key: str, item: Column, weight: Column, share: float, depth: int = 5, width: int | None = None
) -> DataFrame:
    """Items with at least ``share`` of the total weight: ``item, weight, total``.

    ``rows`` may hold an id of ``key`` twice; it counts once. Rows whose
    ``item`` is null add to the total but are no items; a null or negative
    weight counts as 0; rows without an id are left out. ``width`` (default:
    the power of two from 8 / share) and ``depth`` bound the memory of a task
    to depth x width x 65 numbers. Counts are exact, as the decoded candidates
    (at most depth x width) are counted again, and so are the rows that fall
    into unexplained buckets on every level, where a further item could hide
    (none, as a rule; the pass is left out if some level has no such bucket).
    An empty table gives no rows.
    """
    width = width or 1 << int(np.ceil(np.log2(8 / share)))
    plain = rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), item.alias("item"), F.greatest(F.coalesce(weight, F.lit(0)), F.lit(0)).cast("bigint").alias("weight")
    )
    total = plain.groupBy("id").agg(F.max("weight").alias("weight")).agg(F.sum("weight")).first()[0] or 0
    least = max(1.0, share * total)
    known = plain.where("item is not null and weight > 0").select(F.xxhash64("item").alias("hash"), "item", "id", "weight")
    heavy = decode(sketch_rows(known.select(F.col("hash").alias("item"), "weight"), depth, width), least).collect()  # at most depth x width rows
    wanted = plain.sparkSession.createDataFrame([(h,) for h in {r["item"] for r in heavy}], "hash bigint")

    def counted(hits: DataFrame) -> DataFrame:
        """Exact weights, each id once, and ``raw`` ones as the sketch has them."""
        once = hits.groupBy("hash", "item", "id").agg(F.max("weight").alias("weight"), F.sum("weight").alias("raw"))
        return once.groupBy("hash", "item").agg(F.sum("weight").alias("weight"), F.sum("raw").alias("raw"))

    found = stable(counted(known.join(F.broadcast(wanted), "hash")))
    explained = found.groupBy("hash").agg(F.sum("raw").alias("raw")).collect()  # at most depth x width rows
    rest = np.zeros((depth, width))
    for r in heavy:
        rest[r["level"], r["bucket"]] = r["total"]
    hashes, raw = np.array([r["hash"] for r in explained], np.int64), np.array([r["raw"] for r in explained], float)
    for level in range(depth):
        np.subtract.at(rest[level], buckets_of(hashes, level, width), raw)
    if (rest >= least).any(axis=1).all():
        found = found.unionByName(counted(hidden_items(known, rest >= least).join(F.broadcast(wanted), "hash", "left_anti")))
    return found.where(F.col("weight") >= F.lit(float(share)) * F.lit(total)).select("item", "weight", F.lit(total).cast("bigint").alias("total"))


def one_strand(mer: Column) -> Column:
    """The smaller of a mer and its reverse complement in lower case; null where another symbol than acgt occurs."""
    low = F.lower(F.btrim(mer, F.lit(" \t\r\n")))
    back = F.reverse(F.translate(low, "acgt", "tgca"))
    return F.when(low.rlike("^[acgt]+$"), F.least(low, back))

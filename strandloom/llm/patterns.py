"""Frequent ordered patterns with gaps, by direct comparison of sequences.

Within a block, every sequence stands for its least pattern that is not yet
decided. If the first and the threshold-th of the sorted sequences hold the
same pattern it is frequent; if not, no pattern before the threshold-th can be
frequent, and all sequences before it move on to their first pattern from there
on, so infrequent patterns are skipped and never counted.

A run of many sequences is divided into blocks by a hash of the sequence. A
pattern that a given share of a run holds has at least that share in one of its
blocks; what the blocks of a divided run find is counted again over all of its
blocks. Shuffled are the rows once and, for divided runs, their patterns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stable

#: Rows that a block holds on average at most.
BLOCK_ROWS = 100_000
#: Numbers from which patterns are held as Python's whole numbers.
DONE = np.iinfo(np.int64).max


class Sequence:
    """One sequence of item numbers (ascending numbers are ascending items) that finds its least pattern from a bound on."""

    def __init__(self, places: np.ndarray, items: np.ndarray, base: int) -> None:
        """``places`` ascend; items at the same place do not follow each other."""
        self.base = base
        self.at: dict[int, list[int]] = {}
        for p, x in zip(places.tolist(), items.tolist()):
            self.at.setdefault(x, []).append(p)
        self.last = {x: ps[-1] for x, ps in self.at.items()}
        self.order = sorted(self.at)

    def after(self, item: int, place: float) -> float | None:
        for p in self.at[item]:
            if p > place:
                return p
        return None

    def least(self, bound: tuple[int, ...], follows: set[int] | None, length: int, place: float = -np.inf, before: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """The least pattern of ``length`` items that is at least ``bound``; ``follows`` holds the pairs (as numbers) a pattern may contain."""
        low = bound[0] if bound else 0
        for x in self.order:
            if x < low or self.last[x] <= place:
                continue
            if follows is not None and any(b * self.base + x not in follows for b in before):
                continue
            if length == 1:
                return (*before, x)
            p = self.after(x, place)
            got = self.least(bound[1:] if bound and x == low else (), follows, length - 1, p, (*before, x))
            if got is not None:
                return got
        return None

    def holds(self, pattern: tuple[int, ...]) -> bool:
        place: float | None = -np.inf
        for x in pattern:
            if x not in self.at or (place := self.after(x, place)) is None:
                return False
        return True


def direct_comparison(sequences: list[Sequence], base: int, length: int, threshold: int, follows: set[int] | None = None) -> dict[tuple[int, ...], int]:
    """Patterns of ``length`` items held by at least ``threshold`` sequences, with their supports."""
    powers = [base**i for i in range(length - 1, -1, -1)]
    done = base**length
    kind = np.int64 if done < DONE else object  # numbers of long patterns are Python's

    def number(s: Sequence, bound: int) -> int:
        got = s.least(tuple(bound // p % base for p in powers), follows, length) if bound < done else None
        return done if got is None else sum(x * p for x, p in zip(got, powers))

    found: dict[tuple[int, ...], int] = {}
    now = np.array([number(s, 0) for s in sequences], kind)
    while len(now) >= threshold:
        first, mark = now.min(), np.partition(now, threshold - 1)[threshold - 1]
        if mark == done:
            break
        if first == mark:
            moving = np.flatnonzero(now == first)
            found[tuple(int(first) // p % base for p in powers)] = len(moving)
            bound = int(first) + 1
        else:
            moving, bound = np.flatnonzero(now < mark), int(mark)
        for i in moving:
            now[i] = number(sequences[i], bound)
        if len(now) > 64 and (now == done).mean() > 0.5:
            keep = now != done
            sequences, now = [s for s, k in zip(sequences, keep) if k], now[keep]
    return found


def block_patterns(seq: np.ndarray, pos: np.ndarray, items: np.ndarray, share: tuple[int, int], sequences: int, length: int) -> tuple[dict[tuple, int], int]:
    """Frequent patterns of one block: item values to support, and the number of its sequences."""
    values, codes = np.unique(items, return_inverse=True)
    threshold = max(1, -(-sequences * share[0] // share[1]))
    pairs = np.unique(np.stack([codes, seq]), axis=1)[0]
    often = np.bincount(pairs, minlength=len(values)) >= threshold
    base = int(often.sum())
    if base == 0:
        return {}, sequences
    renumber = np.cumsum(often) - 1
    keep = often[codes]
    seq, pos, codes = seq[keep], pos[keep], renumber[codes[keep]]
    order = np.lexsort((codes, pos, seq))
    seq, pos, codes = seq[order], pos[order], codes[order]
    cuts = np.flatnonzero(np.r_[True, np.diff(seq) != 0, True])
    held = [Sequence(pos[a:b], codes[a:b], base) for a, b in zip(cuts[:-1], cuts[1:])]
    names = values[often]
    found = direct_comparison(held, base, 1, threshold)
    follows = None
    for n in range(2, length + 1):
        found = direct_comparison(held, base, n, threshold, follows)
        if n == 2:
            follows = {a * base + b for a, b in found}
    return {tuple(names[list(p)]): s for p, s in found.items()}, sequences


def frequent_patterns(
    rows: DataFrame, run: str, seq: str, pos: str, item: str, share: tuple[int, int] = (1, 5), length: int = 3, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Patterns of ``length`` items held by at least ``share`` of a run's sequences.

    Result: ``run, item1..itemN, support``. Items stand at strictly rising
    places of one sequence with any gaps and may repeat; a sequence supports a
    pattern once. Rows with a null in any of the four columns are left out, for
    the number of sequences too. Repeated rows change nothing. Items that share
    a place are alternatives there. An empty table gives no rows.
    """
    names = [f"{item}{i + 1}" for i in range(length)]
    plain = rows.select(F.col(run).cast("bigint").alias("run"), F.col(seq).cast("bigint").alias("seq"), F.col(pos).cast("bigint").alias("pos"), F.col(item).alias("item")).dropna()
    blocks = plain.groupBy("run").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).where("blocks > 1")
    laid = plain.join(blocks, "run", "left").select(
        "run", F.coalesce(F.pmod(F.xxhash64("seq"), "blocks"), F.lit(0).cast("bigint")).alias("block"), F.coalesce("blocks", F.lit(1)).alias("blocks"), "seq", "pos", "item"
    )
    fields = [pa.field("run", pa.int64()), pa.field("block", pa.int64()), pa.field("blocks", pa.int32()), *[pa.field(n, pa.string()) for n in names], pa.field("support", pa.int64()), pa.field("sequences", pa.int64())]
    columns = ", ".join(f"{n} string" for n in names)

    def mine(group: pa.Table) -> pa.Table:
        number = lambda c: group.column(c).to_numpy()
        held = len(np.unique(number("seq")))
        found, _ = block_patterns(number("seq"), number("pos"), number("item").astype(str), share, held, length)
        n = max(1, len(found))  # the row without a pattern carries the number of sequences
        ids = [[number(c)[0]] * n for c in ("run", "block", "blocks")]
        mers = [[p[i] for p in found] or [None] for i in range(length)]
        return pa.table([*ids, *mers, list(found.values()) or [0], [held] * n], schema=pa.schema(fields))

    schema = f"run bigint, block bigint, blocks int, {columns}, support bigint, sequences bigint"
    found = laid.groupBy("run", "block").applyInArrow(mine, schema)
    whole = blocks.isEmpty()
    if not whole:
        found = stable(found)
    done = found.where(F.col("blocks") == 1).where(F.col(names[0]).isNotNull()).select("run", *names, "support")
    if whole:
        return done.withColumnsRenamed({"run": run})
    return done.unionByName(_recounted(laid, found, names, columns, share)).withColumnsRenamed({"run": run})


def _recounted(laid: DataFrame, found: DataFrame, names: list[str], columns: str, share: tuple[int, int]) -> DataFrame:
    """Patterns of runs in several blocks, each counted in every block of its run."""
    parts = found.where("blocks > 1")
    sizes = parts.select("run", "block", "sequences").distinct().groupBy("run").agg(F.sum("sequences").alias("sequences"))
    wanted = parts.where(F.col(names[0]).isNotNull()).select("run", "blocks", *names).distinct()
    everywhere = wanted.select("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), *names)

    fields = [pa.field("run", pa.int64()), *[pa.field(n, pa.string()) for n in names], pa.field("support", pa.int64())]

    def count(rows: pa.Table, patterns: pa.Table) -> pa.Table:
        if not rows.num_rows or not patterns.num_rows:
            return pa.schema(fields).empty_table()
        wanted = np.stack([patterns.column(n).to_numpy().astype(str) for n in names], axis=1)
        values, codes = np.unique(wanted, return_inverse=True)
        seq, pos, item = (rows.column(c).to_numpy() for c in ("seq", "pos", "item"))
        kept = np.isin(item.astype(str), values)
        seq, pos, items = seq[kept], pos[kept], np.searchsorted(values, item[kept].astype(str))
        order = np.lexsort((items, pos, seq))
        seq, pos, items = seq[order], pos[order], items[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(seq) != 0, True]) if len(seq) else np.zeros(1, int)
        held = [Sequence(pos[a:b], items[a:b], len(values)) for a, b in zip(cuts[:-1], cuts[1:])]
        support = [sum(s.holds(tuple(p)) for s in held) for p in codes.reshape(wanted.shape).tolist()]
        return pa.table([patterns.column("run"), *[patterns.column(n) for n in names], pa.array(support, pa.int64())], schema=pa.schema(fields))

    hits = laid.where("blocks > 1").groupBy("run", "block").cogroup(everywhere.groupBy("run", "block"))
    counted = hits.applyInArrow(count, f"run bigint, {columns}, support bigint").groupBy("run", *names).agg(F.sum("support").alias("support"))
    return counted.join(sizes, "run").where(F.col("support") * share[1] >= F.col("sequences") * share[0]).select("run", *names, "support")

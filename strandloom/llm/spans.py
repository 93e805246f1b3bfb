"""Long stretches that stand verbatim in several records, by de Bruijn compaction.

Windows of ``size`` symbols are edges between their first and last ``size - 1``
symbols. Only edges that occur in two records at least are kept; paths of them
without branches are compacted to one path, and an edge becomes (path, place on
it). Edges are named by the first place where they stand. Most follow each
other there, too, so runs of them are joined where they lie, and only the seams
between runs are left to pointer doubling. Occurrences of the edges of a path
that follow each other in a record, by their coordinates in it, form one span,
and spans of several paths are joined where they touch.

Most windows are unique, so they never become rows: a record is first cut into
stretches of windows with the same minimizer, and only stretches whose
minimizer occurs in two records are taken apart. Equal windows have equal
minimizers, so nothing shared is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import bare, small, stable
from .minimizers import SYMBOLS, rolled, scrambled, stretches, window_minima
from .pointers import double_pointers

#: Symbols of a piece; longer records are cut into overlapping pieces.
PIECE = 1 << 16
#: Minimizers of several records that are broadcast at most (32 MB); more are joined by shuffling.
MOST_CODES = 1_000_000
#: Places of a block within which runs of edges are joined without pointers, as a power of two.
BLOCK = 16


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbol numbers of all texts with an unknown behind each, and the texts' first places."""
    raw = [t.encode() + b"n" for t in texts.to_pylist()]
    starts = np.cumsum([0, *map(len, raw)])[:-1]
    return SYMBOLS[np.frombuffer(b"".join(raw), np.uint8)], starts


def addressed(records: DataFrame) -> tuple[DataFrame, int]:
    """``key, text, rid`` with a running number for each row, and the bits that a place in a text needs.

    Records are written once; their numbers come from the counts of the
    written partitions. A place in all records is ``rid`` shifted by these bits
    plus the place in the record.
    """
    laid = stable(records.select("key", "text", F.monotonically_increasing_id().alias("_mid"))).withColumn("_part", F.shiftright("_mid", 33))
    sizes = laid.groupBy("_part").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest")).collect()  # one row for each partition
    offsets, total = [], 0
    for r in sorted(sizes):
        offsets.append((r["_part"], total))
        total += r["n"]
    bits = max((r["longest"] or 0 for r in sizes), default=0).bit_length() + 1
    if total.bit_length() + bits > 62:
        raise ValueError("too many records of this length")
    first = laid.sparkSession.createDataFrame(offsets, "_part bigint, _first bigint")
    rid = F.col("_first") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(small(first, 1_000_000), "_part").select("key", "text", rid.alias("rid")), bits


def minimizer_stretches(records: DataFrame, bits: int, size: int = 40, short: int = 20) -> DataFrame:
    """``at, n, code``: stretches of ``n`` windows without unknowns and with one minimizer; ``at`` is the place of the first.

    ``records``: ``rid`` and ``text`` (clean). Texts shorter than a window have
    none. Symbols other than acgt are unknown.
    """
    pieces = records.where(F.length("text") >= size).select(
        "rid", "text", F.explode(F.sequence(F.lit(0), F.length("text") - size, F.lit(PIECE))).alias("place")
    ).select((F.shiftleft("rid", bits) + F.col("place")).alias("at"), F.substring("text", F.col("place") + 1, F.lit(PIECE + size - 1)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = _joined(batch.column(1))
            unknown = np.cumsum(np.r_[0, codes == 4])
            valid = unknown[size:] == unknown[:-size]
            minima = window_minima(scrambled(rolled(np.where(codes == 4, 0, codes), short, 4)), size - short + 1).astype(np.int64)
            minima[~valid] = -1
            first, end = stretches(minima)
            kept = minima[first] >= 0
            first, end = first[kept], end[kept]
            row = np.searchsorted(starts, first, "right") - 1
            at = batch.column(0).to_numpy()[row] + first - starts[row]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((end - first).astype(np.int32)), pa.array(minima[first])], ["at", "n", "code"])

    return pieces.mapInArrow(run, "at bigint, n int, code bigint")


def candidate_pieces(records: DataFrame, bits: int, size: int = 40) -> DataFrame:
    """``at, piece``: texts of the windows whose minimizer occurs in two records, those next to each other together."""
    cut = stable(minimizer_stretches(records, bits, size, size // 2))
    rid = F.shiftright("at", bits)
    several = stable(cut.groupBy("code").agg(F.min(rid).alias("a"), F.max(rid).alias("b")).where("a <> b").select("code"))
    places = cut.join(small(several, MOST_CODES), "code", "left_semi").groupBy(rid.alias("rid")).agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("xs"))  # of one record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets, flat = lists.offsets.to_numpy(), lists.values
            at, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            first = np.r_[True, at[1:] != at[:-1] + n[:-1]]
            first[offsets[:-1]] = True
            begins = np.flatnonzero(first)
            last = np.r_[begins[1:], len(at)] - 1
            row = np.searchsorted(offsets, begins, "right") - 1
            place = at[begins] & ((1 << bits) - 1)
            ends = (at[last] & ((1 << bits) - 1)) + n[last] + size - 1
            texts = batch.column(0).to_pylist()
            cuts = [texts[r][a:b] for r, a, b in zip(row.tolist(), place.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(at[begins]), pa.array(cuts, pa.string())], ["at", "piece"])

    return records.join(places, "rid").select("text", "xs").mapInArrow(run, "at bigint, piece string")


def windows(pieces: DataFrame, size: int = 40) -> DataFrame:
    """``at, hi, lo`` of every window of the pieces; ``hi`` and ``lo`` hold its symbols exactly."""
    low = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = _joined(batch.column(1))
            count = np.diff(np.r_[starts, len(codes)]) - size
            row = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            place = np.repeat(starts, count) + step
            codes = np.where(codes == 4, 0, codes)
            high, lows = rolled(codes, size - low, 4)[place], rolled(codes, low, 4)[place + size - low]
            at = batch.column(0).to_numpy()[row] + step
            for a in range(0, len(row), 100_000):
                b = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(at[b]), pa.array(high[b]), pa.array(lows[b])], ["at", "hi", "lo"])

    return pieces.select("at", "piece").mapInArrow(run, "at bigint, hi bigint, lo bigint")


def repeated_edges(found: DataFrame, bits: int) -> DataFrame:
    """``hi, lo, edge`` of the windows that occur in different records; ``edge`` is the first place where one stands."""
    rid = F.shiftright("at", bits)
    return found.groupBy("hi", "lo").agg(F.min("at").alias("edge"), F.min(rid).alias("a"), F.max(rid).alias("b")).where("a <> b").select("hi", "lo", "edge")


def _node(size: int, first: bool) -> Column:
    """First or last ``size - 1`` symbols of an edge."""
    low = size // 2
    hi, lo = F.col("hi"), F.col("lo")
    if first:
        head = F.shiftleft(hi.bitwiseAND(F.lit(3).cast("bigint")), 2 * (low - 1))
        return F.struct(F.shiftright(hi, 2).alias("nh"), head.bitwiseOR(F.shiftright(lo, 2)).alias("nl"))
    return F.struct(hi.bitwiseAND(F.lit((1 << 2 * (size - low - 1)) - 1)).alias("nh"), lo.alias("nl"))


def edge_links(edges: DataFrame, size: int = 40) -> DataFrame:
    """``id, ptr``: edges and those before them, where the node between them has no other edge in or out."""
    sides = F.array(F.struct(_node(size, True).alias("node"), F.lit(True).alias("out")), F.struct(_node(size, False).alias("node"), F.lit(False).alias("out")))
    ends = edges.select("edge", F.inline(sides)).select("edge", "node.nh", "node.nl", "out")
    plain = ends.groupBy("nh", "nl").agg(
        F.count_if("out").alias("n_out"), F.count_if(~F.col("out")).alias("n_in"), F.max(F.when(F.col("out"), F.col("edge"))).alias("id"), F.max(F.when(~F.col("out"), F.col("edge"))).alias("ptr")
    )
    return plain.where("n_in = 1 and n_out = 1 and id <> ptr").select("id", "ptr")


def joined_runs(links: DataFrame) -> DataFrame:
    """``id, ptr, run``: where an edge follows the one right before its own place, ``run`` is the first edge of such a run in its block, else null."""
    block = F.shiftright("id", BLOCK)
    follows = (F.col("ptr") == F.col("id") - 1) & (F.shiftright(F.col("id") - 1, BLOCK) == block)
    order = Window.partitionBy("block").orderBy("id")
    rows = links.select("id", "ptr", block.alias("block"), follows.alias("follows"))
    goes_on = (F.lag("id").over(order) == F.col("id") - 1) & F.lag("follows").over(order)
    rows = rows.withColumn("first", F.when(F.col("follows") & ~F.coalesce(goes_on, F.lit(False)), F.col("id") - 1))
    run = F.max("first").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("id", "ptr", F.when(F.col("follows"), run).alias("run"))


def compacted(edges: DataFrame, size: int = 40) -> DataFrame:
    """``hi, lo, path, step``: each edge's place on its path without branches; ``path`` is the path's first edge.

    Runs of edges that follow each other where they first stand are joined
    there; their seams are links between runs, which pointer doubling follows.
    Edges of closed circles stay paths of their own, run by run.
    """
    linked = stable(joined_runs(edge_links(edges, size)))
    inner = linked.where(F.col("run").isNotNull())
    seams = linked.where(F.col("run").isNull()).select("id", "ptr").join(inner.select(F.col("id").alias("ptr"), F.col("run").alias("_run")), "ptr", "left")
    between = seams.select("id", F.coalesce("_run", "ptr").alias("ptr"), (F.lit(1) + F.coalesce(F.col("ptr") - F.col("_run"), F.lit(0))).alias("steps"))
    starts = double_pointers(between, []).select(F.col("id").alias("run"), F.col("ptr").alias("path"), "steps")
    own = edges.join(inner.select(F.col("id").alias("edge"), "run"), "edge", "left").select("hi", "lo", "edge", F.coalesce("run", "edge").alias("run"))
    step = F.col("edge") - F.col("run") + F.coalesce("steps", F.lit(0))
    return own.join(starts, "run", "left").select("hi", "lo", F.coalesce("path", "run").alias("path"), step.alias("step"))


def shared_spans(records: DataFrame, key: str, text: str, size: int = 40) -> DataFrame:
    """Maximal stretches of each record whose windows of ``size`` symbols all occur in other records.

    Result ``key, span_start, span_end``, 0-based and half-open, in the text
    without white space and in lower case. A window with another symbol than
    acgt is not shared. Records count once for each key: give one row for each
    key. Null keys or texts, empty and short texts have no spans, nor has an
    empty table. ``size`` is 22 to 62.
    """
    plain, bits = addressed(records.select(F.col(key).alias("key"), bare(F.col(text)).alias("text")).dropna())
    pieces = stable(candidate_pieces(plain, bits, size))
    edges = stable(repeated_edges(windows(pieces, size), bits))
    on_path = windows(pieces, size).join(compacted(edges, size), ["hi", "lo"]).select(F.shiftright("at", bits).alias("rid"), "at", "path", (F.col("at") - F.col("step")).alias("lead"))
    order = Window.partitionBy("rid").orderBy("at")
    before = lambda c: F.lag(c).over(order)
    goes_on = (before("at") == F.col("at") - 1) & (before("path") == F.col("path")) & (before("lead") == F.col("lead"))
    visits = (
        on_path.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("visit", F.sum("fresh").over(order))
        .groupBy("rid", "visit").agg(F.min("at").alias("begin"), (F.max("at") + size).alias("end"))
    )
    order = Window.partitionBy("rid").orderBy("visit")
    touches = F.col("begin") <= F.lag("end").over(order)
    spans = (
        visits.withColumn("fresh", F.when(touches, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(order))
        .groupBy("rid", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    )
    base = F.shiftleft("rid", bits)
    return spans.join(plain.select("rid", "key"), "rid").select(F.col("key").alias(key), (F.col("begin") - base).alias("span_start"), (F.col("end") - base).alias("span_end"))


def shared_part(records: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """How much of each record is shared: ``key, n_symbols, n_shared, share``; 0 for records without spans, share null for empty ones."""
    sizes = records.select(key, F.coalesce(F.length(bare(F.col(text))), F.lit(0)).cast("bigint").alias("n_symbols"))
    sums = spans.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    shared = F.coalesce("n_shared", F.lit(0)).cast("bigint")
    return sizes.join(sums, key, "left").select(
        key, "n_symbols", shared.alias("n_shared"), F.round(F.when(F.col("n_symbols") > 0, shared / F.col("n_symbols")), 6).alias("share")
    )

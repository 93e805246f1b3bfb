"""Evaluation sequences that stand, exactly or almost, in a training split of the same fold.

An evaluation text with at most e edits to another text is cut into e + 1
passages, of which one at least stands verbatim in the other. The passages are
sharded by the minimizer of their first symbols; for every shard an
Aho-Corasick automaton scans the stretches of training texts that have the same
minimizer. Stretches whose minimizer no passage has are dropped where they are
cut, by a Bloom filter of the passages' minimizers, so most of the training
text is read once and never shuffled. Matched intervals are merged into the
coverage of each pair of texts, and covered pairs are verified by their edit
distance.

Equal texts are one text throughout; sequence ids come back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cleaned, small, stable
from .minimizers import SYMBOLS, rolled, scrambled, window_minima

#: Symbols at a passage's start that choose its shard, at most; the share of them that its minimizer takes; and how many of them there must be at least.
HEAD, SHORT_SHARE, LEAST_HEAD = 16, (7, 8), 4
#: Passages of one automaton and training stretches of one scan, on average at most.
MOST_PASSAGES, MOST_STRETCHES = 20_000, 100_000
#: Shards that are planned on one machine at most; more are joined by shuffling.
MOST_SHARDS = 50_000
#: Bits of the Bloom filter at most (32 MB) and for each passage; a full filter drops nothing, which costs time but no pairs.
MOST_BITS, BITS_EACH = 1 << 28, 16
#: Texts with a larger share of unknowns are compared only with texts that have a similar one.
UNKNOWN_SHARE = 0.10


def split_of(train: Column, test: Column) -> tuple[Column, Column]:
    """Role (``train``, ``test``, null) and fold, the number before the file's extension; a blank name is none."""
    train, test = (F.nullif(F.trim(c), F.lit("")) for c in (train, test))
    name = F.coalesce(train, test)
    role = F.when(train.isNotNull(), "train").when(test.isNotNull(), "test")
    return role, F.regexp_extract(name, r"(\d+)\.[^.\\/]*$", 1).try_cast("int")


def most_edits(length: np.ndarray | int, percent: int = 4) -> np.ndarray | int:
    """Most edits between a text of this length and any other, at ``percent`` of the longer one."""
    longest = length * 100 // (100 - percent)
    return longest * percent // 100


def passage_size(least: int, percent: int = 4) -> tuple[int, int]:
    """Least and largest size of the passages of texts with at least ``least`` symbols; longer texts lie between those of the lengths tried."""
    n = np.arange(least, least + 20_000)
    parts = most_edits(n, percent) + 1
    return int((n // parts).min()), int((-(-n // parts)).max())


def head_size(least: int, percent: int = 4) -> tuple[int, int]:
    """Symbols of a passage's head and of its minimizer; an error where passages are too short to have a head."""
    size, _ = passage_size(least, percent)
    if size < LEAST_HEAD:
        raise ValueError(f"texts of {least} symbols with {percent} % of edits have passages of {size} symbols; {LEAST_HEAD} are needed")
    head = min(HEAD, size)
    return head, max(1, head * SHORT_SHARE[0] // SHORT_SHARE[1])


def unknown_slack(percent: int = 4) -> float:
    """How much the shares of unknowns of two texts may differ if ``percent`` of the longer one are edits.

    Deleting p % of a text raises the share of the rest by p / (100 - p) at most; every other edit changes it less.
    """
    return percent / (100 - percent) + 1e-9


def _minima(texts: pa.Array, head: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, one behind another with zeros between, their starts and sizes, and the minimizer of the head at each place."""
    raw = [t.encode() for t in texts.to_pylist()]
    sizes = np.array([len(t) for t in raw], int)
    starts = np.cumsum(np.r_[0, sizes + 1])[:-1]
    symbols = np.frombuffer(b"\0".join([*raw, b"\0" * head]), np.uint8)
    codes = SYMBOLS[symbols]
    minima = window_minima(scrambled(rolled(codes, short, 5)), head - short + 1).astype(np.int64)
    return symbols, starts, sizes, minima


def _unknown_shares(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.cumsum(np.r_[0, symbols == ord("n")])
    return (upto[starts + sizes] - upto[starts]) / np.maximum(sizes, 1)


def passages(texts: DataFrame, percent: int = 4, least: int = 60) -> DataFrame:
    """``fold, kind, tid, size, place, edits, passage, code``: the texts cut into one passage more than they can have edits.

    ``size`` is that of the text. ``kind`` is 1 for texts with many unknowns.
    ``code`` is the minimizer of the passage's head.
    """
    head, short = head_size(least, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, starts, sizes, minima = _minima(batch.column(2), head, short)
            kinds = (_unknown_shares(symbols, starts, sizes) > UNKNOWN_SHARE).astype(np.int32)
            edits = most_edits(sizes, percent)
            row = np.repeat(np.arange(len(sizes)), edits + 1)
            part = np.arange(len(row)) - np.repeat(np.cumsum(edits + 1) - edits - 1, edits + 1)
            place, end = part * sizes[row] // (edits[row] + 1), (part + 1) * sizes[row] // (edits[row] + 1)
            text, at = symbols.tobytes().decode(), starts[row]
            texts = [text[a:b] for a, b in zip((at + place).tolist(), (at + end).tolist())]
            take = pa.array(row)
            whole = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), whole(kinds[row]), batch.column(1).take(take), whole(sizes[row]), whole(place), whole(edits[row]), pa.array(texts, pa.string()), pa.array(minima[at + place])],
                ["fold", "kind", "tid", "size", "place", "edits", "passage", "code"],
            )

    return texts.select("fold", "tid", "text").mapInArrow(run, "fold int, kind int, tid bigint, size int, place int, edits int, passage string, code bigint")


def _bits(codes: np.ndarray, folds: np.ndarray, n: int) -> list[np.ndarray]:
    """Two places in a filter of ``n`` bits, a power of two, for each minimizer in its fold."""
    x = (codes.astype(np.uint64) ^ (folds.astype(np.int64).astype(np.uint64) << np.uint64(40))) * np.uint64(0x9E3779B97F4A7C15)
    return [((x ^ (x >> np.uint64(s))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) & np.uint64(n - 1) for s in (29, 37)]


def bloom_filter(heads: DataFrame, count: int) -> np.ndarray:
    """Bits of a Bloom filter of all ``fold, code`` in words of 64; there are at most ``MOST_BITS``, whatever the count, and they are put together by an aggregation."""
    n = 1 << max(12, min(MOST_BITS.bit_length() - 1, int(count * BITS_EACH).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n, bool)
        for batch in batches:
            for at in _bits(batch.column(1).to_numpy(), batch.column(0).to_numpy(), n):
                held[at] = True
        words = np.packbits(held, bitorder="little").view("<i8")
        used = np.flatnonzero(words)
        for a in range(0, len(used), 100_000):
            part = used[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part])], ["word", "bits"])

    rows = heads.select("fold", "code").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # 4 194 304 rows at most
    words = np.zeros(n // 64, np.int64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return words


def training_stretches(texts: DataFrame, longest: int, bloom: np.ndarray, percent: int = 4, least: int = 60) -> DataFrame:
    """``fold, kind, tid, size, place, piece, code``: stretches with one head minimizer, long enough for any passage that starts in them.

    Those whose minimizer is not in the filter are left out.
    """
    head, short = head_size(least, percent)
    slack = unknown_slack(percent)
    held = texts.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            symbols, starts, sizes, minima = _minima(batch.column(2), head, short)
            row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - head + 1, 0))
            count = np.bincount(row, minlength=len(sizes))
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            codes = minima[starts[row] + place]
            first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, int)
            last = np.r_[first[1:], len(row)][: len(first)] - 1
            folds = batch.column(0).to_numpy()
            known = np.ones(len(first), bool)
            for at in _bits(codes[first], folds[row[first]], len(bits) * 64):
                known &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)).astype(np.int64)) & 1 == 1
            first, last = first[known], last[known]
            unknown = _unknown_shares(symbols, starts, sizes)
            text = symbols.tobytes().decode()
            for kind, fits in enumerate((unknown <= UNKNOWN_SHARE + slack, unknown >= UNKNOWN_SHARE - slack)):
                mine = fits[row[first]]
                a, r = first[mine], row[first[mine]]
                begin = starts[r] + place[a]
                end = np.minimum(begin + place[last[mine]] - place[a] + longest, starts[r] + sizes[r])
                texts = [text[x:y] for x, y in zip(begin.tolist(), end.tolist())]
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array(np.full(len(a), kind, np.int32)), batch.column(1).take(take), pa.array(sizes[r].astype(np.int32)), pa.array(place[a].astype(np.int32)), pa.array(texts, pa.string()), pa.array(codes[a])],
                    ["fold", "kind", "tid", "size", "place", "piece", "code"],
                )

    return texts.select("fold", "tid", "text").mapInArrow(run, "fold int, kind int, tid bigint, size int, place int, piece string, code bigint")


def scan(shards: DataFrame) -> DataFrame:
    """Matches ``fold, kind, passage, tid, size, at`` of rows ``fold, kind, part, wanted, pieces``: an automaton of ``wanted`` scans ``pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for batch in batches:
            for r in range(batch.num_rows):
                wanted = batch.column(2)[r].values.to_pylist()
                machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                for i, w in enumerate(wanted):
                    machine.add_word(w, i)
                machine.make_automaton()
                pieces = batch.column(3)[r].values
                hit: list[tuple[int, int, int]] = [(i, last, w) for i, piece in enumerate(pieces.field(3).to_pylist()) for last, w in machine.iter(piece)]
                which, last, word = np.array(hit, np.int64).reshape(-1, 3).T
                lengths = np.array([len(w) for w in wanted], np.int64)
                at = (pieces.field(2).to_numpy()[which] + last + 1 - lengths[word]).astype(np.int32)
                for a in range(0, len(hit), 50_000):
                    b = slice(a, a + 50_000)
                    n, take = len(at[b]), pa.array(which[b])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(c)[r].as_py()] * n, pa.int32()) for c in (0, 1)] + [pa.array(wanted).take(pa.array(word[b])), pieces.field(0).take(take), pieces.field(1).take(take), pa.array(at[b])],
                        ["fold", "kind", "passage", "tid", "size", "at"],
                    )

    return shards.select("fold", "kind", "wanted", "pieces").mapInArrow(run, "fold int, kind int, passage string, tid bigint, size int, at int")


def matches(cut: DataFrame, texts: DataFrame, longest: int, percent: int = 4, least: int = 60) -> DataFrame:
    """All places of training texts where a passage of the same fold and kind stands: ``fold, kind, passage, tid, size, at``.

    Shards are sized by counting: their number follows the passages, and a
    shard with more passages or stretches than its bounds is divided further,
    so that a hot minimizer is scanned by many tasks. Every part of its
    passages then scans every part of its stretches; of other shards each
    stretch is scanned once.
    """
    count = cut.count()
    n = max(1, -(-count // MOST_PASSAGES))
    shard = F.pmod(F.xxhash64("code"), F.lit(n)).alias("shard")
    pieces = training_stretches(texts, longest, bloom_filter(cut, count), percent, least)
    if count * BITS_EACH > MOST_BITS:  # the filter is too full to be exact enough
        pieces = pieces.join(cut.select("fold", "kind", "code").distinct(), ["fold", "kind", "code"], "left_semi")
    left = cut.select("fold", "kind", shard, "passage")
    right = stable(pieces.select("fold", "kind", shard, F.struct("tid", "size", "place", "piece").alias("piece")))
    key = ["fold", "kind", "shard"]

    def divided(df: DataFrame, most: int, by: Column, part: str) -> DataFrame:
        parts = df.groupBy(*key).agg(F.ceil(F.count("*") / most).cast("int").alias("n"))
        return df.join(small(parts, MOST_SHARDS), key).withColumn(part, F.pmod(F.xxhash64(by), F.col("n")).cast("int")).drop("n")

    left = divided(left, MOST_PASSAGES, F.col("passage"), "lpart")
    right = divided(right, MOST_STRETCHES, F.struct("piece.tid", "piece.place"), "rpart")
    machines = left.groupBy(*key, "lpart").agg(F.collect_set("passage").alias("wanted"))
    texts = right.groupBy(*key, "rpart").agg(F.collect_list("piece").alias("pieces"))
    return scan(machines.join(texts, key))


def overlapping_splits(rows: DataFrame, key: str, seq: str, train: str, test: str, percent: int = 4, least: int = 60) -> DataFrame:
    """Pairs of a training and a test row of one fold with almost equal text: ``key_a, key_b, distance, covered``.

    ``rows`` has one row for each key. Texts are cleaned (no white space, lower
    case, unknowns stripped from the ends) and need ``least`` known symbols.
    The edit distance is at most ``percent`` of the longer text; other symbols
    than acgt count as symbols. The smaller key comes first. ``covered`` is the
    number of symbols of the test text in matched passages. Rows without key,
    text, file or fold are left out; a row named in both a training and a test
    file counts as training. Empty tables give no rows. Where ``least`` and
    ``percent`` leave passages of fewer than ``LEAST_HEAD`` symbols, it is an
    error.
    """
    role, fold = split_of(F.col(train), F.col(test))
    _, longest = passage_size(least, percent)
    head_size(least, percent)
    plain = rows.select(F.col(key).alias("key"), role.alias("role"), fold.alias("fold"), cleaned(F.col(seq)).alias("text"))
    known = stable(plain.withColumn("tid", F.xxhash64("fold", "text"))).dropna().where(F.length(F.replace("text", F.lit("n"))) >= least)
    members = known.select("key", "role", "tid")
    is_test = F.col("role") == "test"
    texts = stable(known.groupBy("tid").agg(F.first("fold").alias("fold"), F.first("text").alias("text"), F.bool_or(is_test).alias("test"), F.bool_or(~is_test).alias("train")))
    cut = stable(passages(texts.where("test"), percent, least))
    hits = matches(cut, texts.where("train"), longest, percent, least)
    tests = cut.select("fold", "kind", "passage", F.col("tid").alias("test"), F.col("size").alias("test_size"), "place", "edits")
    pairs = (
        hits.join(tests, ["fold", "kind", "passage"])
        .where((F.abs(F.col("at") - F.col("place")) <= F.col("edits")) & (F.abs(F.col("size") - F.col("test_size")) * 100 <= percent * F.greatest("size", "test_size")))
        .groupBy("test", F.col("tid").alias("train"), "place")
        .agg(F.max(F.length("passage")).alias("length"))
        .groupBy("test", "train")
        .agg(F.sum("length").cast("bigint").alias("covered"))
    )
    a = texts.select(F.col("tid").alias("test"), F.col("text").alias("x"))
    b = texts.select(F.col("tid").alias("train"), F.col("text").alias("y"))
    edits = F.floor(F.greatest(F.length("x"), F.length("y")) * percent / 100).cast("int")
    bag = [F.length("x") - F.length(F.replace("x", F.lit(c))) - F.length("y") + F.length(F.replace("y", F.lit(c))) for c in "acgtn"]
    over, under = (sum((F.greatest(s * d, F.lit(0)) for d in bag), F.lit(0)) for s in (1, -1))
    near = (
        pairs.join(a, "test").join(b, "train").withColumn("edits", edits)
        .where((F.abs(F.length("x") - F.length("y")) <= F.col("edits")) & (F.greatest(over, under) <= F.col("edits")))
        .withColumn("distance", F.expr("levenshtein(x, y, edits)"))
        .where("distance >= 0")
        .select("test", "train", "distance", "covered")
    )
    tested = members.where("role = 'test'").select(F.col("tid").alias("test"), F.col("key").alias("k1"))
    trained = members.where("role = 'train'").select(F.col("tid").alias("train"), F.col("key").alias("k2"))
    return near.join(tested, "test").join(trained, "train").select(
        F.least("k1", "k2").alias(f"{key}_a"), F.greatest("k1", "k2").alias(f"{key}_b"), "distance", "covered"
    )

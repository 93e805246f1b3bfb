"""Scores of position weight matrices at every place of every sequence.

A matrix is a small list of K rows of four probabilities on the driver; its
K x 5 log scores (the fifth for an unknown) travel as literals, so scoring is a
projection without shuffle. ``sequences`` holds ``seq_id, obs`` with codes 0 to
4. A sequence shorter than the matrix has no scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]
LOG_QUARTER = math.log(0.25)
#: Places whose scores together are one table of 5**BLOCK numbers at most (0.6 MB).
BLOCK = 7


def log_scores(matrix: Matrix) -> list[list[float]]:
    """Logs of the probabilities and, for an unknown, of a quarter."""
    if any(len(row) != 4 for row in matrix):
        raise ValueError("a matrix has four columns")
    return [[math.log(p) if p > 0 else -math.inf for p in row] + [LOG_QUARTER] for row in matrix]


def complementary(scores: Matrix) -> list[list[float]]:
    """Scores of the other strand: rows reversed, symbol s at 3 - s."""
    return [[row[3], row[2], row[1], row[0], row[4]] for row in reversed(scores)]


def matrix_rows(spark: SparkSession, scores: Matrix) -> DataFrame:
    """A matrix as rows ``pos, sym, score``."""
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(scores) for j, x in enumerate(row)], "pos int, sym int, score double")


def score_array(obs: Column, scores: Matrix) -> Column:
    """Array of the scores of all windows, the start of the window first."""
    rows = [F.array(*[F.lit(float(x)) for x in row]) for row in scores]
    k = len(rows)

    def at(s: Column) -> Column:
        total = F.lit(0.0)
        for p, row in enumerate(rows):
            total = total + F.get(row, F.get(obs, s + p))
        return total

    starts = F.when(F.size(obs) >= k, F.sequence(F.lit(0), F.size(obs) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, at)


def score_sequences(sequences: DataFrame, scores: Matrix, background: Column | None = None) -> DataFrame:
    """``seq_id, start, score`` of every window, less ``background`` (an array with a value for each start) if given."""
    values = score_array(F.col("obs"), scores)
    if background is not None:
        values = F.zip_with(values, background, lambda a, b: a - b)
    return sequences.select("seq_id", F.posexplode(values).alias("start", "score"))


def best_window(obs: Column, scores: Matrix, background: Column | None = None) -> Column:
    """Struct ``score, start`` of the best window, the first one of equals; null if there is none."""
    values = score_array(obs, scores)
    if background is not None:
        values = F.zip_with(values, background, lambda a, b: a - b)
    marked = F.transform(values, lambda x, i: F.struct(x.alias("score"), (-i).alias("at")))
    best = F.array_max(marked)
    return F.when(F.size(values) > 0, F.struct(best["score"].alias("score"), (-best["at"]).alias("start")))


def max_scores(sequences: DataFrame, scores: Matrix) -> DataFrame:
    """``seq_id, score, start`` of each sequence's best window; null for too short sequences."""
    return sequences.select("seq_id", best_window(F.col("obs"), scores).alias("b")).select("seq_id", "b.score", "b.start")


def both_strands(sequences: DataFrame, scores: Matrix) -> DataFrame:
    """``seq_id, forward, reverse, best`` scores."""
    one, two = (best_window(F.col("obs"), s)["score"] for s in (scores, complementary(scores)))
    return sequences.select("seq_id", one.alias("forward"), two.alias("reverse")).withColumn("best", F.greatest("forward", "reverse"))


def matrices_of_mer(mer: str, width: int, pseudo: float = 0.4) -> tuple[list[list[float]], list[list[float]]]:
    """Matrices of ``width`` and ``width`` + 1 rows around a mer, the longer with an open place in its middle."""

    def matrix(letters: list[int | None]) -> list[list[float]]:
        rows = [[pseudo + (1.0 if x == s else 0.0) for s in range(4)] for x in letters]
        return [[v / sum(row) for v in row] for row in rows]

    known: list[int | None] = ["acgt".index(c) if c in "acgt" else None for c in mer.lower()]
    left = (width - len(known)) // 2
    padded = [None] * left + known + [None] * (width - len(known) - left)
    middle = width // 2
    return matrix(padded), matrix([*padded[:middle], None, *padded[middle:]])


def evaluate_start(sequences: DataFrame, mer: str, width: int) -> DataFrame:
    """How well a mer starts a motif search: the sum of each sequence's best score with and without a gap on both strands.

    A sequence scores at least (width + 1) * ln 0.25, as it does if it is too short.
    """
    floor = (width + 1) * LOG_QUARTER
    parts = []
    for m in matrices_of_mer(mer, width):
        s = log_scores(m)
        parts += [best_window(F.col("obs"), x)["score"] for x in (s, complementary(s))]
    return sequences.select(F.greatest(*parts, F.lit(floor)).alias("s")).agg(F.lit(mer).alias("mer"), F.sum("s").alias("value"))


def _window_scores(scores: Sequence[Matrix], codes: dict[int, np.ndarray], size: int) -> np.ndarray:
    """The best score of several matrices of equal width at every window; ``codes`` has the numbers of the windows of each width."""
    width = len(scores[0])
    parts = []
    for at in range(0, width, BLOCK):
        rows = [np.array(s[at : at + BLOCK]) for s in scores]
        tables = [x[0] for x in rows]
        for p in range(1, len(rows[0])):
            tables = [(t[:, None] + x[p]).ravel() for t, x in zip(tables, rows)]
        parts.append((tables, codes[len(rows[0])][at : at + size]))
    if len(parts) == 1:
        return np.maximum.reduce(parts[0][0]).take(parts[0][1])
    return np.maximum.reduce([sum(tables[i].take(code) for tables, code in parts) for i in range(len(scores))])


def evaluate_starts(sequences: DataFrame, mers: Sequence[str], width: int) -> list[float]:
    """The values of ``evaluate_start`` of several mers, in one pass over the sequences."""
    groups = []
    for mer in mers:
        two = [log_scores(m) for m in matrices_of_mer(mer, width)]
        groups.append([[s, complementary(s)] for s in two])
    floor = (width + 1) * LOG_QUARTER
    needed = {min(BLOCK, w - at) for w in (width, width + 1) for at in range(0, w, BLOCK)}

    def values(lists: pa.ListArray) -> np.ndarray:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and (np.isnan(flat.astype(float)).any() or flat.min() < 0 or flat.max() > 4):
            raise ValueError("a code is none of 0 to 4")
        sizes = np.array(pc.fill_null(pc.list_value_length(lists), 0), int)
        begin = np.cumsum(sizes) - sizes
        codes, code = {}, np.zeros(len(flat), np.intp)
        for n in range(1, max(needed) + 1):
            code = code[: len(flat) - n + 1] * 5 + flat[n - 1 :]
            if n in needed:
                codes[n] = code
        best = np.full((len(mers), len(sizes)), floor)
        for j, w in enumerate((width, width + 1)):
            rows = np.flatnonzero(sizes >= w)
            if not len(rows):
                continue
            bounds = np.column_stack([begin[rows], begin[rows] + sizes[rows] - w + 1]).ravel()
            for i, group in enumerate(groups):
                scores = np.append(_window_scores(group[j], codes, len(flat) - w + 1), -np.inf)
                best[i, rows] = np.maximum(best[i, rows], np.maximum.reduceat(scores, bounds)[::2])
        return best.sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(mers))
        for batch in batches:
            for a in range(0, batch.num_rows, 2500):
                total += values(batch.column(0).slice(a, 2500))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mers)), pa.int32()), pa.array(total)], ["i", "value"])

    got = [0.0] * len(mers)
    for r in sequences.select(F.col("obs").cast("array<int>")).mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():  # a row for each mer
        got[r["i"]] = r["value"]
    return got


def information(p: Column, background: Column | float = 0.25) -> Column:
    """Term p (ln p - ln background) of the information content in nats; 0 at p = 0."""
    log_bg = F.log(background) if isinstance(background, Column) else F.lit(math.log(background))
    return F.when(p > 0, p * (F.log(F.when(p > 0, p)) - log_bg)).otherwise(0.0)


def information_content(rows: DataFrame) -> DataFrame:
    """``pos, nats`` of rows ``pos, sym, p`` against a uniform background."""
    return rows.groupBy("pos").agg(F.sum(information(F.col("p"))).alias("nats"))


def entropy(p: Column, base: float = math.e) -> Column:
    """Term -p log p of an entropy; 0 at p = 0."""
    return F.when(p > 0, -p * F.log(F.when(p > 0, p)) / math.log(base)).otherwise(0.0)


def logo_heights(rows: DataFrame) -> DataFrame:
    """``pos, sym, height`` of a sequence logo: p times the 2 - H bits of its place."""
    bits = rows.groupBy("pos").agg((2 - F.sum(entropy(F.col("p"), 2))).alias("r"))
    return rows.join(bits, "pos").select("pos", "sym", (F.col("p") * F.col("r")).alias("height"))


def frequencies(sequences: DataFrame, width: int | None = None) -> DataFrame:
    """``pos, sym, p``: frequencies of the known symbols at the first ``width`` places of aligned sequences, or at all places."""
    obs = F.col("obs") if width is None else F.slice("obs", 1, width)
    cells = sequences.select(F.posexplode(obs).alias("pos", "sym")).where("sym between 0 and 3").groupBy("pos", "sym").agg(F.count("*").alias("n"))
    totals = cells.groupBy("pos").agg(F.sum("n").alias("t"))
    return cells.join(totals if width is None else F.broadcast(totals), "pos").select("pos", "sym", (F.col("n") / F.col("t")).alias("p"))

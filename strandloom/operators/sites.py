"""Sites: stretches of a sequence whose states are outside of the background.

Paths are arrays in their sequence's row, so runs are found within the row and
no shuffle is needed. Starts and ends are half-open. Null paths give no sites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..models.hidden import HiddenModel
from . import infer


def runs(marks: Column) -> Column:
    """Array of structs ``start, end`` of the maximal runs of true in an array of booleans; null counts as false."""

    def of(m: Column) -> Column:
        on = lambda i: F.coalesce(F.get(m, i), F.lit(False))
        places = F.when(F.size(m) > 0, F.sequence(F.lit(0), F.size(m) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: on(i) & ~on(i - 1))
        ends = F.transform(F.filter(places, lambda i: on(i) & ~on(i + 1)), lambda i: i + 1)
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    return F.transform(F.array(marks), of)[0]  # the marks are made once, not for each place


def outside(path: Column, background: list[int]) -> Column:
    """Where a path is not in the background."""
    return F.transform(path, lambda s: ~s.isin(background))


def find_sites(decoded: DataFrame, background: list[int], reverse_of: dict[int, int] | None = None) -> DataFrame:
    """``seq_id, start, end, site, states, is_rev_comp`` of rows ``seq_id, obs, path``.

    With ``reverse_of`` (forward state of each reverse state), sites that begin
    in a reverse state are turned: symbols reversed and complemented, states
    reversed and replaced.
    """
    rows = decoded.select("seq_id", "obs", "path", F.explode(runs(outside(F.col("path"), background))).alias("r"))
    cut = lambda c: F.slice(c, F.col("r.start") + 1, F.col("r.end") - F.col("r.start"))
    rows = rows.select("seq_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"), cut("obs").alias("site"), cut("path").alias("states"))
    if not reverse_of:
        return rows.withColumn("is_rev_comp", F.lit(False))
    is_rev = F.get("states", F.lit(0)).isin(list(reverse_of))
    swap = F.create_map(*[F.lit(x) for pair in reverse_of.items() for x in pair])
    turned = F.transform(F.reverse("site"), lambda x: F.when(x > 3, x).otherwise(3 - x))
    states = F.transform(F.reverse("states"), lambda s: F.coalesce(F.try_element_at(swap, s), s))
    return rows.select(
        "seq_id", "start", "end", F.when(is_rev, turned).otherwise(F.col("site")).alias("site"), F.when(is_rev, states).otherwise(F.col("states")).alias("states"), is_rev.alias("is_rev_comp")
    )


def indicator_sites(rows: DataFrame, column: str) -> DataFrame:
    """``seq_id, start, end`` of the runs of 1 in an array of 0 and 1."""
    return rows.select("seq_id", F.explode(runs(F.transform(column, lambda x: x != 0))).alias("r")).select("seq_id", "r.start", "r.end")


def site_symbols(rows: DataFrame, column: str) -> DataFrame:
    """Like ``indicator_sites`` with the symbols of each site as ``site``."""
    found = rows.select("seq_id", "obs", F.explode(runs(F.transform(column, lambda x: x != 0))).alias("r"))
    return found.select("seq_id", "r.start", "r.end", F.slice("obs", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("site"))


#: States by their numbers, or as a test of a state that may use other columns of its row.
States = list[int] | Callable[[Column], Column]


def _within(s: Column, states: States) -> Column:
    return F.coalesce(states(s) if callable(states) else s.isin(states), F.lit(False))


def mask_sites(decoded: DataFrame, states: States, unknown: int) -> DataFrame:
    """``seq_id, obs``: symbols in the given states made unknown; symbols without a state stay, also beyond the end of a path and where it is null."""
    masked = F.transform("obs", lambda o, i: F.when(_within(F.get("path", i), states), F.lit(unknown)).otherwise(o))
    return decoded.select("seq_id", masked.alias("obs"))


def mask_counts(decoded: DataFrame, states: States, starts: States) -> DataFrame:
    """One row: how many sites (states of ``starts``) and symbols masking would remove."""
    n = lambda which: F.coalesce(F.sum(F.size(F.filter("path", lambda s: _within(s, which)))), F.lit(0)).cast("bigint")
    return decoded.agg(n(starts).alias("n_sites"), n(states).alias("n_symbols"))


def decode(sequences: DataFrame, model: HiddenModel) -> DataFrame:
    """``seq_id, obs, path, log_p``; the path is computed beside its sequence, without a join."""
    packed = sequences.select(F.struct("seq_id", "obs").alias("seq_id"), "obs")
    return infer.best_paths(packed, model).select("seq_id.seq_id", "seq_id.obs", "path", "log_p")


def predict(sequences: DataFrame, model: HiddenModel, background: list[int]) -> DataFrame:
    """``seq_id, pred``: 1 for every symbol of a predicted site."""
    return infer.best_paths(sequences, model).select("seq_id", infer.indicators(F.col("path"), background).alias("pred"))


def analyse(sequences: DataFrame, model: HiddenModel, background: list[int], reverse_of: dict[int, int] | None = None, blank: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sites of all sequences, and the sequences, with the sites made unknown if wanted."""
    decoded = decode(sequences, model)
    found = find_sites(decoded, background, reverse_of)
    if not blank:
        return found, sequences
    inside = [s for s in range(model.states) if s not in background]
    return found, mask_sites(decoded, inside, model.symbols)

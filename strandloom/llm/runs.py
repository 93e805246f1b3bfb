"""Runs of equal or similar consecutive events, collapsed by pointer doubling.

Every event that matches the event right before it points to that event. Each
round of self-joins replaces a pointer by its target's pointer, so pointers
reach twice as far after a round and a run of n events needs about log2(n)
rounds. Every join is on unique keys: an event whose pointer has arrived at its
run's start leaves the probing side, and the others all have different targets,
so neither a long run nor a hot sequence gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import small, stable
from .pointers import double_pointers

#: Fragments are a fixed table of 24 rows; beyond this many they are joined by shuffling.
MOST_FRAGMENTS = 10_000


def near(a: Column, b: Column, most: int = 1) -> Column:
    """Both known, not empty, equally long and unlike at no more than ``most`` positions; ``n`` is unlike nothing."""
    unlike = F.filter(
        F.sequence(F.lit(1), F.length(a)),
        lambda i: (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
        & (F.substr(a, i, F.lit(1)) != "n")
        & (F.substr(b, i, F.lit(1)) != "n"),
    )
    alike = (F.length(a) > 0) & (F.length(a) == F.length(b))
    return F.coalesce(F.when(alike, F.size(unlike) <= most), F.lit(False))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``at``, a gapless global row number in the given order.

    Rows are range-partitioned, so a hot key is spread over several tasks, and
    written once; the row counts of the partitions, of which there are at most
    ``spark.sql.shuffle.partitions``, give the offset of each partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = stable(ranged.withColumn("_mid", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_mid", 33))
    counts = laid.groupBy("_part").count().collect()  # one row for each of the partitions
    offsets, total = [], 0
    for p, n in sorted((r["_part"], r["count"]) for r in counts):
        offsets.append((p, total))
        total += n
    first = df.sparkSession.createDataFrame(offsets, "_part bigint, _first bigint")
    place = F.col("_first") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(small(first, parts), "_part").withColumn("at", place).drop("_mid", "_part", "_first")


def path_links(sequences: DataFrame, fragments: DataFrame) -> DataFrame:
    """Links of ``q_star``: adjacent positions with equal or tied states other than background.

    ``sequences`` has one row for each ``seq_id``. State s of a fragment with
    motif length K is tied to 2K+1-s; without a known fragment only equal
    states match. Null arrays and elements and state 0 end a run.
    """
    k = fragments.select(F.upper(F.trim("fragment")).alias("_f"), F.col("motif_len").alias("_k")).dropDuplicates(["_f"])
    seqs = sequences.select("seq_id", "q_star", F.upper(F.trim("fragment")).alias("_f"))
    pairs = seqs.join(small(k, MOST_FRAGMENTS), "_f", "left").select(
        "seq_id",
        "_k",
        F.posexplode(
            F.arrays_zip(F.col("q_star").alias("s"), F.concat(F.array(F.lit(None).cast("int")), "q_star").alias("p"))
        ).alias("pos", "x"),
    )
    s, p, tie = F.col("x.s"), F.col("x.p"), F.col("_k") * 2 + 1
    same = (s != 0) & (p != 0) & ((s == p) | F.coalesce(s + p == tie, F.lit(False)))
    return pairs.where(same).select(
        F.lit("q_star").alias("field"), "seq_id", F.col("pos").cast("long").alias("id"), (F.col("pos") - 1).cast("long").alias("ptr")
    )


def site_order(sites: DataFrame) -> DataFrame:
    """Sites with their global place ``at``, ordered by sequence, time and id.

    ``sites`` has one row for each ``site_id``. Sites without sequence or time
    have no place in an order and are left out.
    """
    known = sites.where(F.col("seq_id").isNotNull() & F.col("found_at").isNotNull())
    text = F.lower(F.regexp_replace("sites", r"^\s+|\s+$", ""))
    return numbered(known.select("seq_id", "found_at", "site_id", text.alias("site")), ["seq_id", "found_at", "site_id"])


def site_links(ordered: DataFrame) -> DataFrame:
    """Links of sites near the site right before them in the same sequence."""
    before = ordered.select((F.col("at") + 1).alias("at"), F.col("seq_id").alias("_seq"), F.col("site").alias("_site"))
    both = ordered.join(before, "at").where((F.col("seq_id") == F.col("_seq")) & near(F.col("site"), F.col("_site")))
    return both.select(F.lit("sites").alias("field"), "seq_id", F.col("at").alias("id"), (F.col("at") - 1).alias("ptr"))


def collapse_runs(sequences: DataFrame, sites: DataFrame, fragments: DataFrame) -> DataFrame:
    """Every run of at least two events as one row ``field, seq_id, run_start, run_count, run_duration``.

    For ``q_star`` the start is the 0-based position and the duration equals
    the count; for ``sites`` the start is the first site's id and the duration
    the seconds from the first to the last ``found_at``. Empty tables give no
    rows; repeated deliveries must be removed before (``runtime.once``).
    """
    ordered = site_order(sites)
    links = path_links(sequences, fragments).unionByName(site_links(ordered))
    homes = double_pointers(links, ["field", "seq_id"])
    runs = homes.groupBy("field", "seq_id", F.col("ptr").alias("at")).agg(
        (F.count("*") + 1).alias("run_count"), F.max("id").alias("last")
    )
    path = runs.where("field = 'q_star'").select(
        "field", "seq_id", F.col("at").alias("run_start"), "run_count", F.col("run_count").alias("run_duration")
    )
    first = ordered.select("at", "site_id", F.unix_seconds(F.col("found_at").cast("timestamp")).alias("began"))
    last = ordered.select(F.col("at").alias("last"), F.unix_seconds(F.col("found_at").cast("timestamp")).alias("ended"))
    found = (
        runs.where("field = 'sites'")
        .join(first, "at")
        .join(last, "last")
        .select("field", "seq_id", F.col("site_id").alias("run_start"), "run_count", (F.col("ended") - F.col("began")).alias("run_duration"))
    )
    return path.unionByName(found)

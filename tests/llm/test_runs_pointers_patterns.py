import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import patterns, pointers, runs


def test_pointers_reach_every_start(spark, rows):
    chains = [1, 2, 3, 5, 8, 33, 200]
    links, want, at = [], [], 0
    for n in chains:
        for i in range(1, n):
            links.append((0, at + i, at + i - 1))
            want.append((0, at + i, at, i))
        at += n
    random.Random(1).shuffle(links)
    df = spark.createDataFrame(links, "k int, id long, ptr long")
    assert rows(pointers.double_pointers(df, ["k"])) == sorted(want, key=str)


def test_circles_are_left_out(spark, rows):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (8, 7), (9, 8), (None, 1), (5, None)], "id long, ptr long")
    assert rows(pointers.double_pointers(df, [])) == [(8, 7, 1), (9, 7, 2)]
    assert pointers.double_pointers(df.where("false"), []).count() == 0


@pytest.mark.parametrize(("a", "b", "alike"), [("acgt", "acgt", True), ("acgt", "acga", True), ("acgt", "aagg", False), ("annt", "cggt", True), ("", "", False), ("acg", "acgt", False), (None, "a", False)])
def test_near(spark, a, b, alike):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(runs.near(F.col("a"), F.col("b"))).first()[0] is alike


def test_runs_of_paths_and_sites(spark, rows):
    seqs = spark.createDataFrame(
        [(1, "f", [0, 1, 1, 6, None, 6, 0, 2, 2, 0, 0]), (2, None, [1, 6, 6]), (3, "f", None), (4, "f", []), (5, "g", [3, 3])], "seq_id long, fragment string, q_star array<int>"
    )
    fragments = spark.createDataFrame([("F ", 3)], "fragment string, motif_len int")
    t = lambda s: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)
    sites = spark.createDataFrame(
        [(9, 1, " ACGT", t(0)), (3, 1, "acga", t(5)), (4, 1, "acgN", t(5)), (5, 1, None, t(6)), (6, 1, "acga", t(7)), (7, 2, "acga", t(8)), (8, 2, "acga", t(9)), (10, None, "acga", t(9)), (11, 2, "acga", None)],
        "site_id long, seq_id long, sites string, found_at timestamp",
    )
    got = rows(runs.collapse_runs(seqs, sites, fragments), "field", "seq_id", "run_start", "run_count", "run_duration")
    want = [("q_star", 1, 1, 3, 3), ("q_star", 1, 7, 2, 2), ("q_star", 2, 1, 2, 2), ("q_star", 5, 0, 2, 2), ("sites", 1, 9, 3, 5), ("sites", 2, 7, 2, 1)]
    assert got == sorted(want, key=str)


def test_numbering_has_no_gaps(spark):
    df = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 0)], "a int, b int").repartition(7)
    got = sorted((r["at"], r["a"], r["b"]) for r in runs.numbered(df, ["a", "b"]).collect())
    assert [g[0] for g in got] == list(range(501)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


def brute(rows, share, length):
    runs_, found = {}, {}
    for run, seq, pos, item in rows:
        runs_.setdefault(run, {}).setdefault(seq, []).append((pos, item))
    for run, seqs in runs_.items():
        counts = {}
        for hits in seqs.values():
            own = set()
            for c in itertools.combinations(sorted(hits), length):
                if all(x[0] < y[0] for x, y in zip(c, c[1:])):
                    own.add(tuple(x[1] for x in c))
            for p in own:
                counts[p] = counts.get(p, 0) + 1
        for p, n in counts.items():
            if n * share[1] >= share[0] * len(seqs):
                found[(run, *p, n)] = 1
    return sorted(found, key=str)


@pytest.mark.parametrize("length", [1, 2, 3])
@pytest.mark.parametrize("block", [20, 100_000])
def test_patterns_against_all_combinations(spark, rows, length, block):
    rng = random.Random(length)
    hits = [(run, seq, rng.randrange(12), rng.choice("abcdefgh")) for run in range(3) for seq in range(4 + 6 * run) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame([*hits, *hits[:20], (None, 1, 1, "a"), (1, 1, None, "a"), (1, 1, 1, None)], "r long, s long, p int, m string")
    got = rows(patterns.frequent_patterns(df, "r", "s", "p", "m", (1, 3), length, block))
    assert got == brute(hits, (1, 3), length)


def test_direct_comparison_skips_rare_patterns():
    import numpy as np

    seqs = [patterns.Sequence(np.arange(3), np.array([i, 100, 101]), 200) for i in range(50)]
    found = patterns.direct_comparison(seqs, 200, 2, 25)
    assert found == {(100, 101): 50}


def test_numbers_of_long_patterns_do_not_overflow():
    import numpy as np

    tail = np.arange(290, 300)
    seqs = [patterns.Sequence(np.arange(11), np.r_[i, tail], 300) for i in range(10)]
    found = patterns.direct_comparison(seqs, 300, 9, 8)
    assert found == {p: 10 for p in itertools.combinations(range(290, 300), 9)}


def test_pointers_with_steps(spark, rows):
    df = spark.createDataFrame([(10, 4, 3), (14, 10, 4), (20, 14, 6)], "id long, ptr long, steps long")
    assert rows(pointers.double_pointers(df, [])) == [(10, 4, 3), (14, 4, 7), (20, 4, 13)]

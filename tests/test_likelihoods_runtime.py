import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import runtime
from strandloom.functions.order import Orders
from strandloom.models.builders import Motif, motif_model
from strandloom.models.hidden import dense, random_dense
from strandloom.operators import chain, evaluate, infer, sites, train

ROWS = [[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.1, 0.7], [0.1, 0.1, 0.7, 0.1]]


@pytest.fixture(scope="module")
def seqs(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 7, rng.integers(0, 5, rng.integers(0, 60)).tolist()) for i in range(30)] + [(99, None), (99, [])]
    return spark.createDataFrame(rows, "seq_id long, obs array<int>")


@pytest.mark.parametrize("model", [motif_model(0.05, ROWS), random_dense(3, 4, seed=1), random_dense(12, 4, seed=2)])
def test_likelihoods_agree_and_keep_every_row(seqs, rows, model):
    """Forward, backward and trellis values, with ids that stand in several rows."""
    near = lambda df: [(r[0], None if r[1] is None else round(r[1], 6)) for r in rows(df.select("seq_id", "ll"))]
    forward = near(infer.log_likelihoods(seqs, model))
    assert len(forward) == 32 and (99, None) in forward and (99, 0.0) in forward
    assert forward == near(infer.backward_log_likelihood(seqs, model)) == near(infer.trellis(seqs, model))
    total = infer.total_log_likelihood(seqs, model).first()
    assert total["ll"] == pytest.approx(sum(x for _, x in forward if x is not None), abs=1e-4)
    assert total["n_known"] == sum(x < 4 for r in seqs.collect() for x in r["obs"] or [])


def test_impossible_sequences(spark):
    model = dense([1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [0.0, 1.0]])
    df = spark.createDataFrame([(1, [0, 0]), (2, [0, 1])], "seq_id long, obs array<int>")
    for got in (infer.backward_log_likelihood(df, model), infer._scored(df, model, infer.forward_ll_batch)):
        assert dict(got.collect()) == {1: 0.0, 2: -np.inf}


def test_hard_counts_against_paths(seqs):
    model = random_dense(4, 4, seed=3)
    paths = [(r["path"], o) for r, o in ((r, r["obs"]) for r in sites.decode(seqs.where("obs is not null"), model).collect())]
    sums = train.estimate(seqs, model, hard=True)
    want = np.zeros((4, 4))
    for path, _ in paths:
        for x, y in zip(path, path[1:]):
            want[x, y] += 1
    assert np.array_equal(sums.a, want) and sums.pi.sum() == sum(bool(p) for p, _ in paths)


def test_sweep_is_that_of_single_models(seqs, rows):
    motif = Motif(4, p_site=0.05)
    model, values = motif.model(ROWS), [0.2, 0.01]
    labelled = seqs.where("size(obs) > 0").withColumn("truth", F.col("seq_id") % 2 == 0)
    got = rows(evaluate.roc_sweep(labelled, motif, model, "truth", values))
    want = []
    for p in values:
        own = model.copy()
        motif.set_p_binding(own, p)
        found = evaluate.hits(labelled.select(F.struct("truth").alias("seq_id"), "obs"), [(own, motif.background, 4)])
        want.append((p, *found.agg(*evaluate.confusion(F.col("seq_id.truth"), F.col("hit"))).first()))
    assert got == sorted(want, key=str)
    assert evaluate.hits(labelled, []).where("hit").count() == 0


def test_masks_by_each_row(spark):
    df = spark.createDataFrame([(1, [0, 1, 2, 3], [1, 2, 3], 1), (2, [0, 1], None, 1), (3, [1], [5], None), (4, None, [1, 4], 2)], "seq_id long, obs array<int>, path array<int>, k int")
    inside = lambda s: (s >= 1) & F.coalesce(s <= 2 * F.col("k"), F.lit(True))
    assert dict(sites.mask_sites(df, inside, 4).collect()) == {1: [4, 4, 2, 3], 2: [0, 1], 3: [4], 4: None}
    starts = lambda s: (s == 1) | (s == 2 * F.col("k"))
    assert tuple(sites.mask_counts(df, inside, starts).first()) == (4, 5)


def test_short_negatives_are_reported(spark):
    p = spark.createDataFrame([(1, "acg"), (2, "ac"), (3, "a")], "ord long, seq string")
    n = spark.createDataFrame([(1, "ttttt"), (2, "t")], "ord long, seq string")
    assert dict(evaluate.matched_negatives(p, n, strict=False).collect()) == {1: "ttt", 2: None, 3: None}
    with pytest.raises(Exception, match="long enough"):
        evaluate.matched_negatives(p, n).collect()


@pytest.mark.parametrize("bound", [0, 1000])
def test_chain_values_with_and_without_broadcast(seqs, rows, monkeypatch, bound):
    whole = rows(chain.evaluate(seqs, chain.model(seqs, 5, 1), 5, 1))
    monkeypatch.setattr(chain, "MOST_CELLS", bound)
    assert rows(chain.evaluate(seqs, chain.model(seqs, 5, 1), 5, 1)) == whole
    assert len(whole) == sum(len(r["obs"] or []) for r in seqs.collect())


def test_written_tables_and_their_release(spark, rows):
    df = spark.range(10).withColumn("odd", F.col("id") % 2 == 1)
    got = runtime.stable(df, split="odd")
    assert got.schema.names == ["id", "odd"] and rows(got) == rows(df) and got.where("odd").count() == 5
    folder = got._folder.removeprefix("file:")
    runtime.release(got, "odd=true")
    assert not os.path.exists(f"{folder}/odd=true") and os.path.exists(f"{folder}/odd=false")
    other = runtime.stable(df)
    runtime.release_all(spark)
    assert not os.path.exists(folder) and not os.path.exists(other._folder.removeprefix("file:"))


def test_orders_are_released(spark):
    views = Orders(spark.createDataFrame([(1, [0, 1])], "seq_id long, obs array<int>"), 4)
    view = views[1]
    assert view.is_cached
    views.release()
    assert not view.is_cached

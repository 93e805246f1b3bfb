"""The one-pass forms of the motif searches against the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.models.builders import Motif
from strandloom.models.hidden import dense
from strandloom.operators import infer, kmers, learn, pssm, train

SEQ = "seq_id long, obs array<int>"


def random_obs(n, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, rng.choice(5, rng.integers(0, 60), p=[0.3, 0.2, 0.2, 0.25, 0.05]).tolist()) for i in range(n)]


def test_candidates_of_most_sequences(spark):
    """Texts of one sequence in several rows count once, also a mer beside its reverse complement."""
    df = spark.createDataFrame(random_obs(80) + random_obs(20, 4), SEQ).select("seq_id", F.concat_ws("", F.transform("obs", lambda v: v.cast("string"))).alias("digits"))
    df = df.unionByName(spark.createDataFrame([(1, None), (None, "0123012"), (None, "0123")], "seq_id long, digits string"))
    for k in (3, 5):
        want = kmers.known_only(kmers.top_mers_by_sequences(df, k, 31)).limit(30).select("mer", "total", "num_seqs").collect()
        assert kmers.top_known_by_sequences(df, k, 30).select("mer", "total", "num_seqs").collect() == want
    assert kmers.top_known_by_sequences(df.limit(0), 5, 3).collect() == []


@pytest.mark.parametrize("width", [5, 6, 9])
def test_starts_in_one_pass(spark, width):
    df = spark.createDataFrame([*random_obs(60), (90, None), (91, [])], SEQ)
    mers = ["agt", "ccgta", "tttna"]
    want = [pssm.evaluate_start(df, m, width).first()["value"] for m in mers]
    assert pssm.evaluate_starts(df, mers, width) == pytest.approx(want)
    with pytest.raises(Exception, match="none of 0 to 4"):
        pssm.evaluate_starts(spark.createDataFrame([(1, [0] * 9 + [5])], SEQ), mers, width)


@pytest.mark.parametrize("model", [Motif(3, 0.1).model(), dense([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [[0.5, 0.3, 0.2, 0], [0.1, 0.4, 0.5, 0]])])
def test_expected_counts_against_the_trellis(spark, model):
    """Of packed sequences; the second model cannot produce a t, so sequences with one are left out."""
    rows = [*random_obs(40), (90, None), (91, [])]
    got = train._collected(train.packed_sums(train.packed(spark.createDataFrame(rows, SEQ), model), model), model)
    pi, a, b, ll, bad = np.zeros(model.states), np.zeros((model.states,) * 2), np.zeros((model.states, model.symbols + 1)), 0.0, 0
    emit = model.b_unknown.T
    for _, obs in rows:
        codes, sizes = np.array([obs or []], int), np.array([len(obs or [])])
        alpha, sums = infer.forward_batch(model, codes, sizes)
        if (sums == 0).any():
            ll, bad = -np.inf, bad + 1
            continue
        beta = infer.backward_batch(model, codes, sizes, sums)
        ll += np.log(sums).sum()
        for t, x in enumerate(obs or []):
            b[:, x] += alpha[0, t] * beta[0, t]
            pi += alpha[0, t] * beta[0, t] * (t == 0)
            if t:
                a += alpha[0, t - 1][:, None] * model.a * (emit[x] * beta[0, t] / sums[0, t])
    assert got.impossible == bad and got.ll == pytest.approx(ll)
    assert np.allclose(got.pi, pi) and np.allclose(got.a, a) and np.allclose(got.b, b[:, : model.symbols])


@pytest.mark.parametrize("model", [Motif(3, 0.1).model(), dense([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [[0.5, 0.3, 0.2, 0], [0.1, 0.4, 0.5, 0]])])
def test_paths_against_all_predecessors(spark, model):
    rows = [*random_obs(40), (90, None), (91, [])]
    log_pi, log_a, log_b = model.logs()
    want = {}
    for i, obs in rows:
        phi, came = None, []
        for x in obs or []:
            ways = None if phi is None else phi[:, None] + log_a
            came.append(None if phi is None else [max(np.flatnonzero(w == w.max())) for w in ways.T])
            phi = (log_pi if phi is None else ways.max(0)) + log_b[:, x]
        path = None if obs is None else []
        if obs:
            path = [int(phi.argmax())] if np.isfinite(phi.max()) else None
            for c in came[:0:-1] if path else []:
                path.insert(0, int(c[path[0]]))
        want[i] = path, None if obs is None else 0 if not obs else phi.max()
    for r in infer.best_paths(spark.createDataFrame(rows, SEQ), model).collect():
        path, log_p = want[r["seq_id"]]
        assert r["path"] == path and r["log_p"] == (log_p if log_p is None else pytest.approx(log_p))


def test_several_motifs_train_on_sequences_packed_once(spark, monkeypatch):
    """Each search for a motif packs its sequences once, however many shifts it trains; packed or not, training gives the same."""
    packed, calls = train.packed, []
    monkeypatch.setattr(train, "packed", lambda s, m: calls.append(1) or packed(s, m))
    df, motif = spark.createDataFrame(random_obs(30), SEQ), Motif(4, 0.05, least_information=0.0)
    learn.learn_several(df, motif, find=1, attempts=1, most=2)
    assert len(calls) == 1
    one, two = (train.train(x, motif.model(), most=3)[1] for x in (df, train.held(df, motif.model())))
    assert one == pytest.approx(two)

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.order import OrderCodes
from strandloom.models import builders
from strandloom.models.hidden import HiddenModel, Prior, States, as_model, as_states, dense, normalise_parameters, random_dense
from strandloom.operators import infer, learn, sites, train
from strandloom.sources import models as texts

SEQ = "seq_id int, obs array<int>"
MOTIF = builders.motif_model(0.04, [[0.97, 0.01, 0.01, 0.01], [0.01, 0.01, 0.01, 0.97], [0.01, 0.01, 0.97, 0.01]])
OBS = [0, 0, 0, 3, 2, 0, 0, 1, 0, 3, 0, 0]


def chain_model():
    s = States(4)
    uniform = s.parameter(0.25)
    bg = s.state(s.parameter(1.0), [uniform] * 4)
    likely, other = s.parameter(0.94), s.parameter(0.02)
    own = [s.state(None, [likely if i == k else other for k in range(4)]) for i in range(4)]
    enter, stay, on = s.parameter(0.1), s.parameter(0.9), s.parameter(1.0)
    s.link(bg, own[0], enter)
    s.link(bg, bg, stay)
    for a, b in zip(own, own[1:] + [bg]):
        s.link(a, b, on)
    return s.model()


def best(spark, model, obs, kind="int"):
    r = infer.best_paths(spark.createDataFrame([(1, obs)], f"seq_id int, obs array<{kind}>"), model).first()
    return r["log_p"], r["path"]


def test_best_path_of_motif(spark):
    score, path = best(spark, MOTIF, OBS)
    assert path == [0, 0, 1, 2, 3, 0, 0, 6, 5, 4, 0, 0]
    assert score == pytest.approx(-16.48785540056491)
    df = spark.createDataFrame([(1, OBS)], SEQ)
    assert infer.log_likelihoods(df, MOTIF).first()["ll"] == pytest.approx(-15.301103329090374)
    assert infer.trellis(df, MOTIF).first()["ll"] == pytest.approx(-15.301103329090374)
    assert infer.backward_log_likelihood(df, MOTIF).first()["ll"] == pytest.approx(-15.301103329090374)


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint"])
def test_best_path_with_unknown_for_all_widths(spark, kind):
    score, path = best(spark, chain_model(), [1, 1, 0, 1, 2, 3, 0, 3, 4, 0, 1, 2, 3, 3, 2, 3, 1], kind)
    assert path == [0, 0, 1, 2, 3, 4, 0, 0, 0, 1, 2, 3, 4, 0, 0, 0, 0]
    assert score == pytest.approx(-16.82269139863887)


def test_other_types_are_refused(spark):
    for kind, x in (("double", 1.0), ("boolean", True), ("string", "1")):
        with pytest.raises(TypeError):
            infer.best_paths(spark.createDataFrame([(1, [x])], f"seq_id int, obs array<{kind}>"), MOTIF)


def test_empty_null_and_impossible_sequences(spark):
    model = dense([1, 0], [[1, 0], [0, 1]], [[1, 0], [0.5, 0.5]])
    df = spark.createDataFrame([(1, []), (2, [0, 1]), (3, None), (4, [0, 2])], SEQ)
    paths = {r["seq_id"]: (r["log_p"], r["path"]) for r in infer.best_paths(df, model).collect()}
    assert paths[1] == (0.0, []) and paths[2] == (-np.inf, None) and paths[3] == (None, None) and paths[4] == (0.0, [0, 0])
    ll = {r["seq_id"]: r["ll"] for r in infer.log_likelihoods(df, model).collect()}
    assert ll[1] == 0 and ll[2] == -np.inf and ll[3] is None and ll[4] == 0
    sums = train.estimate(df.where("obs is not null"), model)
    assert sums.impossible == 1 and sums.ll == -np.inf
    with pytest.raises(Exception, match="outside"):
        infer.best_paths(spark.createDataFrame([(1, [3])], SEQ), model).collect()


def brute(model, obs):
    """Likelihood, best path and state posteriors over all paths."""
    import itertools

    pi, a, b = model.pi, model.a, model.b_unknown
    total, post, top = 0.0, np.zeros((len(obs), model.states)), (0.0, None)
    for path in itertools.product(range(model.states), repeat=len(obs)):
        p = pi[path[0]] * b[path[0], obs[0]]
        for t in range(1, len(obs)):
            p *= a[path[t - 1], path[t]] * b[path[t], obs[t]]
        total += p
        for t, q in enumerate(path):
            post[t, q] += p
        if p > top[0]:
            top = (p, list(path))
    return total, post / total, top


@pytest.mark.parametrize("order", [0, 1])
def test_against_all_paths(spark, order):
    model = random_dense(3, 2 ** (order + 1), order, seed=order)
    obs = [[0, 1, 1, 0, 1], [1], [1, 2 ** (order + 1), 0, 0]]
    df = spark.createDataFrame(list(enumerate(obs)), SEQ)
    ll = {r["seq_id"]: r["ll"] for r in infer.log_likelihoods(df, model).collect()}
    gamma = {(r["seq_id"], r["t"], r["i"]): r["gamma"] for r in infer.posteriors(df, model).collect()}
    paths = {r["seq_id"]: r for r in infer.best_paths(df, model).collect()}
    for s, o in enumerate(obs):
        total, post, top = brute(model, o)
        assert ll[s] == pytest.approx(np.log(total))
        assert paths[s]["path"] == top[1] and paths[s]["log_p"] == pytest.approx(np.log(top[0]))
        assert np.allclose([[gamma[s, t, i] for i in range(3)] for t in range(len(o))], post)


def test_first_training_step(spark):
    df = spark.createDataFrame([(1, OBS)], SEQ)
    sums = train.estimate(df, MOTIF)
    assert sums.a[0, [0, 1, 6]] == pytest.approx([6.273889687, 0.656248822, 0.582336933])
    assert sums.pi[0] == pytest.approx(0.99889075)
    assert sums.b[0] == pytest.approx([6.745471263, 0.42564879, 0.42477024, 0.839042601])
    _, history = train.train(df, MOTIF, most=4, tolerance=0)
    assert history == pytest.approx([-15.301103329090374, -6.734161513348437, -4.542464481166202, -4.413731737514312])


@pytest.mark.parametrize(("states", "order"), [(1, 0), (2, 1), (3, 0), (5, 2)])
def test_likelihood_never_falls(spark, states, order):
    rng = np.random.default_rng(states)
    codes = OrderCodes(4, order)
    raw = spark.createDataFrame([(i, rng.integers(0, 5, 60).tolist()) for i in range(3)] + [(9, [])], SEQ)
    df = raw.withColumn("obs", codes.encode(F.col("obs")))
    _, history = train.train(df, random_dense(states, 4 ** (order + 1), order), most=6, tolerance=0)
    assert (np.diff(history) > -1e-10).all()


def test_hard_training_and_callbacks(spark):
    df = spark.createDataFrame([(1, OBS), (2, OBS[::-1])], SEQ)
    _, history = train.train(df, MOTIF, hard=True, most=5, tolerance=0)
    assert (np.diff(history) > -1e-10).all()
    assert len(train.train(df, MOTIF, most=9, tolerance=0, each=lambda n, ll: n < 2)[1]) == 2
    assert len(train.train(df, MOTIF, most=3, tolerance=0, each=lambda n, ll: None)[1]) == 3
    assert train.levelled([-9, -5, -3, -2, -1.5, -1.4, -1.39], 0.02) and not train.levelled([-3, -2], 1)


def test_prior_and_tied_parameters(spark):
    df = spark.createDataFrame([(1, [0, 0])], SEQ)
    model = dense([0.5, 0.5], [[0.5, 0.5], [0.5, 0.5]], [[0.5, 0.5], [0.5, 0.5]])
    got, _ = train.iterate(df, model, Prior(np.ones(2), np.ones((2, 2)), np.full((2, 2), 1e6)))
    assert np.allclose(got.b, 0.5, atol=1e-5)
    with pytest.raises(ValueError):
        train.iterate(df, model, Prior(np.ones(3), np.ones((2, 2)), np.ones((2, 2))))
    trained, _ = train.train(spark.createDataFrame([(1, OBS)], SEQ), MOTIF, most=2)
    assert np.allclose(trained.b[4:7], trained.b[1:4][:, ::-1])


def test_optimise_raises_the_likelihood(spark):
    df = spark.createDataFrame([(1, [0, 0, 0, 1])], SEQ)
    model = dense([1.0], [[1.0]], [[0.5, 0.5]])
    before = infer.total_log_likelihood(df, model).first()["ll"]
    _, after = train.optimise(df, model, [2], steps=12)
    assert after > before + 0.3


def test_reverse_emissions_of_order_2():
    make = builders.Emissions(2)
    s = make.empty()
    forward = make.symbol_state(s, 1.0, [0.1, 0.2, 0.3, 0.4])
    back = make.reverse_state(s, forward)
    for i in (forward, back):
        s.link(i, i, s.parameter(1.0))
    b = pickle.loads(pickle.dumps(s.model())).b
    assert np.allclose(b[back].reshape(-1, 4), b[forward].reshape(-1, 4)[:, ::-1])


DISTS = [[float(x == c) for x in "acgt"] for c in "accagtttgcact"]


@pytest.mark.parametrize("order", [1, 2])
def test_motif_path(spark, order):
    motif = builders.Motif(13, 0.01, order, 2)
    codes = OrderCodes(4, order)
    df = spark.createDataFrame([(1, ["acgt".index(c) for c in "accagtttgcact"])], SEQ).withColumn("obs", codes.encode(F.col("obs")))
    assert infer.best_paths(df, motif.model(DISTS)).first()["path"] == [2 + t for t in range(13)]


@pytest.mark.parametrize("order", [0, 1, 2])
def test_gapped_motif(spark, order):
    motif = builders.GappedMotif(7, 0.1, order, 4)
    model = motif.model(DISTS)
    assert model.a_at[29, 28] == model.a_at[14, 15] != model.a_at[4, 5]
    codes = OrderCodes(4, order)
    df = spark.createDataFrame([(1, ["acgt".index(c) for c in "acgtgat"])], SEQ).withColumn("obs", codes.encode(F.col("obs")))
    assert [(q - 4) // 2 for q in infer.best_paths(df, model).first()["path"]] == list(range(7))
    assert motif.gap_probability(model, 0) == pytest.approx(0.35)
    assert motif.information_per_base(model) == pytest.approx(np.log(4))
    with pytest.raises(IndexError):
        motif.gap(6)
    assert motif.background_prior(0.1, 0.05)[:4].sum(1) == pytest.approx(np.ones(4))
    assert motif.gap_prior(0, 10).sum() == 10


def test_single_gap():
    make = builders.SingleGap(5, 2)
    model = make.complete(0.3, DISTS[:5], 0.01)
    model.check()
    assert model.states == 11 and make.emissions_and_gaps(model, 1)[1].tolist() == pytest.approx([1, 1, 0.3, 1, 1])
    assert np.allclose(model.b[6:11], model.b[1:6][:, ::-1])
    with pytest.raises(ValueError):
        builders.SingleGap(5, 4)
    builders.model_of_mer("acgt", 7, 3).check()


def test_shifts():
    moved = builders.shifted_motif_model(MOTIF, 1, [0.25] * 4)
    assert np.allclose(moved.b[1:4], [*MOTIF.b[2:4], [0.25] * 4]) and moved.pi.sum() == pytest.approx(1)
    motif = builders.Motif(3, 0.04)
    model = motif.model([[0.97, 0.01, 0.01, 0.01], [0.25] * 4, [0.25] * 4])
    assert np.allclose(motif.matrix(motif.alternatives(model)[0])[1], [0.97, 0.01, 0.01, 0.01])
    motif.set_p_binding(model, 0.2)
    assert motif.p_binding(model) == pytest.approx(0.2)
    assert motif.generator().pi[0] == 1 and builders.random_motif_model(0.1, 4).states == 9


@pytest.mark.parametrize("order", range(4))
def test_storage(tmp_path, order):
    model = random_dense(3, 4 ** (order + 1), order)
    for binary in (True, False):
        model.save(str(tmp_path / "m"), binary)
        assert HiddenModel.load(str(tmp_path / "m"), binary).same_as(model)
    assert pickle.loads(pickle.dumps(model)).same_as(model)
    assert as_model(as_states(model)).same_as(model)


def test_text_format():
    got = texts.read_text(["# two", "MODEL:2,2", "TRANSITION:0;1;1.0", "TRANSITION:1;0;0.5 # half", "TRANSITION:1;1;0.5", "EMISSIONS:0;0.1,0.9", "EMISSIONS:1;0.5,0.5"])
    assert got.a.tolist() == [[0, 1], [0.5, 0.5]] and got.pi.tolist() == [0.5, 0.5]
    again = texts.read_text(texts.text_lines(got))
    assert np.allclose(again.a, got.a) and np.allclose(again.b, got.b)
    assert texts.text_lines(got, lambda s: s == 1)[:2] == ["MODEL:1,2", "TRANSITION:0;0;0.5"]
    with pytest.raises(ValueError):
        texts.read_text(["MODEL:1,1", "NOISE:1"])


def test_cache_of_background_models(tmp_path):
    made = []

    def make(order, mosaics, dataset):
        made.append(dataset)
        return builders.mosaic_background(order, mosaics).model()

    one = texts.BackgroundModels(str(tmp_path), make).get(1, 2, "x")
    assert texts.BackgroundModels(str(tmp_path), make).get(1, 2, "x").same_as(one) and made == ["x"]


def test_access_and_errors(spark):
    model = dense([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [[0.5, 0.5], [0.1, 0.9]])
    model.set_emissions(0, [0.2, 0.8])
    assert model.get("b", 0, 1) == pytest.approx(0.8)
    with pytest.raises(ValueError):
        model.set_emissions(0, [1.0])
    with pytest.raises(IndexError):
        model.get("a", 0, 2)
    model.set_parameter_index("a", 0, 1, None)
    assert model.a[0].tolist() == [1, 0] and model.successors()[0].tolist() == [True, False]
    with pytest.raises(ValueError):
        model.set("a", 0, 1, 0.5)
    with pytest.raises(ValueError):
        dense([0, 0], [[1, 0], [0, 1]], [[1], [1]]).check()
    theta = np.zeros(3)
    normalise_parameters(theta, np.array([0, 2, -1]))
    assert theta.tolist() == [0.5, 0, 0.5]
    assert {(r["src"], r["dst"]) for r in model.edges(spark).collect()} == {(0, 0), (1, 0), (1, 1)}
    model.normalise()
    model.check()


def test_sampling(spark, rows):
    model = random_dense(2, 4, 1, seed=3)
    wanted = spark.range(300).select(F.col("id").alias("seq_id"), F.lit(20).alias("length"))
    drawn = infer.sample(wanted, model, 5)
    got = rows(drawn)
    assert got == rows(infer.sample(wanted.repartition(7), model, 5))
    pairs = np.zeros((2, 2, 2))
    for _, q, x in got:
        for t in range(1, 20):
            pairs[q[t], x[t - 1], x[t]] += 1
    assert np.allclose(pairs / pairs.sum(2, keepdims=True), model.b.reshape(2, 2, 2), atol=0.06)
    lengths = [len(r["symbols"]) for r in learn.sample_of_mean_length(spark, model, 200, 30, 1).collect()]
    assert abs(np.mean(lengths) - 30) < 2 and np.std(lengths) > 3
    assert infer.consistent(drawn.withColumnRenamed("symbols", "obs").withColumn("obs", OrderCodes(2, 1).encode(F.col("obs"))), model).where("ok").count() == 300
    assert infer.sample(wanted.withColumn("length", F.lit(0)), model, 5).first()["symbols"] == []


def test_learning(spark):
    rng = np.random.default_rng(1)
    obs = []
    for i in range(30):
        x = rng.integers(0, 4, 40)
        x[10:16] = [0, 2, 3, 0, 1, 2]
        obs.append((i, x.tolist()))
    df = spark.createDataFrame(obs, SEQ)
    digits = df.select("seq_id", F.concat_ws("", F.transform("obs", lambda v: v.cast("string"))).alias("digits"))
    motif = builders.Motif(6, 0.05)
    got = learn.seeded(df, digits, motif, most=8)
    assert motif.is_interesting(got.model)
    found, blanked = sites.analyse(df, got.model, motif.background, motif.reverse_of(), blank=True)
    assert found.where("start = 10 and end = 16").count() >= 25
    assert blanked.select(F.explode("obs").alias("x")).where("x = 4").count() >= 150
    mer, single = learn.single_gap(df, digits, length=7, size=6, candidates=5, most=2)
    assert mer in ("agtacg", "cgtact") and np.isfinite(single.ll)
    assert np.isfinite(learn.improve(df, motif, learn.learn(df, motif, starts=2, most=2), most=2).ll)
    several, rest = learn.learn_several(df, builders.Motif(6, 0.05, least_information=0.0), find=1, attempts=2, most=2)
    assert len(several) == 1 and rest.count() == 30
    assert len(learn.several_passes(df, lambda s: got.model, lambda s, m: sites.analyse(s, m, [0], blank=True)[1], 2)) == 2
    assert learn.synthetic(spark, motif, 5, 30, 1).where("size(obs) = size(truth) and size(obs) = 30").count() == 5


def test_training_queries_reach_the_tolerance(spark):
    from strandloom.operators import train
    from strandloom.plans import queries, views

    folder = "/root/testdata/sf0.001"
    seqs = views.orders(spark, folder)
    bound = train.per_known(seqs, queries.MODEL)
    lls = [r["ll"] for r in queries.trained_history(spark, folder).orderBy("iteration").collect()]
    assert 0 < bound and abs(lls[-1] - lls[-2]) <= bound + 0.001 and all(b - a > bound - 0.001 for a, b in zip(lls[:-2], lls[1:-1]))
    once = train.cross_validated(seqs, queries.MODEL, 3, most=1).agg({"ll": "sum"}).first()[0]
    assert queries.kfold_loglik(spark, folder).agg({"ll": "sum"}).first()[0] > once

"""Expected counts by windows against those of all states."""

import numpy as np
import pyarrow as pa
import pytest

from strandloom.models.builders import GappedMotif, Motif, SingleGap, motif_model
from strandloom.models.hidden import dense
from strandloom.operators import loops, train


def batch(lengths, rows=60, seed=2, p=(0.3, 0.2, 0.2, 0.25, 0.05)):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(*lengths, rows)
    codes = np.full((rows, sizes.max()), 4)
    for r, n in enumerate(sizes):
        codes[r, :n] = rng.choice(5, n, p=p)
    counts, codes = train._in_steps(codes, sizes)
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (counts.astype(np.int32), codes.astype(np.uint8))], ["counts", "codes"])


def uneven(model, seed=7):
    """Other values for all parameters, also for starts within the motif."""
    got = model.copy()
    got.theta = got.theta * np.random.default_rng(seed).uniform(0.5, 1.5, len(got.theta))
    return got


def both(model, groups):
    """Counts of the groups in one go as training takes them, and of all states."""
    kind = [np.int32, np.uint8]
    plain = [train._expected(model, *(np.frombuffer(x.as_buffer(), k) for x, k in zip(g, kind))) for b in groups for g in zip(*b.columns)]
    add = lambda parts: np.sum([np.concatenate([np.ravel(x) for x in p]) for p in parts], axis=0)
    return add(train._packed_parts(model)(iter(groups))), add(plain)


@pytest.mark.parametrize("length, lengths", [(1, (1, 20)), (3, (1, 6)), (6, (1, 6)), (6, (1, 90)), (5, (400, 700))])
def test_windows_count_like_all_states(length, lengths, monkeypatch):
    """Also of sequences that begin or end within a motif, or are shorter than it, and with unknown symbols; no state but the hub is walked."""
    groups = [batch(lengths), batch(lengths, 40, 3)]
    for model in (uneven(Motif(length, 0.1).model()), uneven(motif_model(0.2, np.full((length, 4), 0.25).tolist()))):
        got, want = both(model, groups)
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
        with monkeypatch.context() as m:
            m.setattr(train, "_expected", lambda *_: pytest.fail("all states are walked"))
            assert list(train._packed_parts(model)(iter(groups)))


def test_odds_that_do_not_hold_go_over_all_states():
    """A background without a symbol, no stay in it, no start in it, or a motif whose odds against it could overflow."""
    base, groups = Motif(3, 0.1).model(), [batch((1, 40))]
    none, moving, starting, strong = (base.copy() for _ in range(4))
    none.set("b", 0, 2, 0.0)
    moving.set("a", 0, 0, 0.0)
    starting.set("pi", 0, 0.0)
    for x in range(3):
        strong.set("b", 0, x, 1e-12)
    for model in (none, moving, starting, strong):
        around = loops.loops_of(model)
        assert around is not None and (model is starting or not loops.Windows(model, around).usable)
        got, want = both(model, groups)
        assert np.isfinite(want[:-2]).all() and np.array_equal(np.isfinite(got), np.isfinite(want))
        assert got[np.isfinite(want)] == pytest.approx(want[np.isfinite(want)], rel=1e-9, abs=1e-9)


def test_only_hubs_with_loops_of_one_length():
    assert loops.loops_of(Motif(3).model()).tolist() == [[1, 2, 3], [6, 5, 4]]
    gap = SingleGap(5, 2).complete(0.5, [[0.25] * 4] * 5, 0.1)
    for model in (GappedMotif(3).model(), Motif(3, mosaics=2).model(), Motif(9).model(), gap, dense([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [[0.25] * 4] * 2)):
        assert loops.loops_of(model) is None


def test_held_sequences_take_one_task_a_core_and_one_row_a_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.integers(0, 5, rng.integers(0, 30)).tolist()) for i in range(300)] + [(900, None)], "seq_id long, obs array<int>")
    model = uneven(Motif(4, 0.1).model())
    groups = train.held(df, model)
    assert groups.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    got, summed = train.packed_totals(groups, model), train.estimate(df, model)
    monkeypatch.setattr(train, "MOST_TASKS", 1)
    for other in (summed, train.packed_totals(groups, model)):
        assert got.ll == pytest.approx(other.ll) and got.impossible == other.impossible == 0
        assert np.allclose(got.pi, other.pi) and np.allclose(got.a, other.a) and np.allclose(got.b, other.b)
    groups.unpersist()

"""Motif search: trained models are kept while they are interesting, and their sites blanked.

Loops run on the driver over models; every step over the sequences is a job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import random_sequences
from ..models.builders import Motif, model_of_mer
from ..models.hidden import HiddenModel
from ..runtime import stable
from . import infer, kmers, pssm, sites, train


@dataclass
class Learned:
    model: HiddenModel
    ll: float
    history: list[float]


def known_symbols(sequences: DataFrame, unknown: int) -> int:
    return sequences.agg(F.sum(F.size(F.filter("obs", lambda x: x < unknown)))).first()[0] or 0


def learn(sequences: DataFrame, motif: Motif, starts: int = 3, most: int = 20, hard: bool = False, packed: DataFrame | None = None) -> Learned:
    """The best of several random starts; the tolerance is a millionth of the known symbols. ``packed`` are the sequences packed for training, if they are so already."""
    best: Learned | None = None
    tolerance = 1e-6 * known_symbols(sequences, 4 ** (motif.order + 1))
    sequences = sequences if packed is None else packed
    for i in range(starts):
        own = type(motif)(**{**motif.__dict__, "seed": motif.seed + i})
        model, history = train.train(sequences, own.model(), hard=hard, most=most, tolerance=tolerance)
        if best is None or history[-1] > best.ll:
            best = Learned(model, history[-1], history)
    return best


def improve(sequences: DataFrame, motif: Motif, learned: Learned, most: int = 20) -> Learned:
    """Trains alternatives (shifts) as long as one is better."""
    while True:
        better = False
        for other in motif.alternatives(learned.model):
            model, history = train.train(sequences, other, most=most)
            if history[-1] > learned.ll + 1e-9:
                learned, better = Learned(model, history[-1], history), True
        if not better:
            return learned


def inside(motif: Motif) -> list[int]:
    return list(range(motif.mosaics, motif.states))


def learn_several(sequences: DataFrame, motif: Motif, find: int = 3, attempts: int = 10, starts: int = 1, most: int = 10) -> tuple[list[Learned], DataFrame]:
    """Interesting motifs one after the other; each one's sites are blanked before the next. Also gives the blanked sequences."""
    got: list[Learned] = []
    groups: DataFrame | None = None
    for i in range(attempts):
        if len(got) == find:
            break
        own = type(motif)(**{**motif.__dict__, "seed": motif.seed + 1000 * i})
        if groups is None:
            groups = train.held(sequences, own.model())  # for all trainings on these sequences
        found = improve(groups, own, learn(sequences, own, starts, most, packed=groups), most)
        if own.is_interesting(found.model):
            got.append(found)
            groups.unpersist()
            groups = None
            sequences = stable(sites.analyse(sequences, found.model, own.background, blank=True)[1])
    if groups is not None:
        groups.unpersist()
    return got, sequences


def find_motifs(sequences: DataFrame, learn_one: Callable[[DataFrame], HiddenModel], interesting: Callable[[HiddenModel], bool], blank: Callable[[DataFrame, HiddenModel], DataFrame], find: int, attempts: int) -> list[HiddenModel]:
    """The general loop: learn, judge, blank."""
    got: list[HiddenModel] = []
    for _ in range(attempts):
        if len(got) == find:
            break
        model = learn_one(sequences)
        if interesting(model):
            got.append(model)
            sequences = stable(blank(sequences, model))
    return got


def several_passes(sequences: DataFrame, one_pass: Callable[[DataFrame], HiddenModel], remove: Callable[[DataFrame, HiddenModel], DataFrame], passes: int) -> list[HiddenModel]:
    """``passes`` models, each learned after the sites of those before were removed."""
    return find_motifs(sequences, one_pass, lambda m: True, remove, passes, passes)


def seeded(sequences: DataFrame, digits: DataFrame, motif: Motif, size: int = 5, most: int = 20, hard: bool = False) -> Learned:
    """Training from the most significant mer of ``size`` laid into the middle of the motif."""
    mer = kmers.significances(digits, size).orderBy("logp", "mer").first()["mer"]
    width = motif.length
    model = motif.model(pssm.matrices_of_mer("".join("acgt"[int(c)] for c in mer), width)[0])
    trained, history = train.train(sequences, model, hard=hard, most=most)
    return Learned(trained, history[-1], history)


def single_gap(sequences: DataFrame, digits: DataFrame, length: int = 9, size: int = 7, gap: int | None = None, candidates: int = 150, most: int = 10) -> tuple[str, Learned]:
    """Training of a single-gap motif from the candidate mer with the best sum of scores.

    Candidates are the collapsed mers of most sequences, all scored in one pass
    over the sequences.
    """
    top = kmers.top_known_by_sequences(digits, size, candidates).collect()  # ``candidates`` rows at most
    mers = ["".join("acgt"[int(c)] for c in r["mer"]) for r in top]
    values = pssm.evaluate_starts(sequences, mers, length - 1)
    best = mers[values.index(max(values))]
    model = model_of_mer(best, length, gap or length // 2)
    trained, history = train.train(sequences, model, most=most)
    return best, Learned(trained, history[-1], history)


def sample_of_mean_length(spark, model: HiddenModel, n: int, mean: float, seed: int) -> DataFrame:  # noqa: ANN001
    """``seq_id, states, symbols``: ``n`` drawn sequences with Poisson lengths."""
    lengths = random_sequences(spark, n, mean, seed).select("seq_id", F.size("obs").alias("length"))
    return infer.sample(lengths, model, seed)


def synthetic(spark, motif: Motif, n: int, length: int, seed: int, p_unknown: float = 0.02) -> DataFrame:  # noqa: ANN001
    """``seq_id, obs, truth``: sequences of a generating model with binding indicators and some symbols unknown."""
    from ..functions.symbols import mask_unknown

    wanted = spark.range(n).select(F.col("id").alias("seq_id"), F.lit(length).alias("length"))
    drawn = infer.sample(wanted, motif.generator(), seed)
    return drawn.select("seq_id", mask_unknown(F.col("symbols"), F.col("seq_id"), seed, p_unknown).alias("obs"), infer.indicators(F.col("states"), motif.background).alias("truth"))


__all__ = ["Learned", "find_motifs", "improve", "learn", "learn_several", "sample_of_mean_length", "seeded", "several_passes", "single_gap", "synthetic"]

"""One query for each operator of the core, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import consensus, symbols
from ..functions.order import OrderCodes
from ..models.builders import Motif, motif_model
from ..models.hidden import dense
from ..operators import chain, evaluate, infer, kmers, learn, pssm, sites, train
from ..runtime import shared_folder, stable
from ..sources import fasta as fasta_source
from ..sources import tables
from . import views

#: Three hidden states over five symbols.
MODEL = dense(
    [0.5, 0.3, 0.2],
    [[0.8, 0.15, 0.05], [0.1, 0.7, 0.2], [0.25, 0.25, 0.5]],
    [[0.4, 0.1, 0.1, 0.1, 0.3], [0.1, 0.3, 0.3, 0.2, 0.1], [0.05, 0.15, 0.2, 0.5, 0.1]],
)
#: A motif of six places.
ROWS = [[0.85, 0.05, 0.05, 0.05], [0.05, 0.05, 0.85, 0.05], [0.05, 0.05, 0.05, 0.85], [0.85, 0.05, 0.05, 0.05], [0.05, 0.85, 0.05, 0.05], [0.05, 0.05, 0.85, 0.05]]
SCORES = pssm.log_scores(ROWS)
MOTIF = motif_model(0.02, ROWS)
#: The same motif read backwards, and a model whose binding probability is swept.
OTHER = motif_model(0.02, ROWS[::-1])
SWEPT, SWEEP = Motif(6, p_site=0.02), evaluate.sweep(n=8)
MER = "agtac"
SEED = 7


def _fresh(spark: SparkSession, name: str) -> str:
    """A new folder beside the intermediate tables."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def r6(c):  # noqa: ANN001, ANN201
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# ---- sources and symbols


def fasta_stripped(spark: SparkSession, d: str) -> DataFrame:
    rows = views.fasta(spark, d)
    return rows.select("seq_id", fasta_source.stripped("seq").alias("seq"))


def fasta_wrapped(spark: SparkSession, d: str) -> DataFrame:
    rows = views.fasta(spark, d).where("length(seq) > 0")
    texts = fasta_source.records(rows, F.concat(F.lit("sequence "), F.col("seq_id").cast("string")), F.col("seq"), 80)
    return texts.select(F.md5("value").alias("record"))


def encode_known_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = views.fasta(spark, d)
    return rows.groupBy("fragment").agg(symbols.n_bases(F.col("digits")).alias("n_bases"), symbols.n_known_bases(F.col("digits")).alias("n_known"))


def decoded_letters(spark: SparkSession, d: str) -> DataFrame:
    return views.fasta(spark, d).select("seq_id", symbols.codes_text(F.col("digits")).alias("seq"))


def rev_comp_text(spark: SparkSession, d: str) -> DataFrame:
    return views.fasta(spark, d).select("seq_id", symbols.reverse_complement(F.col("digits")).alias("digits"))


def complement_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = views.dna(spark, d).select(F.explode(symbols.reverse_complement_array(F.col("obs"))).alias("sym"))
    return rows.groupBy("sym").agg(F.count("*").alias("n"))


def masked_sequences(spark: SparkSession, d: str) -> DataFrame:
    rows = views.events(spark, d).select("seq_id", symbols.mask_unknown(F.col("obs"), F.col("seq_id"), SEED, 0.02, 5).alias("obs"))
    return rows.select("seq_id", F.concat_ws("", F.transform("obs", lambda x: x.cast("string"))).alias("obs"))


def sigmoid_values(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("value") - 50) / 10
    rows = views.table(spark, d, "events").where("value is not null").select("event_id", x.alias("x")).withColumn("y", symbols.sigmoid(F.col("x")))
    back = symbols.inverse_sigmoid(F.col("y"))
    return rows.select("event_id", r6("y").alias("y"), symbols.is_close(back, F.col("x"), 1e-6).alias("is_close"))


def log_factorials(spark: SparkSession, d: str) -> DataFrame:
    totals = views.table(spark, d, "mer_count").where("total >= 0").select("total").distinct()
    return totals.select("total", r6(symbols.log_factorial(F.col("total"))).alias("log_factorial"))


def _strings(freq: DataFrame) -> DataFrame:
    columns = freq.groupBy("pos").agg(*[F.sum(F.when(F.col("sym") == i, F.col("p")).otherwise(0.0)).alias(c) for i, c in enumerate("acgt")])
    return symbols.strings_of_distribution(columns, 50)


def distribution_strings(spark: SparkSession, d: str) -> DataFrame:
    """Of the places of the reported sites; ``distribution_strings_all`` is of the records."""
    return _strings(pssm.frequencies(views.aligned_sites(spark, d)))


def distribution_strings_all(spark: SparkSession, d: str) -> DataFrame:
    return _strings(pssm.frequencies(views.dna(spark, d)))


def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Records written in lines of 80 symbols and read again."""
    path = _fresh(spark, "fasta")
    fasta_source.write(views.fasta(spark, d).where("length(seq) > 0").select(F.col("seq_id").alias("ord"), "seq"), path, 80)
    return fasta_source.read(spark, path).select(F.split("header", " ")[1].cast("bigint").alias("ord"), "seq")


# ---- order-n codes


def order2_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = OrderCodes(5, 2)
    rows = views.events(spark, d).select("seq_id", F.posexplode(codes.encode(F.col("obs"))).alias("t", "code"))
    return rows.select("seq_id", "t", "code", codes.symbol(F.col("code")).alias("symbol"), codes.previous(F.col("code")).alias("previous"), codes.following(F.col("code")).alias("following"))


def order_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    codes = OrderCodes(5, 2)
    rows = views.events(spark, d).withColumn("codes", codes.encode(F.col("obs"))).withColumn("back", codes.decode(F.col("codes")))
    wrong = F.size(F.filter(F.arrays_zip(F.col("obs").alias("a"), F.col("back").alias("b")), lambda x: (x["b"] != 5) & (x["a"] != x["b"])))
    return rows.select("seq_id", codes.valid(F.col("codes")).alias("valid"), codes.valid_symbols(F.col("obs")).alias("valid_symbols"), codes.n_known(F.col("codes")).alias("n_known"), wrong.alias("n_wrong"))


def _windows(seqs: DataFrame) -> DataFrame:
    codes = OrderCodes(5, 2)
    at = lambda i: F.struct(i.alias("start"), codes.encode_window(F.slice("obs", i + 1, 3)).alias("code"))
    rows = seqs.where("size(obs) >= 3").select("seq_id", F.inline(F.transform(F.sequence(F.lit(0), F.size("obs") - 3), at)))
    return rows.select("seq_id", "start", "code", F.concat_ws("", F.transform(codes.decode_window(F.col("code")), lambda x: x.cast("string"))).alias("symbols"))


def window_codes(spark: SparkSession, d: str) -> DataFrame:
    """Of every window of the events; ``window_codes_all`` is of the orders."""
    return _windows(views.events(spark, d))


def window_codes_all(spark: SparkSession, d: str) -> DataFrame:
    return _windows(views.orders(spark, d))


# ---- chains


def _chain(spark: SparkSession, d: str) -> DataFrame:
    return chain.model(views.events(spark, d), 5, 2, 1.0)


def chain_counts(spark: SparkSession, d: str) -> DataFrame:
    return chain.counts(views.events(spark, d), 5, 2, 1.0).select("ord", "ctx", "sym", "cnt")


def chain_probs(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d).select("ord", "ctx", "sym", r6("p").alias("p"), r6("logp").alias("logp"))


def chain_lower_order(spark: SparkSession, d: str) -> DataFrame:
    return chain.lower_order(_chain(spark, d), 1).select("ctx", "sym", r6("p").alias("p"))


def chain_eval(spark: SparkSession, d: str) -> DataFrame:
    seqs = views.events(spark, d)
    return chain.score(chain.evaluate(seqs, chain.model(seqs, 5, 2), 5, 2)).select("seq_id", r6("value").alias("value"))


def chain_eval_cumulative(spark: SparkSession, d: str) -> DataFrame:
    seqs = views.events(spark, d)
    return chain.cumulative(chain.evaluate(seqs, chain.model(seqs, 5, 2), 5, 2)).select("seq_id", "t", r6("cumulative").alias("cumulative"))


def chain_eval_context(spark: SparkSession, d: str) -> DataFrame:
    seqs = views.events(spark, d)
    return chain.evaluate(seqs, chain.model(seqs, 5, 2), 5, 2, begin=5, context=4).select("seq_id", "t", r6("value").alias("value"))


# ---- k-mers


def kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    return kmers.count_mers(views.fasta(spark, d), 6)


def kmer_seq_counts(spark: SparkSession, d: str) -> DataFrame:
    return kmers.count_mers_and_sequences(views.fasta(spark, d), 6)


def kmer_revcomp_counts(spark: SparkSession, d: str) -> DataFrame:
    return kmers.count_mers_and_sequences(views.fasta(spark, d), 6, collapse=True)


def kmer_top_by_sequences(spark: SparkSession, d: str) -> DataFrame:
    return kmers.top_mers_by_sequences(views.fasta(spark, d), 6, 10)


def kmer_most_common(spark: SparkSession, d: str) -> DataFrame:
    return kmers.most_common(views.fasta(spark, d), 6, 5)


def kmer_significance(spark: SparkSession, d: str) -> DataFrame:
    return kmers.significances(views.fasta(spark, d), 5).select("mer", "total", r6("logp").alias("logp"))


# ---- consensus codes


def consensus_codes(spark: SparkSession, d: str) -> DataFrame:
    """How many symbols of the orders each consensus code matches."""
    rows = views.orders(spark, d).select(F.explode("obs").alias("sym")).where("sym < 5").groupBy("sym").agg(F.count("*").alias("n"))
    each = rows.select("n", F.explode(consensus.codes_of_symbol(F.col("sym"), 5)).alias("code")).groupBy("code").agg(F.sum("n").alias("n"))
    return each.select("code", "n", consensus.n_symbols(F.col("code")).alias("size"), F.concat_ws("", F.transform(consensus.symbols_of_code(F.col("code"), 5), lambda x: x.cast("string"))).alias("members"))


def consensus_of_customers(spark: SparkSession, d: str) -> DataFrame:
    """The code of each customer's priorities."""
    rows = views.orders(spark, d).select("seq_id", F.explode("obs").alias("sym")).where("sym < 5")
    return rows.groupBy("seq_id").agg(consensus.code_of_symbols(F.col("sym")).alias("code"))


def consensus_words(spark: SparkSession, d: str) -> DataFrame:
    return consensus.word_counts(views.dna(spark, d), 2, 4)


# ---- matrices


def pssm_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = pssm.score_sequences(views.dna(spark, d), SCORES)
    return rows.select("seq_id", "start", r6("score").alias("score"))


def pssm_max(spark: SparkSession, d: str) -> DataFrame:
    return pssm.max_scores(views.dna(spark, d), SCORES).select("seq_id", r6("score").alias("score"), F.coalesce("start", F.lit(-1)).alias("start"))


def pssm_both_strands(spark: SparkSession, d: str) -> DataFrame:
    rows = pssm.both_strands(views.dna(spark, d), SCORES)
    return rows.select("seq_id", r6("forward").alias("forward"), r6("reverse").alias("reverse"), r6("best").alias("best"))


def pssm_background(spark: SparkSession, d: str) -> DataFrame:
    """Best score of each record above what its symbols' own frequencies (order 0, five symbols) score at the window."""
    seqs = views.dna(spark, d)
    logs = chain.lower_order(chain.model(seqs, 5, 0), 0).orderBy("sym").select("logp").collect()  # five rows
    values = F.array(*[F.lit(r["logp"]) for r in logs])
    k = len(ROWS)
    starts = F.when(F.size("obs") >= k, F.sequence(F.lit(0), F.size("obs") - k)).otherwise(F.array().cast("array<int>"))
    background = F.transform(starts, lambda s: sum((F.get(values, F.get("obs", s + p)) for p in range(k)), F.lit(0.0)))
    best = pssm.best_window(F.col("obs"), SCORES, background)
    return seqs.select("seq_id", r6(best["score"]).alias("score"))


def pssm_start_value(spark: SparkSession, d: str) -> DataFrame:
    return pssm.evaluate_start(views.dna(spark, d), MER, 7).select("mer", F.round("value", 4).alias("value"))


def information_content(spark: SparkSession, d: str) -> DataFrame:
    """Of the places of the reported sites; ``information_content_all`` is of the records."""
    return pssm.information_content(pssm.frequencies(views.aligned_sites(spark, d))).select("pos", r6("nats").alias("nats"))


def information_content_all(spark: SparkSession, d: str) -> DataFrame:
    return pssm.information_content(pssm.frequencies(views.dna(spark, d))).select("pos", r6("nats").alias("nats"))


def logo_heights(spark: SparkSession, d: str) -> DataFrame:
    """Of the places of the reported sites; ``logo_heights_all`` is of the records."""
    return pssm.logo_heights(pssm.frequencies(views.aligned_sites(spark, d))).select("pos", "sym", r6("height").alias("height"))


def logo_heights_all(spark: SparkSession, d: str) -> DataFrame:
    return pssm.logo_heights(pssm.frequencies(views.dna(spark, d))).select("pos", "sym", r6("height").alias("height"))


def _emissions(spark: SparkSession, d: str) -> DataFrame:
    """``fragment, state, sym, p`` from the given paths."""
    cells = F.arrays_zip(F.col("path").alias("state"), F.col("obs").alias("sym"))
    rows = views.inputs(spark, d).where("fragment is not null").select("fragment", F.explode(cells).alias("x")).select("fragment", "x.state", "x.sym").where("state is not null and sym < 4")
    counts = rows.groupBy("fragment", "state", "sym").agg(F.count("*").alias("n"))
    totals = counts.groupBy("fragment", "state").agg(F.sum("n").alias("t"))
    return counts.join(totals, ["fragment", "state"]).select("fragment", "state", "sym", (F.col("n") / F.col("t")).alias("p"))


def emission_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _emissions(spark, d).groupBy("fragment", "state").agg(r6(F.sum(pssm.entropy(F.col("p")))).alias("nats"))


def informative_states(spark: SparkSession, d: str) -> DataFrame:
    bits = 2 - F.sum(pssm.entropy(F.col("p"), 2))
    return _emissions(spark, d).groupBy("fragment", "state").agg(bits.alias("bits")).where("bits > 0.5").select("fragment", "state", r6("bits").alias("bits"))


# ---- inference


def forward_loglik(spark: SparkSession, d: str) -> DataFrame:
    return infer.log_likelihoods(views.events(spark, d), MODEL).select("seq_id", r6("ll").alias("ll"))


def forward_loglik_orders(spark: SparkSession, d: str) -> DataFrame:
    return infer.log_likelihoods(views.orders(spark, d), MODEL).select("seq_id", r6("ll").alias("ll"))


def backward_loglik(spark: SparkSession, d: str) -> DataFrame:
    return infer.backward_log_likelihood(views.events(spark, d), MODEL).select("seq_id", r6("ll").alias("ll"))


def trellis_consistency(spark: SparkSession, d: str) -> DataFrame:
    return infer.consistent(views.events(spark, d), MODEL)


def total_loglik(spark: SparkSession, d: str) -> DataFrame:
    return infer.total_log_likelihood(views.events(spark, d), MODEL).select(F.round("ll", 4).alias("ll"), "n_known", r6("ll_per_known").alias("ll_per_known"))


def posterior_gamma(spark: SparkSession, d: str) -> DataFrame:
    return infer.posteriors(views.orders(spark, d), MODEL).select("seq_id", "t", "i", r6("gamma").alias("gamma"))


def viterbi_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = infer.best_paths(views.orders(spark, d), MODEL)
    return rows.select("seq_id", r6("log_p").alias("log_p"), F.concat_ws("", F.transform("path", lambda s: s.cast("string"))).alias("path"))


def binding_indicators(spark: SparkSession, d: str) -> DataFrame:
    rows = sites.predict(views.events(spark, d), MODEL, [0])
    return rows.select("seq_id", F.concat_ws("", F.transform("pred", lambda s: s.cast("string"))).alias("pred"))


def sampled_sequences(spark: SparkSession, d: str) -> DataFrame:
    """A drawn sequence as long as each customer's."""
    wanted = views.orders(spark, d).select("seq_id", F.size("obs").alias("length"))
    rows = infer.sample(wanted, MODEL, SEED)
    text = lambda c: F.concat_ws("", F.transform(c, lambda s: s.cast("string")))
    return rows.select("seq_id", text("states").alias("states"), text("symbols").alias("symbols"))


def motif_loglik(spark: SparkSession, d: str) -> DataFrame:
    """Forward likelihood of every record under the six-place model (13 states)."""
    return infer.log_likelihoods(views.dna(spark, d), MOTIF).select("seq_id", r6("ll").alias("ll"))


def motif_loglik_backward(spark: SparkSession, d: str) -> DataFrame:
    return infer.backward_log_likelihood(views.dna(spark, d), MOTIF).select("seq_id", r6("ll").alias("ll"))


def motif_total_loglik(spark: SparkSession, d: str) -> DataFrame:
    return infer.total_log_likelihood(views.dna(spark, d), MOTIF).select(F.round("ll", 4).alias("ll"), "n_known", r6("ll_per_known").alias("ll_per_known"))


# ---- training


def bw_estep(spark: SparkSession, d: str) -> DataFrame:
    rows = train.partial_sums(views.orders(spark, d), MODEL)
    return rows.where("part <> 'bad'").select("part", "cell", F.round("value", 4).alias("value"))


def bw_iteration(spark: SparkSession, d: str) -> DataFrame:
    seqs = views.orders(spark, d)
    model, _ = train.iterate(seqs, MODEL)
    return model.table(spark, "b").select("i", "k", r6("p").alias("p"))


def viterbi_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = train.partial_sums(views.orders(spark, d), MODEL, hard=True)
    return rows.where("part in ('pi', 'a', 'b')").select("part", "cell", F.round("value", 4).alias("value"))


def kfold_loglik(spark: SparkSession, d: str) -> DataFrame:
    rows = train.cross_validated(views.orders(spark, d), MODEL, 3, most=0, tolerance=1e-4)
    return rows.select("fold", F.round("ll", 3).alias("ll"), "n_known")


def trained_history(spark: SparkSession, d: str) -> DataFrame:
    seqs = views.orders(spark, d)
    _, history = train.train(seqs, MODEL, tolerance=train.per_known(seqs, MODEL))
    return train.history_rows(seqs, [history]).select("run", "iteration", F.round("ll", 3).alias("ll"))


def viterbi_training(spark: SparkSession, d: str) -> DataFrame:
    """Objectives of training along the best paths."""
    seqs = views.orders(spark, d)
    _, history = train.train(seqs, MODEL, hard=True, tolerance=train.per_known(seqs, MODEL))
    return train.history_rows(seqs, [history]).select("run", "iteration", F.round("ll", 3).alias("ll"))


# ---- motif search


def _known_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Read again and again by the searches, so written once."""
    return stable(_inputs(spark, d))


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    return views.inputs(spark, d).where("size(obs) > 0").select("seq_id", "obs", "digits")


def _learned(spark: SparkSession, found: list[learn.Learned], firsts: list[int], places: int) -> DataFrame:
    """``motif, ll, pos, sym, p``: the forward emissions of learned models."""
    rows = [
        (i, float(x.ll), pos, sym, float(x.model.b[first + pos, sym])) for i, (x, first) in enumerate(zip(found, firsts)) for pos in range(places) for sym in range(4)
    ]
    return spark.createDataFrame(rows, "motif int, ll double, pos int, sym int, p double").select("motif", F.round("ll", 2).alias("ll"), "pos", "sym", F.round("p", 4).alias("p"))


def learned_motifs(spark: SparkSession, d: str) -> DataFrame:
    """Motifs learned one after the other, each one's sites blanked before the next."""
    motif = Motif(6, p_site=0.02, least_information=0.0)
    found, _ = learn.learn_several(_known_inputs(spark, d).select("seq_id", "obs"), motif, find=2, attempts=3, starts=1, most=4)
    return _learned(spark, found, [1] * len(found), 6)


def seeded_motif(spark: SparkSession, d: str) -> DataFrame:
    """Training from the most significant mer."""
    rows = _known_inputs(spark, d)
    found = learn.seeded(rows.select("seq_id", "obs"), rows.select("seq_id", "digits"), Motif(7, p_site=0.02), size=5, most=6)
    return _learned(spark, [found], [1], 7)


def gapped_motif(spark: SparkSession, d: str) -> DataFrame:
    """Training of a motif with one gap from the candidate mer of the best score."""
    rows = _known_inputs(spark, d)
    mer, found = learn.single_gap(rows.select("seq_id", "obs"), rows.select("seq_id", "digits"), length=7, size=5, candidates=20, most=4)
    return _learned(spark, [found], [1], 7).withColumn("mer", F.lit(mer))


def motif_passes(spark: SparkSession, d: str) -> DataFrame:
    """Two passes, the second over the sequences without the sites of the first."""
    motif = Motif(6, p_site=0.02)
    one = lambda s: learn.learn(s, motif, starts=1, most=4).model
    models = learn.several_passes(_known_inputs(spark, d).select("seq_id", "obs"), one, lambda s, m: sites.analyse(s, m, motif.background, blank=True)[1], 2)
    return _learned(spark, [learn.Learned(m, 0.0, []) for m in models], [1, 1], 6).drop("ll")


def optimised_model(spark: SparkSession, d: str) -> DataFrame:
    """The stay probabilities that a simplex search over the likelihood finds."""
    model, ll = train.optimise(views.orders(spark, d), MODEL, [3, 7], steps=8)
    return spark.createDataFrame([(float(ll), *map(float, model.theta[[3, 7]]))], "ll double, stay0 double, stay1 double").select(
        F.round("ll", 2).alias("ll"), F.round("stay0", 4).alias("stay0"), F.round("stay1", 4).alias("stay1")
    )


# ---- sites


def _sites(spark: SparkSession, d: str) -> DataFrame:
    rows = views.inputs(spark, d).where("path is not null and obs is not null")
    return sites.find_sites(rows, [0])


def site_islands(spark: SparkSession, d: str) -> DataFrame:
    return _sites(spark, d).select("seq_id", "start", "end")


def site_texts(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c, sep: F.concat_ws(sep, F.transform(c, lambda s: s.cast("string")))
    return _sites(spark, d).select("seq_id", "start", text("site", "").alias("site"), text("states", " ").alias("states"))


def site_files(spark: SparkSession, d: str) -> DataFrame:
    return tables.site_lines(_sites(spark, d))


def site_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Sites written to a file and read again."""
    path = _fresh(spark, "sites")
    tables.write_sites(_sites(spark, d), path)
    return tables.read_sites(spark, path).select("site", "seq_id", "start", "is_rev_comp", F.concat_ws(" ", F.transform("states", lambda s: s.cast("string"))).alias("states"))


def indicator_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of errors among each user's events."""
    rows = views.events(spark, d).withColumn("marks", F.transform("obs", lambda x: (x == 1).cast("int")))
    return sites.indicator_sites(rows, "marks")


def indicator_texts(spark: SparkSession, d: str) -> DataFrame:
    """Runs of unknown symbols and of a's, with their symbols."""
    rows = views.dna(spark, d).withColumn("marks", F.transform("obs", lambda x: x.isin(0, 4).cast("int")))
    return sites.site_symbols(rows, "marks").select("seq_id", "start", "end", F.concat_ws("", F.transform("site", lambda s: s.cast("string"))).alias("site"))


def blanked_sites(spark: SparkSession, d: str) -> DataFrame:
    """Records with the sites of the six-place model made unknown."""
    _, blanked = sites.analyse(views.dna(spark, d), MOTIF, [0], blank=True)
    return blanked.select("seq_id", F.concat_ws("", F.transform("obs", lambda s: s.cast("string"))).alias("obs"))


def site_strands(spark: SparkSession, d: str) -> DataFrame:
    """Sites under the shared six-place model, turned to the forward strand."""
    decoded = sites.decode(views.dna(spark, d), MOTIF)
    found = sites.find_sites(decoded, [0], {s: s - 6 for s in range(7, 13)})
    text = lambda c: F.concat_ws("", F.transform(c, lambda s: s.cast("string")))
    return found.select("seq_id", "start", "end", text("site").alias("site"), "is_rev_comp")


def _in_motif(s):  # noqa: ANN001, ANN202
    """States 1 to 2 K; without a known fragment all but the background."""
    return (s >= 1) & F.coalesce(s <= 2 * F.col("k"), F.lit(True))


def masked_sites(spark: SparkSession, d: str) -> DataFrame:
    """All input sequences with the symbols in their fragment's motif states made unknown."""
    rows = views.inputs(spark, d).where("obs is not null")
    masked = sites.mask_sites(rows, _in_motif, 4)
    return masked.select("seq_id", F.concat_ws("", F.transform("obs", lambda s: s.cast("string"))).alias("obs"))


def mask_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sites begin in the first state of either strand, 1 and 2 K."""
    rows = views.inputs(spark, d).where("path is not null")
    return sites.mask_counts(rows, _in_motif, lambda s: (s == 1) | F.coalesce(s == 2 * F.col("k"), F.lit(False)))


def path_edges(spark: SparkSession, d: str) -> DataFrame:
    """Transitions of the given paths as weighted edges, for drawing a model's graph."""
    rows = views.inputs(spark, d).where("fragment is not null").select("fragment", "path")
    pairs = rows.select("fragment", F.explode(F.arrays_zip(F.col("path").alias("src"), F.slice("path", F.lit(2), F.size("path")).alias("dst"))).alias("x")).select("fragment", "x.src", "x.dst").dropna()
    counts = pairs.groupBy("fragment", "src", "dst").agg(F.count("*").alias("n"))
    totals = counts.groupBy("fragment", "src").agg(F.sum("n").alias("t"))
    return counts.join(totals, ["fragment", "src"]).select("fragment", "src", "dst", r6(F.col("n") / F.col("t")).alias("p"))


# ---- evaluation


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return _sites(spark, d).select("seq_id", "start", "end")


def site_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.overlaps(views.sites(spark, d), _predicted(spark, d))


def site_roc(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.site_roc(views.sites(spark, d), _predicted(spark, d))


def base_roc(spark: SparkSession, d: str) -> DataFrame:
    """Errors among events against the hidden states other than 0."""
    rows = views.events(spark, d)
    truth = F.transform("obs", lambda x: (x == 1).cast("int"))
    decoded = sites.decode(rows, MODEL)
    return evaluate.base_roc(decoded.select(truth.alias("truth"), infer.indicators(F.col("path"), [0]).alias("pred")), "truth", "pred")


def _hit_rows(spark: SparkSession, d: str) -> DataFrame:
    """``seq_id`` with fragment and truth (whether the own path leaves the background), and ``obs``."""
    rows = views.inputs(spark, d).where("obs is not null and path is not null")
    truth = F.coalesce(F.exists("path", lambda s: s > 0), F.lit(False))
    return rows.select(F.struct("seq_id", "fragment", truth.alias("truth")).alias("seq_id"), "obs")


def hits_by_fragment(spark: SparkSession, d: str) -> DataFrame:
    """Whether the six-place model hits a sequence, against whether its own path leaves the background."""
    found = evaluate.hits(_hit_rows(spark, d), [(MOTIF, [0], 6)])
    return evaluate.roc_by_dataset(found.select("seq_id.fragment", "seq_id.truth", "hit"), "fragment", "truth", "hit")


def hits_by_models(spark: SparkSession, d: str) -> DataFrame:
    """The same for two models, of which one must hit."""
    found = evaluate.hits(_hit_rows(spark, d), [(MOTIF, [0], 6), (OTHER, [0], 6)])
    return evaluate.roc_by_dataset(found.select("seq_id.fragment", "seq_id.truth", "hit"), "fragment", "truth", "hit")


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = _hit_rows(spark, d).select("obs", "seq_id.truth")
    return evaluate.roc_sweep(rows, SWEPT, SWEPT.model(ROWS), "truth", SWEEP)


def roc_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Hits under falling binding probabilities against whether the own path leaves the background."""
    return _sweep(spark, d).select(r6("p").alias("p"), "tp", "tn", "fp", "fn")


def roc_file(spark: SparkSession, d: str) -> DataFrame:
    """The points of ``roc_sweep`` written to a file and read again."""
    path = _fresh(spark, "roc")
    tables.write_roc(_sweep(spark, d), path)
    return tables.read_roc(spark, path)


def fragment_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summary(views.inputs(spark, d), "fragment")


def dataset_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Training and test sequences of each fragment together."""
    rows = views.inputs(spark, d).where("fragment is not null and digits is not null")
    parts = [rows.where(f"{c} is not null").select("fragment", "seq_id", "digits") for c in ("train", "test")]
    return parts[0].unionByName(parts[1])


def matched_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Records of the same number as the input sequences, cut to their lengths; null where there is none or it is too short."""
    pos = views.inputs(spark, d).where("digits is not null").select(F.col("seq_id").alias("ord"), F.col("digits").alias("seq"))
    neg = views.fasta(spark, d).select(F.col("seq_id").alias("ord"), F.col("digits").alias("seq"))
    return evaluate.matched_negatives(pos, neg, strict=False)


def paired_negatives(spark: SparkSession, d: str) -> DataFrame:
    """A record for every input sequence, cut to its length; null where no record is long enough."""
    pos = views.inputs(spark, d).where("digits is not null").select(F.col("seq_id").alias("ord"), F.col("digits").alias("seq"))
    neg = views.fasta(spark, d).select(F.col("seq_id").alias("ord"), F.col("digits").alias("seq"))
    return evaluate.paired_negatives(pos, neg)


def ranked_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments by the geometric mean of their states' mean information and their share of known symbols."""
    bits = 2 - F.sum(pssm.entropy(F.col("p"), 2))
    info = _emissions(spark, d).where("state > 0").groupBy("fragment", "state").agg(bits.alias("bits")).groupBy("fragment").agg(F.greatest(F.avg("bits"), F.lit(0.0)).alias("info"))
    known = evaluate.summary(views.inputs(spark, d), "fragment").select("fragment", (F.col("n_known") / F.col("n_bases")).alias("known"))
    return evaluate.ranked(info.join(known, "fragment"), "fragment", "info", "known").select("fragment", r6("score").alias("score"))


ALL = (
    fasta_stripped, fasta_wrapped, fasta_roundtrip, encode_known_counts, decoded_letters, rev_comp_text, complement_counts, masked_sequences, sigmoid_values, log_factorials, distribution_strings, distribution_strings_all,
    order2_codes, order_roundtrip, window_codes, window_codes_all, chain_counts, chain_probs, chain_lower_order, chain_eval, chain_eval_cumulative, chain_eval_context,
    kmer_counts, kmer_seq_counts, kmer_revcomp_counts, kmer_top_by_sequences, kmer_most_common, kmer_significance, consensus_codes, consensus_of_customers, consensus_words,
    pssm_scores, pssm_max, pssm_both_strands, pssm_background, pssm_start_value, information_content, information_content_all, logo_heights, logo_heights_all, emission_entropy, informative_states,
    forward_loglik, forward_loglik_orders, backward_loglik, trellis_consistency, total_loglik, posterior_gamma, viterbi_paths, binding_indicators, sampled_sequences, motif_loglik, motif_loglik_backward, motif_total_loglik,
    bw_estep, bw_iteration, viterbi_counts, kfold_loglik, trained_history, viterbi_training, learned_motifs, seeded_motif, gapped_motif, motif_passes, optimised_model,
    site_islands, site_texts, site_files, site_file_roundtrip, indicator_runs, indicator_texts, blanked_sites, site_strands, masked_sites, mask_counts, path_edges,
    site_overlaps, site_roc, base_roc, hits_by_fragment, hits_by_models, roc_sweep, roc_file, fragment_summary, dataset_sequences, matched_negatives, paired_negatives, ranked_fragments,
)

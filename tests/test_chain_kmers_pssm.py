import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.symbols import text_codes
from strandloom.models.builders import information_content
from strandloom.operators import chain, kmers, pssm

SEQ = "seq_id int, obs array<int>"


def test_chain_counts(spark):
    df = spark.createDataFrame([(1, [0, 1, 2, 3, 0]), (2, []), (3, None)], SEQ)
    got = {(r["ord"], r["code"]): r for r in chain.probabilities(chain.counts(df, 4, 3)).collect()}
    assert got[3, 27]["cnt"] == got[2, 27]["cnt"] == got[1, 11]["cnt"] == 1
    assert [got[0, i]["cnt"] for i in range(4)] == [2, 1, 1, 1]
    assert got[0, 0]["p"] == 0.4
    assert math.isnan(got[3, 0]["p"]) and math.isnan(got[3, 0]["logp"])
    assert got[1, 0]["logp"] == -math.inf


@pytest.mark.parametrize("n", range(1, 9))
def test_chain_evaluation(spark, n):
    want = [math.log(x) for x in (3 / 9, 2 / 5, 2 / 5, 2 / 5, 2 / 5, 1 / 4, 1 / 4, 2 / 5)]
    model = chain.model(spark.createDataFrame([(1, [0, 1, 2, 3, 0])], SEQ), 4, 3)
    df = spark.createDataFrame([(1, [0, 1, 2, 3, 0, 1, 2, 3][:n])], SEQ)
    got = chain.cumulative(chain.evaluate(df, model, 4, 3)).orderBy("t").collect()
    assert [r["value"] for r in got] == pytest.approx(want[:n])
    assert [r["cumulative"] for r in got] == pytest.approx(np.cumsum(want[:n]).tolist())
    later = chain.evaluate(df, model, 4, 3, begin=1).orderBy("t").collect()
    assert [r["value"] for r in later] == pytest.approx(want[1:n])


def digits(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq_id int, t string").withColumn("digits", text_codes(F.col("t")))


@pytest.mark.parametrize("k", [3, 4, 5])
def test_kmers_of_two_copies(spark, k):
    df = spark.createDataFrame([(1, "01234"), (2, "01234")], "seq_id int, digits string")
    got = kmers.count_mers_and_sequences(df, k).collect()
    assert len(got) == 6 - k and all(r["total"] == r["num_seqs"] == 2 for r in got)


def test_collapsed_kmers(spark):
    df = digits(spark, "aacc", "ggtt", "aaaaaaaaaaaa")
    got = [tuple(r) for r in kmers.top_mers_by_sequences(df, 3, 10).collect()]
    assert got == [("001", 2, 2), ("011", 2, 2), ("000", 10, 1)]


def test_kmers_across_chunks(spark):
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("acgtn"), 2000))
    got = {r["mer"]: r["total"] for r in kmers.count_mers(digits(spark, text, "", "ac", None), 5).collect()}
    code = text.translate(str.maketrans("acgtn", "01234"))
    want = {}
    for i in range(len(code) - 4):
        want[code[i : i + 5]] = want.get(code[i : i + 5], 0) + 1
    assert got == want


def test_unknown_mers_are_one(spark):
    got = {r["mer"]: r["total"] for r in kmers.collapse(kmers.count_mers(digits(spark, "acnac"), 2)).collect()}
    assert got == {"01": 2, "N": 2}


ROWS = [[0.85, 0.05, 0.05, 0.05] if i % 2 == 0 else [0.05, 0.85, 0.05, 0.05] for i in range(12)]


def test_pssm_scan(spark):
    df = spark.createDataFrame([(1, [0, 1, 2, 3] * 4 + [4]), (2, [0, 1]), (3, [])], SEQ)
    want = [-18.949507, -35.948787, -18.949507, -35.948787, -18.949507, -34.339349]
    s = pssm.log_scores(ROWS)
    for x in (s, pssm.complementary(s)):
        assert [r["score"] for r in pssm.score_sequences(df, x).orderBy("start").collect()] == pytest.approx(want, abs=1e-6)
    got = {r["seq_id"]: (r["score"], r["start"]) for r in pssm.max_scores(df, s).collect()}
    assert got[1] == (pytest.approx(want[0], abs=1e-6), 0) and got[2] == got[3] == (None, None)
    with pytest.raises(ValueError):
        pssm.log_scores([[0.5, 0.5]])


def test_information(spark):
    assert information_content(np.array([[1, 0, 0, 0]])) == pytest.approx(1.3862943611198906)
    assert information_content(np.array(ROWS)) == pytest.approx(9.5855211601642)
    rows = pssm.matrix_rows(spark, ROWS).withColumnRenamed("score", "p")
    assert pssm.information_content(rows).agg(F.sum("nats")).first()[0] == pytest.approx(9.5855211601642)


def test_matrices_of_mer():
    short, long = pssm.matrices_of_mer("acg", 5)
    assert len(short) == 5 and len(long) == 6
    assert [int(np.argmax(r)) for r in short[1:4]] == [0, 1, 2]
    assert short[0] == [0.25] * 4 and long[2] == [0.25] * 4


def test_frequencies_of_all_places(spark):
    df = spark.createDataFrame([(1, [0] * 29 + [1, 2, 4, 3]), (2, [0] * 31), (3, [])], SEQ)
    got = {(r["pos"], r["sym"]): r["p"] for r in pssm.frequencies(df).collect()}
    assert got == {(i, 0): 1.0 for i in range(29)} | {(29, 0): 0.5, (29, 1): 0.5, (30, 0): 0.5, (30, 2): 0.5, (32, 3): 1.0}
    assert max(r["pos"] for r in pssm.frequencies(df, 30).collect()) == 29


def test_queries_take_all_places_and_windows(spark):
    from strandloom.plans import queries, views

    folder = "/root/testdata/sf0.001"
    known = views.dna(spark, folder).select(F.posexplode("obs").alias("pos", "sym")).where("sym < 4").select("pos").distinct().count()
    assert queries.information_content_all(spark, folder).count() == known > 30
    windows = views.orders(spark, folder).agg(F.sum(F.greatest(F.size("obs") - 2, F.lit(0)))).first()[0]
    assert queries.window_codes_all(spark, folder).count() == windows > queries.window_codes(spark, folder).count()

import math

import pytest
from pyspark.sql import functions as F

from strandloom.functions import consensus, order, symbols
from strandloom.runtime import cleaned, once


def test_text_codes_keep_length_and_refuse_digits(spark, rows):
    df = spark.createDataFrame([("aCgT-n0123\n",), ("",), (None,)], "s string")
    assert rows(df.select(symbols.text_codes(F.col("s")))) == sorted([("01234444444",), ("",), (None,)], key=str)


def test_letters_and_reverse_complement(spark):
    df = spark.createDataFrame([("01234",)], "d string")
    r = df.select(symbols.codes_text(F.col("d")), symbols.reverse_complement(F.col("d")), symbols.code_array(F.col("d"))).first()
    assert tuple(r) == ("acgtn", "40123", [0, 1, 2, 3, 4])
    with pytest.raises(Exception, match="no symbol codes"):
        spark.createDataFrame([("015",)], "d string").select(symbols.codes_text(F.col("d"))).collect()


def test_reverse_complement_is_its_own_inverse(spark):
    df = spark.createDataFrame([([0, 3, 4, 1, 1],), ([],)], "x array<int>")
    assert df.where(symbols.reverse_complement_array(symbols.reverse_complement_array(F.col("x"))) != F.col("x")).count() == 0


def test_log_factorial(spark):
    ns = [0, 1, 2, 5, 20, 170, 10**6]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    for r in df.select("n", symbols.log_factorial(F.col("n")).alias("x")).collect():
        assert r["x"] == pytest.approx(math.lgamma(r["n"] + 1), rel=1e-12, abs=1e-12)


def test_sigmoid_saturates_and_inverts(spark):
    df = spark.createDataFrame([(-100.0,), (-2.0,), (0.0,), (3.0,), (100.0,)], "x double")
    got = df.select("x", symbols.sigmoid(F.col("x")).alias("y")).withColumn("z", symbols.inverse_sigmoid(F.col("y"))).collect()
    assert [r["y"] for r in got][0::4] == [0.0, 1.0]
    assert all(r["z"] == pytest.approx(max(-36, min(36, r["x"]))) for r in got)


def test_uniform_masks_the_same_whatever_the_partitions(spark, rows):
    df = spark.range(200).select(F.col("id").alias("seq_id"), F.array_repeat(F.lit(0), 50).alias("obs"))
    masked = lambda n: rows(df.repartition(n).select("seq_id", symbols.mask_unknown(F.col("obs"), F.col("seq_id"), 3).alias("m")))
    one = masked(1)
    assert one == masked(5)
    assert 0.01 < sum(x == 4 for _, m in one for x in m) / 10_000 < 0.03


def test_random_sequences(spark):
    got = symbols.random_sequences(spark, 400, 120, 1).select(F.size("obs").alias("n"), "obs").collect()
    assert len(got) == 400 and abs(sum(r["n"] for r in got) / 400 - 120) < 4
    assert {x for r in got for x in r["obs"]} == {0, 1, 2, 3}


def test_distribution_strings(spark):
    cols = spark.createDataFrame([(0, 0.5, 0.25, 0.25, 0.0), (1, 0.0, 0.0, 0.0, 1.0)], "pos int, a double, c double, g double, t double")
    assert [r["seq"] for r in symbols.strings_of_distribution(cols, 4).orderBy("i").collect()] == ["at", "at", "ct", "gt"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5])
def test_order_round_trip(spark, n):
    codes = order.OrderCodes(5, n)
    df = spark.createDataFrame([([0, 1, 2, 3, 4],), ([],), ([5, 0, 0, 5, 1, 2],)], "obs array<int>").withColumn("c", codes.encode(F.col("obs")))
    for r in df.withColumn("back", codes.decode(F.col("c"))).withColumn("ok", codes.valid(F.col("c"))).collect():
        assert r["ok"] and len(r["c"]) == len(r["obs"])
        assert all(x == codes.size for x in r["c"][:n])
        assert all(b in (5, o) for o, b in zip(r["obs"], r["back"]))


def test_order_codes(spark):
    codes = order.OrderCodes(4, 2)
    df = spark.createDataFrame([([0, 1, 2, 3],)], "obs array<int>")
    r = df.select(codes.encode(F.col("obs")).alias("c"), codes.encode_window(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("w")).first()
    assert r["c"] == [64, 64, 6, 27] and r["w"] == 6
    got = df.select(codes.decode_window(F.lit(6)), codes.previous(F.lit(27)), codes.following(F.lit(27)), codes.symbol(F.lit(64))).first()
    assert tuple(got) == ([0, 1, 2], 6, 11, 4)
    with pytest.raises(ValueError):
        order.OrderCodes(4, 16)
    with pytest.raises(ValueError):
        order.alphabet_of(63, 2)
    with pytest.raises(Exception, match="alphabet"):
        spark.createDataFrame([([7],)], "obs array<int>").select(codes.encode(F.col("obs"))).collect()


@pytest.mark.parametrize("k", [3, 4, 7])
def test_consensus_codes(spark, k):
    df = consensus.codes(spark, k)
    got = df.select("code", consensus.n_symbols(F.col("code")).alias("n"), consensus.symbols_of_code(F.col("code"), k).alias("s")).collect()
    assert len(got) == 2**k
    assert all(sum(1 << x for x in r["s"]) == r["code"] and len(r["s"]) == r["n"] for r in got)
    own = spark.createDataFrame([(0,), (1,)], "x int")
    assert own.agg(consensus.code_of_symbols(F.col("x")).alias("c")).first()["c"] == 3
    assert len(own.select(consensus.codes_of_symbol(F.col("x"), k).alias("c")).first()["c"]) == 2 ** (k - 1)


def test_consensus_words(spark, rows):
    df = spark.createDataFrame([(1, [0, 1, 0]), (2, [0, 4, 1]), (3, [])], "seq_id int, obs array<int>")
    got = {(r["c1"], r["c2"]): r["n"] for r in consensus.word_counts(df, 2, 2).collect()}
    assert got == {(1, 2): 1, (1, 3): 1, (3, 2): 1, (3, 3): 2, (2, 1): 1, (2, 3): 1, (3, 1): 1}


def test_once_takes_the_first_delivery(spark, rows):
    df = spark.createDataFrame([(1, "b", None, 2), (1, "a", "f", 1), (2, None, None, 1), (None, "x", "y", 1), (2, None, "g", 3)], "id int, s string, fragment string, loaded_at int")
    assert rows(once(df, "id", fill=("fragment",))) == sorted([(1, "a", "f"), (2, None, "g")], key=str)


def test_cleaned(spark):
    df = spark.createDataFrame([("nn AcN\r\ngt n",), ("NNN",), ("",)], "s string")
    assert [r[0] for r in df.select(cleaned("s")).collect()] == ["acngt", "", ""]

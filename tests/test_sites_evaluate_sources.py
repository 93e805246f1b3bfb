import pytest
from pyspark.sql import functions as F

from strandloom.models import builders
from strandloom.operators import chain, evaluate, sites
from strandloom.sources import fasta, tables
from strandloom.streaming import online

SITE = "seq_id int, start int, end int"


def test_runs_are_half_open(spark, rows):
    df = spark.createDataFrame([(1, [0, 1, 1, 0, 1]), (2, []), (3, None), (4, [1, 1]), (5, [0])], "seq_id int, ind array<int>")
    assert rows(sites.indicator_sites(df, "ind")) == [(1, 1, 3), (1, 4, 5), (4, 0, 2)]


def test_sites_are_turned(spark):
    df = spark.createDataFrame([(1, [0, 2, 1, 4, 0, 3], [0, 4, 3, 0, 1, 2])], "seq_id int, obs array<int>, path array<int>")
    got = {r["start"]: r for r in sites.find_sites(df, [0], {3: 1, 4: 2}).collect()}
    assert got[1]["site"] == [2, 1] and got[1]["states"] == [1, 2] and got[1]["is_rev_comp"] and got[1]["end"] == 3
    assert got[4]["site"] == [0, 3] and not got[4]["is_rev_comp"] and got[4]["end"] == 6
    assert sites.mask_sites(df, [1, 2, 3, 4], 4).first()["obs"] == [0, 4, 4, 4, 4, 4]
    assert tuple(sites.mask_counts(df, [1, 2, 3, 4], [1, 4]).first()) == (2, 4)
    assert sites.site_symbols(df.withColumn("ind", F.transform("path", lambda s: (s > 2).cast("int"))), "ind").first()["site"] == [2, 1]


def test_overlaps_cover_nested_and_long_intervals(spark, rows):
    a = spark.createDataFrame([(1, 0, 1000), (1, 5, 5), (2, 3, 6)], SITE)
    b = spark.createDataFrame([(1, 10, 20), (1, 999, 1001), (1, 1000, 1002), (2, 6, 9), (3, 0, 9)], SITE)
    got = rows(evaluate.overlaps(a, b), "seq_id", "b_start", "o_start", "o_end")
    assert got == sorted([(1, 10, 10, 20), (1, 999, 999, 1000)], key=str)


def test_site_counts(spark):
    truth = spark.createDataFrame([(1, 0, 8), (1, 20, 28), (2, 0, 4)], SITE)
    pred = spark.createDataFrame([(1, 6, 12), (1, 27, 40), (3, 0, 5)], SITE)
    assert tuple(evaluate.site_roc(truth, pred).first()) == (1, 0, 2, 2)
    base = spark.createDataFrame([([1, 0, 1, 0], [1, 1, 0, 0])], "t array<int>, p array<int>")
    assert tuple(evaluate.base_roc(base, "t", "p").first()) == (1, 1, 1, 1)
    empty = truth.where("false")
    assert tuple(evaluate.site_roc(empty, empty).first()) == (0, 0, 0, 0)


def test_hits_sweep_and_totals(spark):
    motif = builders.Motif(3, 0.04)
    model = motif.model([[0.97, 0.01, 0.01, 0.01], [0.01, 0.01, 0.01, 0.97], [0.01, 0.01, 0.97, 0.01]])
    df = spark.createDataFrame([(1, [1, 1, 0, 3, 2, 1, 1], True, "x"), (2, [1, 1, 1, 1], False, None), (3, [], False, "x")], "seq_id int, obs array<int>, truth boolean, d string")
    hit = evaluate.hits(df, [(model, [0], 3)])
    assert {r["seq_id"]: r["hit"] for r in hit.collect()} == {1: True, 2: False, 3: False}
    assert not any(r["hit"] for r in evaluate.hits(df, []).collect())
    values = evaluate.sweep()
    assert len(values) == 16 and values[0] == 0.1 and values[-1] > 0.0001 and values == sorted(values, reverse=True)
    assert evaluate.roc_sweep(df, motif, model, "truth", values[:2]).where("tp = 1 and tn = 2").count() == 2
    totals = {r["d"]: r["tn"] for r in evaluate.roc_by_dataset(df.join(hit, "seq_id"), "d", "truth", "hit").collect()}
    assert totals == {"x": 1, "(none)": 1, None: 2}


def test_matched_negatives(spark):
    p = spark.createDataFrame([(1, "aaaa"), (2, "")], "ord int, seq string")
    n = spark.createDataFrame([(1, "cccccc"), (2, "g")], "ord int, seq string")
    assert {r["ord"]: r["seq"] for r in evaluate.matched_negatives(p, n).collect()} == {1: "cccc", 2: ""}
    with pytest.raises(Exception, match="long enough"):
        evaluate.matched_negatives(p, n.where("ord = 2")).collect()


def test_fasta_files(spark, tmp_path, rows):
    one, two = tmp_path / "a.fasta", tmp_path / "b.fasta"
    one.write_text(">x first\nNNac\nGTn\n>y\n\n>z\nAC")
    two.write_text("")
    assert rows(fasta.read(spark, str(one)), "id", "seq") == [("x", "NNacGTn"), ("y", ""), ("z", "AC")]
    assert rows(fasta.read_stripped(spark, str(one), str(two)), "id", "digits") == [("x", "0123"), ("y", ""), ("z", "01")]
    df = spark.createDataFrame([(1, "a" * 170), (2, "c" * 80)], "ord int, seq string")
    fasta.write(df, str(tmp_path / "out"), 80)
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.txt")))
    assert max(map(len, text.split("\n"))) == 80 and "> " not in text
    assert rows(fasta.read(spark, str(tmp_path / "out")), "header", "seq") == [("sequence 1", "a" * 170), ("sequence 2", "c" * 80)]


def test_site_and_roc_files(spark, tmp_path, rows):
    df = spark.createDataFrame([([0, 1, 4], 7, 3, True, [2, 1])], "site array<int>, seq_id long, start int, is_rev_comp boolean, states array<int>")
    tables.write_sites(df, str(tmp_path / "s"))
    r = tables.read_sites(spark, str(tmp_path / "s")).first()
    assert tuple(r) == ("acn", 7, 3, 1, [2, 1])
    roc = spark.createDataFrame([(0.1, 1, 2, 3, 4)], tables.ROC)
    tables.write_roc(roc, str(tmp_path / "r"))
    assert rows(tables.read_roc(spark, str(tmp_path / "r"))) == [(0.1, 1, 2, 3, 4)]


def test_chain_round_trip(spark, tmp_path, rows):
    table = chain.counts(spark.createDataFrame([(1, [0, 1, 1])], "seq_id int, obs array<int>"), 2, 1)
    tables.write_chain(table, str(tmp_path / "c"))
    cols = ["ord", "code", "ctx", "sym", "cnt"]
    assert rows(tables.read_chain(spark, str(tmp_path / "c")), *cols) == rows(table, *cols)


def test_streams(spark, tmp_path):
    schema = "seq_id int, at timestamp, sym string"
    src = str(tmp_path / "in")
    for i, text in enumerate(["aca", "ca"]):
        rows = [(1, f"2020-01-0{1 + i} 00:00:0{j}", c) for j, c in enumerate(text)]
        df = spark.createDataFrame(rows, "seq_id int, at string, sym string").withColumn("at", F.to_timestamp("at"))
        df.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    mers = run(online.kmers_of_stream(stream, 2), "mers", "complete")
    assert {r["mer"]: r["total"] for r in mers.collect()} in ({"ac": 2, "ca": 2}, {"ac": 3, "ca": 1}) or sum(r["total"] for r in mers.collect()) == 4
    from strandloom.models.hidden import dense
    from strandloom.operators import infer

    model = dense([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [[0.5, 0.5], [0.1, 0.9]])
    coded = stream.withColumn("sym", F.when(F.col("sym") == "a", 0).otherwise(1))
    last = run(online.likelihood_of_stream(coded, model), "lls", "append").orderBy(F.desc("n")).first()
    first_file = spark.read.parquet(src)
    assert first_file.count() == last["n"] == 5
    orders = [[0, 1, 0, 1, 0], [1, 0, 0, 1, 0]]
    want = [infer.log_likelihoods(spark.createDataFrame([(1, o)], "seq_id int, obs array<int>"), model).first()["ll"] for o in orders]
    assert any(last["ll"] == pytest.approx(w) for w in want)
    assert run(online.windowed_counts(stream), "wins", "update").agg(F.sum("count")).first()[0] >= 5


def test_every_positive_has_a_negative(spark, rows):
    text = "ord int, seq string"
    pos = spark.createDataFrame([(1, "a" * 5), (2, "a" * 3), (3, "a" * 9), (4, "a" * 5), (5, ""), (6, None), (7, "a" * 3)], text)
    neg = spark.createDataFrame([(91, "cccc"), (92, "ggggggg"), (93, "t"), (94, None)], text)
    got = rows(evaluate.paired_negatives(pos, neg))
    assert got == [(1, "ggggg"), (2, "ccc"), (3, None), (4, "ggggg"), (5, ""), (7, "ggg")]
    assert rows(evaluate.paired_negatives(pos.where("ord = 1"), neg.limit(0))) == [(1, None)]


def test_no_input_is_left_without_a_record(spark):
    from strandloom.plans import queries, views

    folder = "/root/testdata/sf0.001"
    wanted = views.inputs(spark, folder).where("digits is not null")
    longest = views.fasta(spark, folder).agg(F.max(F.length("digits"))).first()[0]
    found = queries.paired_negatives(spark, folder)
    assert found.count() == wanted.count()
    assert found.where("seq is not null").count() == wanted.where(F.length("digits") <= longest).count()

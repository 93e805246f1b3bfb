import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import frequent, minimizers, spans, splits

RNG = random.Random(11)
dna = lambda n, letters="acgt": "".join(RNG.choice(letters) for _ in range(n))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 20, 21])
def test_rolled_numbers(size):
    c = np.random.default_rng(size).integers(0, 4, 60)
    assert minimizers.rolled(c, size, 4).tolist() == [sum(int(x) * 4 ** (size - 1 - i) for i, x in enumerate(c[j : j + size])) for j in range(61 - size)]
    assert minimizers.window_minima(c, size).tolist() == [min(c[j : j + size]) for j in range(61 - size)]


def spans_by_windows(texts, size):
    seen = {}
    clean = {k: "".join(t.split()).lower() for k, t in texts.items() if t}
    for k, t in clean.items():
        for i in range(len(t) - size + 1):
            w = t[i : i + size]
            if not set(w) - set("acgt"):
                seen.setdefault(w, set()).add(k)
    out = []
    for k, t in clean.items():
        on = [i for i in range(len(t) - size + 1) if len(seen.get(t[i : i + size], ())) > 1]
        cover = sorted({j for i in on for j in range(i, i + size)})
        for j in cover:
            if out and out[-1][0] == k and out[-1][2] == j:
                out[-1][2] = j + 1
            else:
                out.append([k, j, j + 1])
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("size", [24, 40])
def test_shared_spans(spark, rows, monkeypatch, size):
    monkeypatch.setattr(spans, "PIECE", 100)
    base, tail = dna(300), dna(120)
    texts = {
        1: base, 2: dna(50) + base[40:180].upper() + dna(30), 3: base[100:160] + tail, 4: "n" * 10 + tail[:70] + "\r\n" + tail[70:], 5: "", 6: None, 7: dna(39),
        8: "at" * 60, 9: "ta" * 50, 10: "a" * 90, 11: dna(20) + "a" * 50, 12: base[:30] + "n" + base[31:100], 13: base[50:110] + base[50:110], 14: "acgtn" * 30, 15: tail[::-1],
    }
    df = spark.createDataFrame(list(texts.items()), "id long, s string")
    assert rows(spans.shared_spans(df, "id", "s", size)) == spans_by_windows(texts, size)
    share = {r["id"]: r for r in spans.shared_part(df, spans.shared_spans(df, "id", "s", size), "id", "s").collect()}
    assert share[13]["share"] == 1.0 and share[5]["share"] is None and share[6]["n_symbols"] == 0 and share[15]["n_shared"] == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(t, n):
    t = list(t)
    for _ in range(n):
        i = RNG.randrange(len(t))
        kind = RNG.randrange(3)
        t[i : i + (kind != 1)] = [] if kind == 0 else [RNG.choice("acgtn")]
    return "".join(t)


def test_every_length_can_be_cut_into_passages():
    for n in range(60, 3000):
        e = splits.most_edits(n)
        for other in range(n, n * 2):
            if (other - n) * 100 > 4 * other:
                break
            assert other * 4 // 100 <= e
    least, most = splits.passage_size(60)
    assert least >= splits.HEAD and most < 2 * splits.HEAD


@pytest.mark.parametrize("bounds", [(20_000, 100_000), (5, 7)])
def test_overlapping_splits(spark, rows, monkeypatch, bounds):
    monkeypatch.setattr(splits, "MOST_PASSAGES", bounds[0])
    monkeypatch.setattr(splits, "MOST_STRETCHES", bounds[1])
    seqs, i = [], 0
    for n in [60, 61, 72, 75, 99, 100, 130, 200, 260] * 3:
        t = dna(n)
        if n == 260:
            t = t[:90] + "n" * RNG.choice([40, 70]) + t[150:]
        seqs += [(i, f"x/q-trainingset-{i % 3}.fa", None, t), (i + 1, None, f"X\\Q-TESTSET-{i % 3}.FASTA", "nn" + changed(t, RNG.randrange(0, 10)).upper() + "\n")]
        if n == 99:
            seqs += [(i + 2, " ", "q-1.fa", t), (i + 3, f"y-{i % 3}.fa", None, t)]
        i += 5
    seqs += [(900, None, None, dna(90)), (901, None, "b-1.fa", None), (902, "b-1.fa", None, ""), (903, "nofold.fa", None, dna(80)), (904, None, "c-1.fa", "n" * 80), (905, "c-1.fa", None, "n" * 80)]
    df = spark.createDataFrame(seqs, "seq_id long, tr string, te string, seq string")
    got = rows(splits.overlapping_splits(df, "seq_id", "seq", "tr", "te"), "seq_id_a", "seq_id_b", "distance")
    known = []
    for k, tr, te, t in seqs:
        tr = (tr or "").strip() or None
        name = tr or te
        digits = "".join(c for c in (name or "").rpartition("-")[2].split(".")[0] if c.isdigit())
        t = "".join((t or "").split()).lower().strip("n")
        if digits and len(t.replace("n", "")) >= 60:
            known.append((k, tr is not None, digits, t))
    want = []
    for a in known:
        for b in known:
            if a[1] and not b[1] and a[2] == b[2] and abs(len(a[3]) - len(b[3])) * 25 <= max(len(a[3]), len(b[3])):
                e = edits(a[3], b[3])
                if e * 25 <= max(len(a[3]), len(b[3])):
                    want.append((min(a[0], b[0]), max(a[0], b[0]), e))
    assert len(want) > 10 and got == sorted(want, key=str)


@pytest.mark.parametrize("percent", [2, 4, 6, 8, 10, 16])
def test_overlapping_splits_at_other_percentages(spark, rows, percent):
    """No pair is lost, also between texts whose shares of unknowns lie on different sides of the bound."""
    seqs, i = [], 0
    for n in [60, 63, 80, 110, 200] * 6:
        t = list(dna(n))
        for at in RNG.sample(range(2, n - 2), RNG.choice([0, 0, n * 4 // 100, n * 9 // 100, n * 12 // 100])):
            t[at] = "n"
        t = "".join(t)
        edit = list(t)
        for at in RNG.sample(range(2, n - 2), n * percent // 100):
            edit[at] = RNG.choice("nnn" + "acgt")
        seqs += [(i, "a-1.fa", None, t), (i + 1, None, "b-1.fa", "".join(edit)), (i + 2, None, "b-1.fa", changed(t, n * (percent + 2) // 100)), (i + 3, None, "b-1.fa", t[: n - n * percent // 100])]
        i += 4
    df = spark.createDataFrame(seqs, "seq_id long, tr string, te string, seq string")
    got = rows(splits.overlapping_splits(df, "seq_id", "seq", "tr", "te", percent=percent, least=50), "seq_id_a", "seq_id_b", "distance")
    known = [(k, tr, t.strip("n")) for k, tr, _, t in seqs]
    known = [x for x in known if len(x[2].replace("n", "")) >= 50]
    want = []
    for a, tr, x in known:
        for b, other, y in known:
            if tr and not other and abs(len(x) - len(y)) * 100 <= percent * max(len(x), len(y)):
                e = edits(x, y)
                if e * 100 <= percent * max(len(x), len(y)):
                    want.append((min(a, b), max(a, b), e))
    assert len(want) > 10 and got == sorted(want, key=str)


def test_passages_too_short_for_a_head_are_an_error(spark):
    df = spark.createDataFrame([(1, "a-1.fa", None, "acgt" * 20)], "seq_id long, tr string, te string, seq string")
    with pytest.raises(ValueError, match="passages"):
        splits.overlapping_splits(df, "seq_id", "seq", "tr", "te", percent=30, least=20)


def test_a_full_filter_loses_nothing(spark, rows, monkeypatch):
    texts = [dna(120) for _ in range(40)]
    data = [(i, "a-1.fa", None, t) for i, t in enumerate(texts)] + [(100 + i, None, "b-1.fa", changed(t, 3)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "seq_id long, tr string, te string, seq string")
    exact = rows(splits.overlapping_splits(df, "seq_id", "seq", "tr", "te"))
    monkeypatch.setattr(splits, "MOST_BITS", 1 << 12)
    monkeypatch.setattr(splits, "BITS_EACH", 1000)
    assert len(exact) >= 30 and rows(splits.overlapping_splits(df, "seq_id", "seq", "tr", "te")) == exact


def test_frequent_items_are_exact(spark, rows):
    rng = random.Random(2)
    stream = ["heavy"] * 400 + ["other"] * 150 + [f"x{rng.randrange(10**6)}" for _ in range(8000)] + [None] * 50
    rng.shuffle(stream)
    data = [(i, x, rng.randrange(4)) for i, x in enumerate(stream)]
    df = spark.createDataFrame([*data, *data[:500], (None, "heavy", 1)], "id long, m string, w long").repartition(5)
    got = rows(frequent.frequent_items(df, "id", F.col("m"), F.lit(1), 0.01))
    assert got == sorted([("heavy", 400, 8600), ("other", 150, 8600)], key=str)
    weights = Counter()
    for _, m, w in data:
        weights[m] += w
    total = sum(weights.values())
    got = rows(frequent.frequent_items(df, "id", F.col("m"), F.col("w"), 0.01))
    assert got == sorted([(m, n, total) for m, n in weights.items() if m and n >= 0.01 * total], key=str)
    assert frequent.frequent_items(df.where("false"), "id", F.col("m"), F.lit(1), 0.01).count() == 0
    nothing = df.withColumn("w", F.lit(None).cast("long"))
    assert frequent.frequent_items(nothing, "id", F.col("m"), F.col("w"), 0.01).count() == 0


@pytest.mark.parametrize("width", [1, 2, 8])
def test_items_that_share_every_bucket_are_found(spark, rows, width):
    """With so few buckets heavier items hide others on all levels; these are counted all the same."""
    data = [(i, x) for i, x in enumerate(["a"] * 300 + ["b"] * 200 + ["c"] * 150 + ["d"] * 30 + [f"x{j}" for j in range(320)])]
    df = spark.createDataFrame(data + data[:100], "id long, m string").repartition(4)
    got = rows(frequent.frequent_items(df, "id", F.col("m"), F.lit(1), 0.1, width=width))
    assert got == [("a", 300, 1000), ("b", 200, 1000), ("c", 150, 1000)]


def test_one_strand(spark):
    df = spark.createDataFrame([("AAC",), (" gtt",), ("acn",), ("",), (None,)], "m string")
    assert [r[0] for r in df.select(frequent.one_strand(F.col("m"))).collect()] == ["aac", "aac", None, None, None]

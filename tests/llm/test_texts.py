import base64
import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import cuts, leaks, tokens

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    with open(tokens.default_vocabulary(), "rb") as f:
        return tokens.read_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_merges(ranks, reference):
    rng = random.Random(3)
    words = ["a", "ab", "aaaaaaaa", "antidisestablishmentarianism", "配列は遅いです", "zqxj" * 40, "😀👩‍🔬", "a" * 3000]
    words += ["".join(rng.choice("abcdefghiklmnorst") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    for w in words:
        assert tokens.merge_bytes(w.encode(), ranks) == reference(w), w
    assert tokens.merge_bytes(b"", ranks) == []


def test_texts(spark, reference):
    texts = [None, "", " ", "\n\n  x", "it's <|endoftext|>", "d'accord 123456\t..", "x" * 20000 + " y", "né́e"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string")
    got = tokens.encode_texts(df, "doc_id", "text").collect()
    assert len(got) == 9
    for r in got:
        t = texts[r["doc_id"]]
        assert r["ids"] == (reference(t) if t else [])


def test_other_vocabulary(spark, tmp_path):
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    df = spark.createDataFrame([(1, "hé")], "k int, t string")
    assert tokens.encode_texts(df, "k", "t", str(path)).first()["ids"] == list("hé".encode())


def test_words():
    assert leaks.words_of("A&nbsp;<b class='x'>Bold</b>[quote=me]so­ft​[/quote] 3.14 a_b &lt;i&gt;x [not] a < b > c") == ["a", "bold", "soft", "3", "14", "a", "b", "x", "not", "a", "b", "c"]


ITEM = "which compiler of the heavy tripod grows first when three contigs are moved overnight on a sunday in the garden"


def leak_rows(spark):
    words = ITEM.split()
    texts = {
        1: "before " + ITEM.upper() + " after",
        2: "> " + "\n> ".join(words[2:15]),
        3: " ".join(words[:12]),
        4: "x " + " ".join(w if i != 9 else "other" for i, w in enumerate(words)),
        5: " ".join(words[:13]) + " zzz " + " ".join(words[:13]),
        6: None, 7: "", 8: "<b></b>", 9: " ".join(words[:6] + ["no"] + words[6:13]),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, "short item"), (12, None), (13, ITEM)], "item_id long, item_text string")
    return docs, items


@pytest.mark.parametrize("bound", [0, 1000])
def test_leaks(spark, rows, monkeypatch, bound):
    monkeypatch.setattr(leaks, "MOST_SEEDS", bound)
    monkeypatch.setattr(leaks, "MOST_WORDS", bound)
    monkeypatch.setattr(leaks, "MOST_HITS", bound)
    docs, items = leak_rows(spark)
    found = leaks.overlaps(docs, items)
    assert rows(leaks.leaks(found)) == sorted([(d, i) for d in (1, 2, 5) for i in (10, 13)], key=str)
    changed = found.where("doc_id = 4 and item_id = 10").collect()
    assert changed and (changed[0]["n_same"], changed[0]["n_words"], changed[0]["longest"]) == (19, 20, 10)


def most_avoided(masks, length):
    """The most points (1 for a same word, -4 for another) of ``length`` words that hold no window of the masks."""
    span = max(map(len, masks))
    ends = [int(m, 2) for m in masks]
    best = {0: 0}
    for _ in range(length):
        new = {}
        for state, points in best.items():
            for same in (0, 1):
                seen = state << 1 | same
                if not any(seen & m == m for m in ends):
                    seen &= (1 << (span - 1)) - 1
                    new[seen] = max(new.get(seen, -(10**9)), points + (1 if same else -4))
        best = new
    return max(best.values())


def test_masks_find_every_overlap():
    """Points of 0 or more are 80 %. Longer stretches are made up of parts of 13 to 25 words, of which one has 0 or more."""
    assert all(most_avoided(leaks.MASKS, n) < 0 for n in range(13, 26))
    assert most_avoided(leaks.VERBATIM, 13) == 8


def test_overlaps_with_substituted_words(spark):
    words = ["w%d" % i for i in range(100)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, item_text string")
    changed = {1: (13, (3,)), 2: (13, (6,)), 3: (13, (9,)), 4: (13, (4, 8)), 5: (15, (3, 7, 11)), 6: (100, tuple(range(4, 100, 5)))}
    docs = [(d, " ".join("other%d" % i if i in at else w for i, w in enumerate(words[:n]))) for d, (n, at) in changed.items()]
    found = leaks.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), item).where("n_words >= 13 and n_same >= 0.8 * n_words")
    assert {r["doc_id"] for r in found.collect()} == set(changed)


def test_every_stretch_of_a_diagonal_is_found(spark, rows):
    """Two verbatim parts with other words between, and two that are one overlap as 80 % of both together are the same."""
    words = ["w%d" % i for i in range(100)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, item_text string")
    changed = {1: range(20, 80), 2: range(40, 50)}
    docs = [(d, " ".join("other%d" % i if i in at else w for i, w in enumerate(words))) for d, at in changed.items()]
    found = leaks.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), item)
    assert rows(found, "doc_id", "start", "n_same", "n_words", "longest") == [(1, 0, 20, 20, 20), (1, 80, 20, 20, 20), (2, 0, 90, 100, 50)]


def test_stretches_against_all_pairs():
    import numpy as np

    rng = random.Random(9)
    for _ in range(300):
        same = np.array([rng.random() < rng.choice((0.5, 0.8, 0.95)) for _ in range(rng.randrange(0, 60))], bool)
        good = [(a, b) for a in range(len(same)) for b in range(a + 13, len(same) + 1) if same[a] and same[b - 1] and 5 * same[a:b].sum() >= 4 * (b - a)]
        want = [(a, b) for a, b in good if not any(c <= a and b <= d and (a, b) != (c, d) for c, d in good)]
        assert leaks.stretches(same) == want


def test_random_leaks_against_all_windows(spark, rows):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(6)]
    items = {i: [rng.choice(vocab) for _ in range(30)] for i in range(8)}
    docs = {}
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(25)]
        i, a, n = rng.randrange(8), rng.randrange(15), rng.randrange(10, 16)
        docs[d] = w[:9] + items[i][a : a + n] + w[9:]
    windows = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    want = [(d, i) for d in docs for i in items if windows(docs[d]) & windows(items[i])]
    make = lambda x, a, b: spark.createDataFrame([(k, " ".join(w)) for k, w in x.items()], f"{a} long, {b} string")
    assert rows(leaks.leaks(leaks.overlaps(make(docs, "doc_id", "text"), make(items, "item_id", "item_text")))) == sorted(want, key=str)


def corpus(seed=0):
    rng = random.Random(seed)
    nouns, verbs = "tent oven gel plate motif lens shard kettle".split(), "fails jams hums splits stalls leaks".split()
    sentence = lambda: rng.choice([
        f"Do not trust the {rng.choice(nouns)}, it {rng.choice(verbs)} when the {rng.choice(nouns)} reaches {rng.randrange(99)}",
        f"I compared the {rng.choice(nouns)} on sunday and the {rng.choice(nouns)} still {rng.choice(verbs)}",
        f"We repaired the {rng.choice(nouns)} overnight, which explains the broken {rng.choice(nouns)}",
    ])
    docs = []
    for i in range(1500):
        text = ". ".join(sentence() for _ in range(rng.randrange(1, 7))) + rng.choice([".", ".", "", "...", " xD"])
        cut = i % 10 == 0
        if cut:
            words = text.rstrip(".").split(" ")
            n = rng.randrange(3, max(4, len(words) - 1))
            text = " ".join(words[:n])
            if text[-1] in ".,":
                text = text[:-1] + " the"
        docs.append((i, text, "abc"[i % 3], cut))
    return docs


def test_cut_texts_are_found(spark):
    docs = corpus()
    df = spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, source string")
    found = {r["doc_id"]: r["reason"] for r in cuts.cut_texts(df).collect()}
    true = {d[0] for d in docs if d[3]}
    assert len(true & set(found)) >= 0.85 * len(true)
    assert len(set(found) - true) <= 0.02 * len(docs)
    rates = cuts.cut_rates(df, cuts.cut_texts(df)).collect()
    assert sum(r["n_docs"] for r in rates) == 1500 and sum(r["n_cut"] for r in rates) == len(found)


def test_copies_of_a_cut_text_do_not_vouch_for_its_end(spark):
    docs = [d[:3] for d in corpus(2)]
    own = "Do not trust the tent, it hums when the motif reaches 7. We repaired the gel overnight, which explains the"
    once = spark.createDataFrame(docs + [(7000, own, "a")], "doc_id long, text string, source string")
    copies = spark.createDataFrame(docs + [(7000 + i, own, "abc"[i % 3]) for i in range(100)], "doc_id long, text string, source string")
    alone = {r["doc_id"]: r["reason"] for r in cuts.cut_texts(once).collect()}
    found = {r["doc_id"]: r["reason"] for r in cuts.cut_texts(copies).collect()}
    assert {i: found.get(i) for i in range(7000, 7100)} == {i: "sentence" for i in range(7000, 7100)}
    assert {i: r for i, r in found.items() if i < 7000} == {i: r for i, r in alone.items() if i < 7000}


def test_limits_markup_and_marks(spark):
    docs = [d[:3] for d in corpus(1)]
    docs += [(5000 + i, ("I compared the oven on sunday and the gel still hums. " * 20)[i : i + 300], "limited") for i in range(12)]
    docs += [(6000, "It works.<br", "x"), (6001, "It works. [...]", "x"), (6002, "It works.\n[size=1]NAME", "x"), (6003, "It works. [size=1]NAME[/size]", "x"), (6004, "[deleted]", "x"), (6005, None, "x"), (6006, "  ", None), (6007, "It works. ...", None), (6007, "It works. ...", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = [(r["doc_id"], r["reason"]) for r in cuts.cut_texts(df).where("doc_id >= 5000").collect()]
    assert sorted(found) == [(5000 + i, "limit") for i in range(12)] + [(6000, "markup"), (6001, "limit"), (6002, "markup"), (6007, "sentence")]


def test_limits_near_each_other(spark):
    sizes = [(s, 60) for s in (280, 281, 283)] + [(s, 4) for s in range(240, 330) if s not in (280, 281, 283)] + [(500, 8)]
    rows = [("a", s * 1000 + i, [("text", s)]) for s, n in sizes for i in range(n)]
    texts = spark.createDataFrame(rows + rows, "source string, text_hash long, sizes array<struct<unit string, size int>>")
    assert sorted(r["size"] for r in cuts.field_limits(texts).collect()) == [280, 281, 283, 500]


def test_tokens(spark):
    df = spark.createDataFrame([("<b>It's</b> 3.14%! 速い<br>Next\n\nlast&nbsp;",)], "t string")
    assert df.select(cuts.tokens(F.col("t"))).first()[0] == ["it's", "#", ".", "速", "い", ".", "next", ".", "last"]

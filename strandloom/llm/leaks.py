"""Passages of evaluation items in training texts, by spaced-seed hashing.

Words are hashed; a seed is the hash of a window of words at the places that a
fixed mask shows, so a window still hits where words at hidden places differ.
Seeds of training texts are joined with those of the evaluation items, and
for every hit the two texts are laid over each other along the hit's diagonal
and compared word by word, which gives the overlaps with their substituted
words and the longest verbatim passage.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import small, stable

#: Masks over windows of words: 1 = the word counts, 0 = any word may stand there. Every stretch of 13 words or more
#: of which 80 % are the same, wherever the others stand, holds a window of one of them (fixed values).
MASKS = ("1111011", "1101111", "11101000011")
#: The mask that 13 consecutive equal words have, for searches of verbatim passages alone (fixed value).
VERBATIM = ("1" * 13,)
#: Words of an overlap at least, and the share of them that are the same (fixed values, those that the masks are made for).
LEAST, SHARE = 13, (4, 5)
#: Names of BBCode tags (fixed values).
BBCODE = ("b", "i", "u", "s", "quote", "url", "img", "size", "color", "code", "list", "font", "center", "left", "right", "email", "spoiler", "sup", "sub", "table", "tr", "td", "th", "hr", "pre", "youtube", "attach", r"\*")
#: Seeds and words of evaluation items that are broadcast at most (128 MB each); more are joined by shuffling.
MOST_SEEDS, MOST_WORDS = 2_000_000, 8_000_000
#: Hits that are broadcast at most.
MOST_HITS = 200_000

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_BBCODE = re.compile(r"\[/?(?:" + "|".join(BBCODE) + r")(?:[=\s][^\[\]]*)?\]", re.I)
_UNSEEN = re.compile("[­​-‏⁠-⁤﻿᠎]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words of a text: entities decoded, tags blanked, unseen characters dropped, lower case, runs of letters and digits."""
    text = html.unescape(text) if "&" in text else text
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[" in text:
        text = _BBCODE.sub(" ", text)
    return _WORD.findall(_UNSEEN.sub("", text).lower())


def word_hashes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``words``, the 64-bit hashes of the words in order; texts without a word are left out."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > 300_000:
                known.clear()
            rows = []
            for t in batch.column(1).to_pylist():
                row = []
                for w in words_of(t):
                    h = known.get(w)
                    if h is None:
                        h = xxhash.xxh64_intdigest(w) - (1 << 63)
                        known[w] = h
                    row.append(h)
                rows.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["key", "words"])

    plain = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    return plain.mapInArrow(run, f"key {kind}, words array<bigint>").where(F.size("words") > 0).withColumnRenamed("key", key)


def seeds(words: DataFrame, key: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """``key, mask, place, seed`` of every window of every text."""
    kind = dict(words.dtypes)[key]
    shown = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().view(np.uint64)
            sizes = np.diff(offsets)
            begin = offsets[:-1]
            for m, at in enumerate(shown):
                count = np.maximum(sizes - len(masks[m]) + 1, 0)
                row = np.repeat(np.arange(len(sizes)), count)
                place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                where = np.repeat(begin, count) + place
                seed = np.full(len(row), m + 1, np.uint64)
                for i in at:
                    seed = (seed ^ flat[where + i]) * np.uint64(0x9E3779B97F4A7C15)
                    seed ^= seed >> np.uint64(29)
                for a in range(0, len(row), 100_000):
                    b = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row[b])), pa.array(np.full(len(row[b]), m, np.int32)), pa.array(place[b].astype(np.int32)), pa.array(seed[b].view(np.int64))],
                        ["key", "mask", "place", "seed"],
                    )

    schema = f"key {kind}, mask int, place int, seed bigint"
    return words.select(key, "words").mapInArrow(run, schema).withColumnRenamed("key", key)


def stretches(same: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of every stretch of ``LEAST`` words or more that has ``SHARE`` of same words and lies in no longer one, of the marks of a diagonal.

    Stretches begin and end with a same word. Two may have a part in common, as
    both together may have too few same words.
    """
    if same.sum() * SHARE[1] < LEAST * SHARE[0]:
        return []
    points = np.r_[0, np.cumsum(np.where(same, SHARE[1] - SHARE[0], -SHARE[0]))]
    lows = np.flatnonzero(points < np.r_[1, np.minimum.accumulate(points)[:-1]])
    highs = np.maximum.accumulate(points[::-1])
    ends = len(same) - np.searchsorted(highs, points[lows])
    found: list[tuple[int, int]] = []
    at = np.flatnonzero(same)
    for low, end in zip(lows.tolist(), ends.tolist()):
        i, j = np.searchsorted(at, (low, end))
        if i == j:
            continue
        begin, end = int(at[i]), int(at[j - 1]) + 1
        if end - begin < LEAST or (found and end <= found[-1][1]):
            continue
        if found and begin == found[-1][0]:
            found.pop()
        found.append((begin, end))
    return found


def overlaps(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text", masks: tuple[str, ...] = MASKS) -> DataFrame:
    """Overlaps of texts and items on the diagonals of their common seeds.

    One row for each text, item, diagonal that a seed hit and stretch of it:
    ``shift`` (place in the text less place in the item), ``start`` (place in
    the text), ``n_same`` and ``n_words`` (same words and all words of the
    stretch), and ``longest``, the most consecutive same words anywhere on the
    diagonal. Stretches are those of ``stretches``: 13 words or more, of which
    80 % are the same; what lies between two of them does not count for either.

    Null, empty and wordless texts have no overlaps. Texts and items shorter
    than the masks have no seeds, so no overlaps. Repeated rows of
    an id count once. The items' seeds (checked against ``MOST_SEEDS``), their
    words (``MOST_WORDS``) and the hits (``MOST_HITS``) are broadcast; beyond,
    the joins shuffle. Of each hit only the two pieces that lie over each other
    go to Python.
    """
    item_words = stable(word_hashes(items.dropDuplicates([item]), item, item_text))
    doc_words = stable(word_hashes(docs, doc, text))
    probes = stable(seeds(item_words, item, masks).withColumnRenamed("place", "item_place"))
    n_words = item_words.agg(F.sum(F.size("words"))).first()[0] or 0
    laid_items = item_words.withColumnRenamed("words", "item_words")
    hits = (
        seeds(doc_words, doc, masks)
        .join(small(probes, MOST_SEEDS), ["mask", "seed"])
        .select(doc, item, (F.col("place") - F.col("item_place")).alias("shift"))
        .distinct()
    )
    hits = stable(hits)
    laid = doc_words.join(small(hits, MOST_HITS), doc).join(F.broadcast(laid_items) if n_words <= MOST_WORDS else laid_items, item)
    low = F.greatest(F.lit(0), F.col("shift"))
    n = F.least(F.size("words"), F.size("item_words") + F.col("shift")) - low
    pieces = laid.select(F.slice("words", low + 1, n).alias("x"), F.slice("item_words", low - F.col("shift") + 1, n).alias("y"), low.alias("low"), "shift", doc, item)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            a, b = batch.column(0), batch.column(1)
            marks, offsets = a.flatten().to_numpy() == b.flatten().to_numpy(), np.cumsum(np.r_[0, np.diff(a.offsets.to_numpy())])
            for r, low in enumerate(batch.column(2).to_pylist()):
                same = marks[offsets[r] : offsets[r + 1]]
                found = stretches(same)
                if found:
                    edges = np.flatnonzero(np.diff(np.r_[0, same.astype(np.int8), 0]))
                    longest = int((edges[1::2] - edges[::2]).max())
                    rows += [(r, low + start, int(same[start:end].sum()), end - start, longest) for start, end in found]
            at, *cols = (pa.array(c, pa.int32()) for c in (zip(*rows) if rows else [()] * 5))
            yield pa.RecordBatch.from_arrays(
                [batch.column(4).take(at), batch.column(5).take(at), batch.column(3).take(at), *cols],
                ["doc", "item", "shift", "start", "n_same", "n_words", "longest"],
            )

    types = dict(docs.dtypes)[doc], dict(items.dtypes)[item]
    found = pieces.mapInArrow(
        compare, f"doc {types[0]}, item {types[1]}, shift int, start int, n_same int, n_words int, longest int"
    )
    return found.withColumnsRenamed({"doc": doc, "item": item}).dropDuplicates([doc, item, "shift", "start"])


def leaks(found: DataFrame, doc: str = "doc_id", item: str = "item_id", least: int = 13) -> DataFrame:
    """Texts and items with at least ``least`` consecutive words in common, of ``overlaps``."""
    return found.where(F.col("longest") >= least).select(doc, item).distinct()

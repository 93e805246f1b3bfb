"""Token ids of texts by a public byte-level BPE vocabulary.

Spark cuts the corpus into Arrow batches; inside a task each word of a text is
encoded by a segment tree over its byte positions whose root holds the leftmost
pair of least rank, so a merge costs three point updates of logarithmic depth
and even a word of a million bytes stays fast.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words whose ids a task remembers before it starts afresh.
REMEMBERED = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Byte strings and their ranks from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: merge the leftmost pair of least rank until none is left.

    A leaf i of the tree holds the rank of the token that starts at byte i
    joined with the next token, together with i, so that the least entry is
    also the leftmost. An empty word has no ids.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n == 0:
        return []
    none = 1 << 62
    size = 1 << (n - 1).bit_length()
    tree = [none] * (2 * size)
    end = list(range(1, n + 1))  # end of the token that starts here
    begin = list(range(-1, n))  # start of the token before the one that starts here
    get = ranks.get
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        if tree[i] == value:
            return
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    def rank(i: int) -> int:
        j = end[i]
        if j >= n:
            return none
        r = get(word[i : end[j]])
        return none if r is None else r << 32 | i

    while tree[1] != none:
        i = tree[1] & 0xFFFFFFFF
        j = end[i]
        end[i] = end[j]
        if end[j] < n:
            begin[end[j]] = i
        put(j, none)
        put(i, rank(i))
        if begin[i] >= 0:
            put(begin[i], rank(begin[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


def text_encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[str], list[int]]:
    """A function that gives the ids of a text; it remembers a bounded number of words."""
    import regex

    words = regex.compile(pattern).findall
    known: dict[str, list[int]] = {}

    def encode(text: str) -> list[int]:
        ids: list[int] = []
        for w in words(text):
            got = known.get(w)
            if got is None:
                got = merge_bytes(w.encode(), ranks)
                if len(w) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = got
            ids += got
        return ids

    return encode


def encode_texts(docs: DataFrame, key: str, text: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of every row, in any order.

    The text is taken as stored, special tokens are not used. An empty or null
    text has the empty list. Rows with a null key or repeated rows are kept.
    ``vocabulary`` is the path of a file of ranks (the driver reads it, under
    1 MB, and broadcasts it); ``pattern`` cuts a text into words.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())
    cut = pattern or default_pattern()
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(read_ranks(lines.value), cut)
        for batch in batches:
            rows = [encode(t) if t else [] for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.fromiter((x for r in rows for x in r), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)

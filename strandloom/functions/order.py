"""Order-n codes: a symbol together with the n symbols before it.

With K symbols, ``code = sum of x[t-d] * K**d``: the newest symbol has weight 1.
K stands for an unknown symbol and K**(n+1) for an unknown code; the first n
codes of a sequence are unknown.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OrderCodes:
    """Sizes for an alphabet and an order; codes above 2**32 - 1 are refused."""

    alphabet: int
    order: int

    def __post_init__(self) -> None:
        if self.alphabet < 1 or self.order < 0:
            raise ValueError("an alphabet has a symbol at least and an order is not negative")
        if (self.order + 1) * math.log(self.alphabet) > math.log(2**32 - 1):
            raise ValueError(f"order {self.order} over {self.alphabet} symbols needs more than 32 bits")

    @property
    def size(self) -> int:
        return self.alphabet ** (self.order + 1)

    @property
    def contexts(self) -> int:
        return self.alphabet**self.order

    def encode(self, obs: Column) -> Column:
        """Array of symbols to the array of codes of the same length."""
        k, n = self.alphabet, self.order

        def code(x: Column, i: Column) -> Column:
            parts = [x] + [F.get(obs, i - d) for d in range(1, n + 1)]
            known = parts[0] < k
            total = parts[0].cast("bigint")
            for d in range(1, n + 1):
                known = known & (parts[d] < k)
                total = total + parts[d].cast("bigint") * (k**d)
            checked = F.when(x > k, F.raise_error(F.lit("a symbol lies outside of the alphabet")).cast("bigint"))
            return F.coalesce(checked, F.when((i >= n) & F.coalesce(known, F.lit(False)), total).otherwise(F.lit(self.size).cast("bigint")))

        return F.transform(obs, code)

    def symbol(self, code: Column) -> Column:
        """Newest symbol of a code."""
        return F.when(code == self.size, F.lit(self.alphabet).cast("bigint")).otherwise(code % self.alphabet)

    def decode(self, codes: Column) -> Column:
        """Array of codes to the array of symbols; an error if the codes do not fit each other."""
        bad = F.raise_error(F.lit("no valid sequence of codes")).cast("array<bigint>")
        return F.when(self.valid(codes), F.transform(codes, self.symbol)).otherwise(bad)

    def previous(self, code: Column) -> Column:
        """The n symbols before the newest."""
        return F.when(code == self.size, F.lit(self.contexts).cast("bigint")).otherwise(F.floor(code / self.alphabet).cast("bigint"))

    def following(self, code: Column) -> Column:
        """The newest n symbols, the context of what follows."""
        return F.when(code == self.size, F.lit(self.contexts).cast("bigint")).otherwise(code % self.contexts)

    def encode_window(self, window: Column) -> Column:
        """Code of an array of exactly n + 1 symbols in reading order."""
        k = self.alphabet
        total = F.aggregate(window, F.lit(0).cast("bigint"), lambda a, x: a * k + x)
        code = F.when(F.exists(window, lambda x: x >= k), F.lit(self.size).cast("bigint")).otherwise(total)
        bad = F.raise_error(F.lit(f"a window has {self.order + 1} symbols")).cast("bigint")
        return F.when(F.size(window) == self.order + 1, code).otherwise(bad)

    def decode_window(self, code: Column) -> Column:
        """The n + 1 symbols of a code in reading order; all unknown for the unknown code."""
        k = self.alphabet
        digits = F.array(*[F.floor(code / k**d).cast("bigint") % k for d in range(self.order, -1, -1)])
        return F.when(code == self.size, F.array_repeat(F.lit(k).cast("bigint"), self.order + 1)).otherwise(digits)

    def valid(self, codes: Column) -> Column:
        """All codes in range, and known neighbours overlap."""
        k = self.alphabet

        def fits(x: Column, i: Column) -> Column:
            before = F.get(codes, i - 1)
            both = (i > 0) & (x < self.size) & (before < self.size)
            return (x <= self.size) & (~both | (before % self.contexts == F.floor(x / k).cast("bigint")))

        return F.forall(F.transform(codes, fits), lambda ok: F.coalesce(ok, F.lit(True)))

    def valid_symbols(self, obs: Column) -> Column:
        return F.forall(obs, lambda x: x <= self.alphabet)

    def n_known(self, codes: Column) -> Column:
        """Codes other than the unknown one."""
        return F.size(F.filter(codes, lambda x: x != self.size))


def alphabet_of(size: int, order: int) -> int:
    """Alphabet whose order-n codes number ``size``; an error if there is none."""
    root = round(size ** (1 / (order + 1)))
    if root ** (order + 1) != size:
        raise ValueError(f"{size} is no power {order + 1} of a whole number")
    return root


class Orders:
    """The order-n views of a collection ``seq_id, obs``, each made once and cached until ``release``."""

    def __init__(self, sequences: DataFrame, alphabet: int) -> None:
        self.sequences, self.alphabet, self._views = sequences, alphabet, {}

    def __getitem__(self, order: int) -> DataFrame:
        if order not in self._views:
            codes = OrderCodes(self.alphabet, order).encode(F.col("obs"))
            self._views[order] = self.sequences.withColumn("obs", codes).cache()
        return self._views[order]

    def release(self) -> None:
        """Takes all views out of the cache."""
        for view in self._views.values():
            view.unpersist()
        self._views.clear()

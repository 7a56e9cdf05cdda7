"""BM25 and field lengths as Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def idf(self, docs: int, df: int) -> float:
        """docs: documents that have the field."""
        return math.log(1 + (docs - df + 0.5) / (df + 0.5))

    def tf(self, freq: Column, length: Column, mean: float) -> Column:
        """freq / (freq + k1 (1 - b + b length / mean)), without the factor k1 + 1."""
        f = freq.cast("double")
        return f / (f + F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * length / F.lit(mean)))

    def tf_of(self, freq: float, length: float, mean: float) -> float:
        return freq / (freq + self.k1 * (1 - self.b + self.b * length / mean))

    def bound(self, docs: int, df: int) -> float:
        """No document's score for the term is above this (tf is below 1)."""
        return self.idf(docs, df)


def rounded_length(length: Column) -> Column:
    """The length as one byte keeps it: exact below 24, then four significant bits of what is above."""
    over = length.cast("int") - 24
    drop = F.greatest(F.length(F.bin(over)) - 4, F.lit(0)).cast("int")
    power = F.pow(F.lit(2.0), drop)
    return F.when(length < 24, length.cast("int")).otherwise((24 + F.floor(over / power) * power).cast("int"))


def rounded_length_of(length: int) -> int:
    if length < 24:
        return length
    drop = max((length - 24).bit_length() - 4, 0)
    return 24 + ((length - 24) >> drop << drop)

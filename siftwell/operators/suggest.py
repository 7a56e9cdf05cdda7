"""Prefix suggestions by weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suggester(rows: DataFrame, order: str) -> DataFrame:
    """term, weight from (term, weight, order): of a repeated term the first weight."""
    return rows.groupBy("term").agg(F.min_by("weight", order).alias("weight"))


def completions(terms: DataFrame, prefix: str, n: int) -> DataFrame:
    """suffix, weight of the n heaviest terms with the prefix, ties in order of the suffix."""
    rows = terms.filter(F.col("term").startswith(prefix))
    return rows.select(F.substr("term", F.lit(len(prefix) + 1)).alias("suffix"), "weight").orderBy(F.desc("weight"), "suffix").limit(n)

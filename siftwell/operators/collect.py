"""Collectors over hits (doc_id, score): top k, sorts, collapse, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCLUDE = object()


def doc_ids(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id").orderBy("doc_id")


def top_docs(hits: DataFrame, n: int) -> DataFrame:
    """By score, ties to smaller doc_ids. Each task keeps n rows; n of all are merged."""
    return hits.orderBy(F.desc("score"), "doc_id").limit(n)


def reduced(values: DataFrame, column: str, selector: str | None) -> Column:
    """The value to sort by: of an array column its least or greatest."""
    if selector is None:
        return F.col(column)
    return {"min": F.array_min, "max": F.array_max}[selector](F.col(column))


def by_field(hits: DataFrame, docs: DataFrame, column: str, n: int | None = None, descending: bool = False, missing=EXCLUDE, selector: str | None = None) -> DataFrame:
    """doc_id, value: the hits in the order of a column, ties to smaller doc_ids; missing: a value for null, or EXCLUDE.

    hits may be docs itself: then nothing is joined.
    """
    value = reduced(docs, column, selector)
    value = value if missing is EXCLUDE else F.coalesce(value, F.lit(missing))
    rows = docs.select("doc_id", value.alias("value"))
    if hits is not docs:
        rows = rows.join(hits.select("doc_id"), "doc_id", "left_semi")
    rows = rows.filter(F.col("value").isNotNull())
    out = rows.orderBy(F.col("value").desc() if descending else F.col("value").asc(), "doc_id")
    return out if n is None else out.limit(n)


def collapse(hits: DataFrame, keys: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """doc_id, score, key: the best hit of each key; hits without one stand alone.

    The best of a key is found by a partial aggregation, so a key that many hits share is one row after the scan.
    """
    rows = hits.join(keys.select("doc_id", F.col(key).alias("key")), "doc_id", "left")
    best = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id"), F.max("score").alias("score"))
    alone = rows.filter(F.col("key").isNull())
    out = best.select("doc_id", "score", "key").unionByName(alone.select("doc_id", "score", "key"))
    return out if n is None else top_docs(out, n)


def union_docs(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [p.select("doc_id") for p in parts]).distinct()


def common_docs(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), [p.select("doc_id") for p in parts])


def without_docs(part: DataFrame, *gone: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select("doc_id"), "doc_id", "left_anti"), gone, part.select("doc_id"))



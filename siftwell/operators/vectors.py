"""Exact nearest neighbours by scanning all vectors: expressions inside the scan, k rows from each task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def similarity(vector: Column, query: Sequence[float], kind: str) -> Column:
    """euclidean 1 / (1 + d²), dot max((1 + dot) / 2, 0), cosine (1 + cos) / 2 (cos 0 at a zero norm), inner_product 1 + dot or 1 / (1 - dot)."""
    v, q = vector.cast("array<double>"), F.array(*[F.lit(float(x)) for x in query])
    if kind == "euclidean":
        return 1 / (1 + _sum(v, q, lambda a, b: (a - b) * (a - b)))
    dot = _sum(v, q, lambda a, b: a * b)
    if kind == "dot":
        return F.greatest((1 + dot) / 2, F.lit(0.0))
    if kind == "cosine":
        norm = F.sqrt(_sum(v, v, lambda a, b: a * b)) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
        return (1 + F.when(norm > 0, dot / norm).otherwise(0.0)) / 2
    if kind == "inner_product":
        return F.when(dot < 0, 1 / (1 - dot)).otherwise(1 + dot)
    raise ValueError(f"no similarity {kind!r}")


def nearest(vectors: DataFrame, query: Sequence[float], k: int, kind: str = "cosine", id_: str = "doc_id", column: str = "vector") -> DataFrame:
    """id and score of the k most similar vectors, ties to smaller ids; vectors of another length don't take part."""
    rows = vectors.filter(F.size(column) == len(query)).select(id_, similarity(F.col(column), query, kind).alias("score"))
    return rows.orderBy(F.desc("score"), id_).limit(k)


def vector_of(vectors: DataFrame, key, id_: str = "doc_id", column: str = "vector") -> DataFrame:
    return vectors.filter(F.col(id_) == key).select(column)

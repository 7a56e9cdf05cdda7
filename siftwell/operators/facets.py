"""Facets: counts of matching documents by label or by numeric range."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _labels(docs: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    if docs.schema[column].dataType.typeName() == "array":
        return docs.select("doc_id", F.explode(F.array_distinct(c)).alias("label"))
    return docs.select("doc_id", c.alias("label"))


def facet_counts(hits: DataFrame, docs: DataFrame, column: str) -> DataFrame:
    """label, count: every label of the documents, also those that no hit has; each value of an array counts."""
    labels = _labels(docs, column).filter(F.col("label").isNotNull())
    if hits is docs:
        return labels.groupBy("label").agg(F.count("*").alias("count"))
    marked = labels.join(hits.select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return marked.groupBy("label").agg(F.count("hit").alias("count"))


def labels(docs: DataFrame, column: str) -> DataFrame:
    """ord, label: the labels of a column in order. Labels are distinct first; only they are numbered in one task."""
    found = _labels(docs, column).filter(F.col("label").isNotNull()).select("label").distinct()
    return found.select((F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("ord"), "label")


def top_facets(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("count"), "label").limit(n)


@dataclass(frozen=True)
class NumericRange:
    label: str
    low: float | None = None
    high: float | None = None
    low_in: bool = True
    high_in: bool = True

    def holds(self, c: Column) -> Column:
        out = c.isNotNull()
        if self.low is not None:
            out = out & ((c >= self.low) if self.low_in else (c > self.low))
        if self.high is not None:
            out = out & ((c <= self.high) if self.high_in else (c < self.high))
        return out


def range_facets(values: DataFrame, column: str, ranges: Sequence[NumericRange]) -> DataFrame:
    """ord, label, count for each range in the given order, in one pass; ranges may overlap, empty ones count 0."""
    sums = [F.coalesce(F.sum(r.holds(F.col(column)).cast("long")), F.lit(0)).alias(f"c{k}") for k, r in enumerate(ranges)]
    row = values.agg(*sums)
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(r.label).alias("label"), F.col(f"c{k}").alias("count")) for k, r in enumerate(ranges)])))

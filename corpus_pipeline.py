"""A corpus in four stages: quality rules, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm._common import free, free_unread, materialize, table, written
from siftwell.llm.ngram_join import Join, keep_one
from siftwell.llm.packing import pack, production_tokenizer
from siftwell.llm.quality import keep_good
from siftwell.llm.secret_scan import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What earlier stages have written for themselves; it goes when a stage begins that doesn't read it.
_left: list[DataFrame] = []


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free_unread(_left, docs)
        with written() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject, by themselves or by their host, go."""
    return keep_good(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words a shingle, a Jaccard similarity of 0.8 or more."""
    return keep_one(docs, Join(words=5, percent=80, n=docs.count()))


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are overwritten in the texts; all documents stay. Written here, with batches of some MB for the workers."""
    return materialize(redact(docs), "redacted")


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, with their places in sequences of 4096."""
    return pack(docs, production_tokenizer(spark), with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: Tokens and packing are no SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    _left.clear()
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        free(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    _left.clear()  # the result is still to be read
    return out

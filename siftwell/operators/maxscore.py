"""Top k of sums of term scores, by upper bounds: not every posting of a frequent term is grouped.

A term adds less than its idf to a score (tf is below 1). The n-th best score of the heaviest term alone is a lower bound
of the n-th best sum; the lightest terms whose idf together stay below it can't bring a document among the best by
themselves. Only the other terms' postings are grouped; what their sums and the light terms' bounds rule out goes, and the
light terms' postings are read for the documents that are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.similarity import Bm25
from siftwell.plans.compiler import Compiler
from siftwell.plans.query import Boolean, Boost, Clause, Term
from siftwell.sources.index import Snapshot

#: Doc_ids of the documents that are left, up to which the light terms' scan gets them by broadcast (8 MB).
BROADCAST_IDS = 1_000_000


def weights(clause: Clause) -> dict[tuple[str, str], float] | None:
    """The factor of each (field, term) if the clause is a sum of terms with positive boosts, else None."""
    if isinstance(clause, Term):
        return {(clause.field, clause.term): 1.0}
    if isinstance(clause, Boost) and clause.factor > 0:
        inner = weights(clause.inner)
        return None if inner is None else {k: v * clause.factor for k, v in inner.items()}
    if not isinstance(clause, Boolean) or clause.must or clause.must_not or clause.min_should > 1 or not clause.should:
        return None
    out: dict[tuple[str, str], float] = {}
    for part in clause.should:
        inner = weights(part)
        if inner is None:
            return None
        for k, v in inner.items():
            out[k] = out.get(k, 0.0) + v
    return out


def split(bounds: dict[tuple[str, str], float], low: float) -> tuple[list, list]:
    """(heavy, light) terms: the light ones' bounds together are below low."""
    light, total = [], 0.0
    for key in sorted(bounds, key=lambda k: (bounds[k], k)):
        if total + bounds[key] >= low:
            break
        total += bounds[key]
        light.append(key)
    return [k for k in bounds if k not in light], light


def contenders(index: Snapshot, clause: Clause, n: int, bm25: Bm25 | None = None, slack: float = 1e-9) -> DataFrame:
    """doc_id, score: the n best hits of the clause, and maybe others; any hit within slack of the n-th best is there.

    Clauses that aren't sums of terms, and sums that no bound shortens, give all hits.
    """
    bm25 = bm25 or Bm25()
    compiler, factors = Compiler(index, bm25), weights(clause)
    if factors is None:
        return compiler.compile(clause)
    compiler._stats(clause)
    scores: dict[tuple[str, str], Column] = {}
    bounds: dict[tuple[str, str], float] = {}
    for key, factor in factors.items():
        idf = compiler.idf(*key)
        if idf is not None:
            bounds[key] = factor * idf
            scores[key] = F.lit(factor * idf) * compiler._tf(key[0], F.col("freq"), index.length)
    enough = [k for k in bounds if compiler.df[k] >= n]
    if len(bounds) < 2 or not enough or n < 1:
        return compiler.compile(clause)
    fits = lambda keys: reduce(Column.__or__, [(F.col("field") == f) & (F.col("term") == t) for f, t in keys])
    score = reduce(lambda rest, k: F.when(fits([k]), scores[k]).otherwise(rest), scores, F.lit(0.0))
    rows = lambda keys: index.postings.filter(fits(keys)).select("doc_id", score.alias("score"))
    first = rows([max(enough, key=lambda k: (bounds[k], k))])
    best = first.orderBy(F.desc("score")).limit(n).agg(F.count("*").alias("n"), F.min("score").alias("low")).first()
    heavy, light = split(bounds, best["low"] - slack if best["n"] == n else 0.0)
    if not light:
        return compiler.compile(clause)
    rest = sum(bounds[k] for k in light)
    part = rows(heavy).groupBy("doc_id").agg(F.sum("score").alias("score")).filter(F.col("score") + F.lit(rest) >= F.lit(best["low"] - slack))
    ids = part.select("doc_id")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    more = rows(light).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return part.unionByName(more).groupBy("doc_id").agg(F.sum("score").alias("score"))

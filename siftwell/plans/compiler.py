"""From a clause tree to one Spark plan.

The leaves of the tree become predicates on the postings, which are scanned once under their disjunction and grouped by
document once; the tree itself is a pair of Columns (match, score) over the leaves' results, so Catalyst sees no join
between clauses. What a query needs of the dictionary (document frequencies of its own terms, at most max_expansions
terms of a fuzzy clause) is looked up first; that is bounded by the query. Clauses over document columns join once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import patterns
from siftwell.functions.similarity import Bm25
from siftwell.plans.query import SPANS, Boolean, Boost, Clause, ConstantScore, DisjunctionMax, Fuzzy, MatchAll, MatchNone, Phrase, Prefix, Range, Regexp, SpanNear, SpanOr, SpanTerm, Term, TermInSet, Wildcard, children, rewrite

if TYPE_CHECKING:
    from siftwell.sources.index import Snapshot


@dataclass
class Leaf:
    """A predicate on postings rows; what to keep of those that fit: nothing, the score, or positions."""

    name: str
    fits: Column
    score: Column | None = None
    positions: bool = False


@dataclass
class Compiler:
    index: Snapshot
    bm25: Bm25 = field(default_factory=Bm25)
    leaves: dict[tuple, Leaf] = field(default_factory=dict)
    on_docs: dict[str, Column] = field(default_factory=dict)
    needs_docs: bool = False

    # --- dictionary
    def _stats(self, tree: Clause) -> None:
        """Document frequencies of the query's own terms, in one bounded lookup."""
        wanted: dict[str, set[str]] = {}

        def walk(c: Clause) -> None:
            if isinstance(c, Term):
                wanted.setdefault(c.field, set()).add(c.term)
            elif isinstance(c, Phrase):
                wanted.setdefault(c.field, set()).update(c.terms)
            for x in children(c):
                walk(x)

        walk(tree)
        self.df = {}
        if wanted:
            any_ = reduce(Column.__or__, [(F.col("field") == f) & F.col("term").isin(*sorted(t)) for f, t in sorted(wanted.items())])
            self.df = {(r["field"], r["term"]): r["df"] for r in self.index.terms.filter(any_).select("field", "term", "df").collect()}

    def idf(self, field_: str, term: str) -> float | None:
        df = self.df.get((field_, term))
        return None if not df else self.bm25.idf(self.index.field_stats[field_]["doc_count"], df)

    def _tf(self, field_: str, freq: Column, length: Column) -> Column:
        return self.bm25.tf(freq, length, self.index.mean_length(field_))

    # --- leaves
    def _leaf(self, key: tuple, fits: Column, score: Column | None = None, positions: bool = False) -> Leaf:
        if key not in self.leaves:
            self.leaves[key] = Leaf(f"l{len(self.leaves)}", fits, score, positions)
        return self.leaves[key]

    def _term_positions(self, field_: str, term: str) -> Leaf:
        return self._leaf(("pos", field_, term), (F.col("field") == field_) & (F.col("term") == term), positions=True)

    def _flat(self, key: tuple, fits: Column) -> tuple[Column, Column]:
        leaf = self._leaf(key, fits)
        return F.coalesce(F.col(leaf.name), F.lit(False)), F.lit(1.0)

    def fuzzy_terms(self, c: Fuzzy) -> list[str]:
        """The first max_expansions dictionary terms within reach, in term order."""
        n = len(c.term)
        near = self.index.terms.filter((F.col("field") == c.field) & F.length("term").between(n - c.max_edits, n + c.max_edits))
        if c.prefix_length:
            near = near.filter(F.col("term").startswith(c.term[: c.prefix_length]))
        near = near.select("term").distinct()
        far = patterns.osa_udf(c.term)("term") if c.transpositions else F.levenshtein("term", F.lit(c.term))
        return [r["term"] for r in near.filter(far <= c.max_edits).orderBy("term").limit(c.max_expansions).collect()]

    # --- the tree
    def node(self, c: Clause) -> tuple[Column, Column]:
        """match (never null) and score (meaningful where it matches)."""
        of = F.col("field")
        if isinstance(c, Term):
            idf = self.idf(c.field, c.term)
            if idf is None:
                return F.lit(False), F.lit(0.0)
            fits = (of == c.field) & (F.col("term") == c.term)
            leaf = self._leaf(("term", c.field, c.term), fits, F.lit(idf) * self._tf(c.field, F.col("freq"), self.index.length))
            return F.col(leaf.name).isNotNull(), F.coalesce(F.col(leaf.name), F.lit(0.0))
        if isinstance(c, TermInSet):
            return self._flat(("set", c.field, tuple(sorted(set(c.terms)))), (of == c.field) & F.col("term").isin(*sorted(set(c.terms)))) if c.terms else (F.lit(False), F.lit(0.0))
        if isinstance(c, Prefix):
            return self._flat(("prefix", c.field, c.prefix), (of == c.field) & F.col("term").startswith(c.prefix))
        if isinstance(c, (Wildcard, Regexp)):
            expression, prefix = patterns.glob(c.pattern) if isinstance(c, Wildcard) else patterns.regexp(c.pattern)
            fits = (of == c.field) & (F.col("term").startswith(prefix) if prefix else F.lit(True)) & F.col("term").rlike(expression)
            return self._flat((type(c).__name__, c.field, c.pattern), fits)
        if isinstance(c, Fuzzy):
            return self.node(TermInSet(c.field, tuple(self.fuzzy_terms(c))))
        if isinstance(c, Phrase):
            return self._phrase(c)
        if isinstance(c, SPANS):
            spans = self._spans(c)
            return F.coalesce(F.size(spans) > 0, F.lit(False)), F.lit(1.0)
        if isinstance(c, Range):
            return self._range(c), F.lit(1.0)
        if isinstance(c, MatchAll):
            self.needs_docs = True
            return F.lit(True), F.lit(1.0)
        if isinstance(c, MatchNone):
            return F.lit(False), F.lit(0.0)
        if isinstance(c, Boost):
            m, s = self.node(c.inner)
            return m, s * F.lit(float(c.factor))
        if isinstance(c, ConstantScore):
            return self.node(c.inner)[0], F.lit(float(c.score))
        if isinstance(c, DisjunctionMax):
            if not c.clauses:
                return F.lit(False), F.lit(0.0)
            parts = [self.node(x) for x in c.clauses]
            each = [F.when(m, s) for m, s in parts]
            best = F.greatest(*each) if len(each) > 1 else each[0]
            total = reduce(Column.__add__, [F.coalesce(e, F.lit(0.0)) for e in each])
            return reduce(Column.__or__, [m for m, _ in parts]), best + F.lit(float(c.tie)) * (total - best)
        if isinstance(c, Boolean):
            return self._boolean(c)
        raise TypeError(f"no clause: {c!r}")

    def _boolean(self, c: Boolean) -> tuple[Column, Column]:
        must, should, must_not = ([self.node(x) for x in part] for part in (c.must, c.should, c.must_not))
        if not must and not should or c.min_should > len(should):
            return F.lit(False), F.lit(0.0)
        conditions = [m for m, _ in must]
        if c.min_should > 0:
            conditions.append(reduce(Column.__add__, [m.cast("int") for m, _ in should]) >= c.min_should)
        elif not must:
            conditions.append(reduce(Column.__or__, [m for m, _ in should]))
        conditions += [~m for m, _ in must_not]
        score = reduce(Column.__add__, [F.when(m, s).otherwise(0.0) for m, s in (*must, *should)])
        return reduce(Column.__and__, conditions), score

    def _phrase(self, c: Phrase) -> tuple[Column, Column]:
        if not c.terms:
            return F.lit(False), F.lit(0.0)
        if len(c.terms) == 1:
            return self.node(Term(c.field, c.terms[0]))
        idfs = [self.idf(c.field, t) for t in c.terms]
        if None in idfs:
            return F.lit(False), F.lit(0.0)
        at = [F.col(self._term_positions(c.field, t).name) for t in c.terms]
        there = reduce(Column.__and__, [a.isNotNull() for a in at])
        empty = F.array().cast("array<int>")
        if c.slop == 0:
            # sets of first positions meet: linear in the positions
            starts = reduce(F.array_intersect, [at[0]["p"], *(F.transform(a["p"], _less(k)) for k, a in enumerate(at[1:], 1))])
            freq = F.when(there, F.size(starts)).otherwise(0)
        else:
            rest = F.array(*[F.coalesce(a["p"], empty) for a in at[1:]])

            def step(s: Column, ps: Column) -> Column:
                nxt = F.array_min(F.filter(ps, lambda x: x > s["last"]))
                return F.struct(F.coalesce(nxt, F.lit(-1)).alias("last"), (s["gaps"] + F.coalesce(nxt, s["last"]) - s["last"] - 1).alias("gaps"), (s["ok"] & nxt.isNotNull()).alias("ok"))

            def fits(p: Column) -> Column:
                zero = F.struct(p.alias("last"), F.lit(0).alias("gaps"), F.lit(True).alias("ok"))
                return F.aggregate(rest, zero, step, lambda s: s["ok"] & (s["gaps"] <= c.slop))

            freq = F.when(there & F.exists(at[0]["p"], fits), 1).otherwise(0)
        length = F.col(self._term_positions(c.field, c.terms[0]).name)["n"]
        return freq > 0, F.lit(sum(idfs)) * self._tf(c.field, freq, length)

    def _spans(self, c: Clause) -> Column:
        """Sorted distinct spans (s, e) of a span clause."""
        none = F.array().cast("array<struct<s:int,e:int>>")
        if isinstance(c, SpanTerm):
            p = F.col(self._term_positions(c.field, c.term).name)["p"]
            return F.coalesce(F.transform(p, lambda x: F.struct(x.cast("int").alias("s"), (x + 1).cast("int").alias("e"))), none)
        if not isinstance(c, (SpanNear, SpanOr)):
            raise TypeError(f"not a span clause: {c!r}")
        parts = [self._spans(x) for x in c.clauses]
        if not parts:
            return none
        if isinstance(c, SpanOr):
            return F.sort_array(F.array_distinct(F.concat(*parts)))
        combos = F.transform(parts[0], lambda x: F.array(x))
        reach = c.slop + sum(map(_width, c.clauses))
        for part in parts[1:]:
            combos = F.flatten(F.transform(combos, _with_each(part, reach)))
        if not c.in_order:
            combos = F.transform(combos, lambda x: F.sort_array(x))

        def step(s: Column, x: Column) -> Column:
            return F.struct(x["e"].alias("e"), F.greatest(s["far"], x["e"]).alias("far"), (s["gaps"] + x["s"] - s["e"]).alias("gaps"), (s["ok"] & (x["s"] >= s["e"])).alias("ok"))

        def judged(spans: Column) -> Column:
            zero = F.struct(F.lit(0).alias("e"), F.lit(0).alias("far"), F.lit(0).alias("gaps"), F.lit(True).alias("ok"))
            first = F.struct(spans[0]["e"].alias("e"), spans[0]["e"].alias("far"), F.lit(0).alias("gaps"), F.lit(True).alias("ok"))
            out = F.aggregate(F.slice(spans, 2, 1 << 30), F.coalesce(first, zero), step)
            return F.struct((out["ok"] & (out["gaps"] <= c.slop)).alias("ok"), spans[0]["s"].alias("s"), out["far"].alias("e"))

        fit = F.filter(F.transform(combos, judged), lambda x: x["ok"])
        return F.sort_array(F.array_distinct(F.transform(fit, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    def _range(self, c: Range) -> Column:
        self.needs_docs = True
        name = f"d{len(self.on_docs)}"
        self.on_docs[name] = range_condition(c, self.index.documents)
        return F.coalesce(F.col(name), F.lit(False))

    # --- the plan
    def compile(self, tree: Clause) -> DataFrame:
        """doc_id and score of the live documents that match."""
        tree = rewrite(tree)
        self._stats(tree)
        match, score = self.node(tree)
        index = self.index
        if isinstance(tree, Term) and len(self.leaves) == 1:
            leaf = next(iter(self.leaves.values()))
            return index.postings.filter(leaf.fits).select("doc_id", leaf.score.cast("double").alias("score"))
        rows = None
        if self.leaves:
            any_ = reduce(Column.__or__, [x.fits for x in self.leaves.values()])
            kept = []
            for x in self.leaves.values():
                value = F.struct(F.col("positions").alias("p"), index.length.alias("n")) if x.positions else x.score if x.score is not None else F.lit(True)
                # a term leaf fits one row of a document, so any row's value is the only one
                kept.append((F.first(F.when(x.fits, value), ignorenulls=True) if x.positions else F.max(F.when(x.fits, value))).alias(x.name))
            rows = index.postings.filter(any_).groupBy("doc_id").agg(*kept)
        if self.needs_docs:
            docs = index.documents.select("doc_id", *[v.alias(k) for k, v in self.on_docs.items()])
            if rows is None:
                return docs.filter(match).select("doc_id", score.cast("double").alias("score"))
            rows = docs.join(rows, "doc_id", "left")
        if rows is None:
            return index.documents.select("doc_id").limit(0).withColumn("score", F.lit(0.0))
        return rows.filter(match).select("doc_id", score.cast("double").alias("score"))


def _less(k: int):
    return lambda p: p - k


def _width(c: Clause) -> int:
    """The most positions that a span of the clause takes up."""
    if isinstance(c, SpanTerm):
        return 1
    widths = [_width(x) for x in c.clauses]
    return max(widths, default=0) if isinstance(c, SpanOr) else sum(widths) + c.slop


def _with_each(part: Column, reach: int):
    """A function that appends each span of part to a list of spans, if it starts within reach of the list's first.

    Spans of one match lie one after the other with `slop` positions between them in all: none starts farther off.
    """

    def appended(have: Column) -> Column:
        near = F.filter(part, lambda y: F.abs(y["s"] - have[0]["s"]) <= reach)
        return F.transform(near, lambda y: F.concat(have, F.array(y)))

    return appended


def _between(low, high):
    def inside(v: Column) -> Column:
        parts = [v >= F.lit(low)] * (low is not None) + [v <= F.lit(high)] * (high is not None)
        return reduce(Column.__and__, parts) if parts else v.isNotNull()

    return inside


def range_condition(c: Range, docs: DataFrame) -> Column:
    """Inclusive bounds on columns; null never fits; of arrays any value (or the least or greatest)."""
    out = []
    for name, low, high in zip(c.columns, c.low, c.high, strict=True):
        array = docs.schema[name].dataType.typeName() == "array"
        value = F.col(name)
        if array and c.selector:
            value, array = (F.array_min if c.selector == "min" else F.array_max)(value), False

        inside = _between(low, high)
        out.append(F.exists(value, inside) if array else inside(value))
    return reduce(Column.__and__, out)

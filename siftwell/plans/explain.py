"""Why a document has its score: a tree whose values are those of the search."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions.similarity import Bm25
from siftwell.plans.compiler import Compiler
from siftwell.plans.query import Boolean, Boost, Clause, ConstantScore, DisjunctionMax, Explanation, MatchNone, Phrase, Term
from siftwell.sources.index import Snapshot


class Explainer:
    def __init__(self, index: Snapshot, bm25: Bm25 | None = None) -> None:
        self.index, self.bm25 = index, bm25 or Bm25()

    def _score(self, c: Clause, doc_id: int) -> float | None:
        row = Compiler(self.index, self.bm25).compile(c).filter(F.col("doc_id") == doc_id).first()
        return None if row is None else row["score"]

    def _idf(self, field: str, term: str) -> tuple[float, int, int] | None:
        if field not in self.index.field_stats:
            return None
        row = self.index.seek_exact(field, term).first()
        n = self.index.field_stats[field]["doc_count"]
        return row and (self.bm25.idf(n, row["df"]), row["df"], n)

    def _length(self, field: str, doc_id: int) -> float:
        row = self.index.postings.filter((F.col("field") == field) & (F.col("doc_id") == doc_id)).select(self.index.length.alias("n")).first()
        return float(row["n"]) if row else 1.0

    def _tf(self, freq: float, name: str, field: str, doc_id: int) -> Explanation:
        length, mean = self._length(field, doc_id), self.index.mean_length(field)
        value = self.bm25.tf_of(freq, length, mean)
        leaf = Explanation.match
        return leaf(value, "tfNorm, computed as freq / (freq + k1 * (1 - b + b * fieldLength / avgFieldLength)) from:", leaf(freq, name), leaf(self.bm25.k1, "k1"), leaf(self.bm25.b, "b"), leaf(length, "fieldLength"), leaf(mean, "avgFieldLength"))

    def explain(self, c: Clause, doc_id: int) -> Explanation:
        match, no = Explanation.match, Explanation.no_match
        if isinstance(c, Term):
            found = self._idf(c.field, c.term)
            if found is None:
                return no(f"no matching term: {c.field}:{c.term} is in no document")
            row = self.index.postings.filter((F.col("field") == c.field) & (F.col("term") == c.term) & (F.col("doc_id") == doc_id)).first()
            if row is None:
                return no(f"no matching term: doc={doc_id} lacks {c.field}:{c.term}")
            idf, df, n = found
            tf = self._tf(float(row["freq"]), "freq", c.field, doc_id)
            value = idf * tf.value
            of_idf = match(idf, "idf, computed as ln(1 + (docCount - docFreq + 0.5) / (docFreq + 0.5)) from:", match(df, "docFreq"), match(n, "docCount"))
            return match(value, f"weight({c.field}:{c.term}), result of:", match(value, f"score(freq={row['freq']}), computed as idf * tfNorm from:", of_idf, tf))
        if isinstance(c, Phrase) and len(c.terms) != 1:
            if not c.terms:
                return no("PhraseQuery with no terms matches nothing")
            value = self._score(c, doc_id)
            if value is None:
                return no(f"no matching phrase for doc={doc_id}")
            parts = [match(self._idf(c.field, t)[0], f"idf({c.field}:{t})") for t in c.terms]
            idf = sum(p.value for p in parts)
            ratio, mean = value / idf, self.index.mean_length(c.field)
            base = self.bm25.k1 * (1 - self.bm25.b + self.bm25.b * self._length(c.field, doc_id) / mean)
            freq = float(round(ratio * base / (1 - ratio)))
            words = " ".join(c.terms)
            return match(value, f'weight({c.field}:"{words}"), result of:', match(value, f"score(phraseFreq={freq:g}), computed as idf * tfNorm from:", match(idf, "idf, sum of each phrase term's own idf, from:", *parts), self._tf(freq, "phraseFreq", c.field, doc_id)))
        if isinstance(c, Phrase):
            return self.explain(Term(c.field, c.terms[0]), doc_id)
        if isinstance(c, Boolean):
            if not c.must and not c.should:
                return no("BooleanQuery with no must/should clauses matches nothing")
            must, should, must_not = ([self.explain(x, doc_id) for x in part] for part in (c.must, c.should, c.must_not))
            matched = [x for x in should if x.matched]
            least = max(c.min_should, 0 if c.must else 1)
            if not all(x.matched for x in must) or any(x.matched for x in must_not) or len(matched) < least:
                return no("Failure to meet condition(s) of required/prohibited clause(s)", *[x for x in must if not x.matched], *[x for x in must_not if x.matched])
            parts = [*must, *matched]
            total = sum(x.value for x in parts)
            return match(total, f"{total} = sum of:", *parts)
        if isinstance(c, DisjunctionMax):
            if not c.clauses:
                return no("DisjunctionMaxQuery with no disjuncts matches nothing")
            parts = [x for x in (self.explain(x, doc_id) for x in c.clauses) if x.matched]
            if not parts:
                return no(f"no matching disjunct for doc={doc_id}")
            best = max(x.value for x in parts)
            value = best + c.tie * (sum(x.value for x in parts) - best)
            return match(value, f"{value} = max of:, plus {c.tie} times others of:", *parts)
        if isinstance(c, ConstantScore):
            inner = self.explain(c.inner, doc_id)
            return match(c.score, f"{c.score} = ConstantScore, discarding the wrapped clause's own score") if inner.matched else no("no matching clause", inner)
        if isinstance(c, Boost):
            inner = self.explain(c.inner, doc_id)
            value = inner.value * c.factor
            return match(value, f"{value} = product of:", inner, match(c.factor, "boost")) if inner.matched else no("no matching clause", inner)
        if isinstance(c, MatchNone):
            return no("MatchNoDocsQuery never matches")
        return match(1.0, "1.0 = matches, unscored constant score") if self._score(c, doc_id) is not None else no("no matching term")

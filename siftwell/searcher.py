"""The search API over a snapshot."""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from siftwell.functions.similarity import Bm25
from siftwell.functions.text import Analyzer
from siftwell.operators import collect, facets, highlight, maxscore, vectors
from siftwell.plans.compiler import Compiler
from siftwell.plans.explain import Explainer
from siftwell.plans.parser import parse
from siftwell.plans.query import Clause, Explanation
from siftwell.sources.index import Snapshot


class Searcher:
    """scope: "global" statistics over all segments, or "segment": each segment's own, as if searched alone."""

    def __init__(self, index: Snapshot, bm25: Bm25 | None = None, scope: str = "global") -> None:
        if scope not in ("global", "segment"):
            raise ValueError(scope)
        self.index, self.bm25, self.scope = index, bm25 or Bm25(), scope

    def parse(self, query: str, default: str | None = None) -> Clause:
        analyzers: dict[str, Analyzer] = {f.name: f.analyzer for f in self.index.schema.fields}
        return parse(query, default, analyzers.get)

    def hits(self, query: Clause | str, default: str | None = None) -> DataFrame:
        """doc_id, score of every match."""
        clause = self.parse(query, default) if isinstance(query, str) else query
        if self.scope == "global":
            return Compiler(self.index, self.bm25).compile(clause)
        parts = [Compiler(self.index.only(s), self.bm25).compile(clause) for s in self.index.commit.segments]
        return reduce(DataFrame.unionByName, parts) if parts else Compiler(self.index, self.bm25).compile(clause)

    def search(self, query: Clause | str, n: int = 10, default: str | None = None, by_bounds: bool = False) -> DataFrame:
        """by_bounds: sums of terms leave out postings that can't matter, for one or two small jobs before the search."""
        if by_bounds and self.scope == "global":
            clause = self.parse(query, default) if isinstance(query, str) else query
            return collect.top_docs(maxscore.contenders(self.index, clause, n, self.bm25), n)
        return collect.top_docs(self.hits(query, default), n)

    def ids(self, query: Clause | str, default: str | None = None) -> DataFrame:
        return collect.doc_ids(self.hits(query, default))

    def count(self, query: Clause | str, default: str | None = None) -> int:
        return self.hits(query, default).count()

    def sorted_by(self, query: Clause | str, column: str, n: int | None = None, **how) -> DataFrame:
        return collect.by_field(self.hits(query), self.index.documents, column, n, **how)

    def collapsed(self, query: Clause | str, key: str, n: int = 10) -> DataFrame:
        return collect.collapse(self.hits(query), self.index.documents, key, n)

    def facets(self, query: Clause | str, column: str, n: int | None = None) -> DataFrame:
        out = facets.facet_counts(self.hits(query), self.index.documents, column)
        return out if n is None else facets.top_facets(out, n)

    def range_facets(self, query: Clause | str, column: str, ranges: Sequence[facets.NumericRange]) -> DataFrame:
        rows = self.index.documents.join(self.hits(query).select("doc_id"), "doc_id", "left_semi")
        return facets.range_facets(rows, column, ranges)

    def highlights(self, query: Clause | str, field: str, terms: Sequence[str], n: int = 10, config: highlight.FragmentConfig = highlight.FragmentConfig()) -> DataFrame:
        spec = next(f for f in self.index.schema.fields if f.name == field)
        return highlight.highlight(self.search(query, n), self.index.documents, self.index.postings, field, spec.source, terms, config)

    def explain(self, query: Clause | str, doc_id: int) -> Explanation:
        return Explainer(self.index, self.bm25).explain(self.parse(query) if isinstance(query, str) else query, doc_id)

    def nearest(self, query: Sequence[float], k: int, column: str, kind: str = "cosine") -> DataFrame:
        return vectors.nearest(self.index.documents, query, k, kind, column=column)

    def search_within(self, query: Clause | str, n: int, seconds: float) -> tuple[list, bool]:
        """(rows, whether time ran out): segment after segment; the best of those that were done in time."""
        spark, tag = self.index.spark, f"search-{uuid.uuid4().hex}"
        clause = self.parse(query) if isinstance(query, str) else query
        done: list = []
        late = threading.Event()

        def stop() -> None:
            late.set()
            spark.interruptTag(tag)

        timer = threading.Timer(seconds, stop)
        timer.start()
        spark.addTag(tag)
        try:
            for s in self.index.commit.segments:
                if late.is_set():
                    break
                done += Searcher(self.index.only(s), self.bm25).search(clause, n).collect()
        except Exception:
            if not late.is_set():
                raise
        finally:
            timer.cancel()
            spark.removeTag(tag)
        return sorted(done, key=lambda r: (-r["score"], r["doc_id"]))[:n], late.is_set()


class QueryCache:
    """The hits of the last `most` queries, persisted; least recently used go first. A failure is not kept."""

    def __init__(self, most: int = 100) -> None:
        self.most, self.kept = most, OrderedDict()

    def hits(self, searcher: Searcher, clause: Clause) -> DataFrame:
        key = (searcher.index.index.path, searcher.index.commit.generation, searcher.scope, searcher.bm25, clause)
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        out = searcher.hits(clause).persist()
        self.kept[key] = out
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)[1].unpersist()
        return out

    def remove(self, path: str, generation: int | None = None) -> None:
        """Drops what is kept of an index, or of one generation."""
        for key in [k for k in self.kept if k[0] == path and generation in (None, k[1])]:
            self.kept.pop(key).unpersist()

    def clear(self) -> None:
        while self.kept:
            self.kept.popitem()[1].unpersist()

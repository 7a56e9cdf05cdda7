"""Query clauses: a closed algebra of frozen dataclasses, and its rewrite."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any


class Clause:
    def boost(self, factor: float) -> Boost:
        return Boost(self, factor)

    def constant(self, score: float) -> ConstantScore:
        return ConstantScore(self, score)


@dataclass(frozen=True)
class Term(Clause):
    field: str
    term: str


@dataclass(frozen=True)
class TermInSet(Clause):
    field: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Prefix(Clause):
    field: str
    prefix: str


@dataclass(frozen=True)
class Wildcard(Clause):
    field: str
    pattern: str


@dataclass(frozen=True)
class Regexp(Clause):
    field: str
    pattern: str


@dataclass(frozen=True)
class Fuzzy(Clause):
    field: str
    term: str
    max_edits: int = 2
    prefix_length: int = 0
    transpositions: bool = True
    max_expansions: int = 50


@dataclass(frozen=True)
class Phrase(Clause):
    """slop 0: consecutive; else in order with at most slop positions between in all."""

    field: str
    terms: tuple[str, ...]
    slop: int = 0


@dataclass(frozen=True)
class SpanTerm(Clause):
    field: str
    term: str


@dataclass(frozen=True)
class SpanNear(Clause):
    clauses: tuple[Clause, ...]
    slop: int = 0
    in_order: bool = True


@dataclass(frozen=True)
class SpanOr(Clause):
    clauses: tuple[Clause, ...]


@dataclass(frozen=True)
class Range(Clause):
    """Inclusive bounds (None: open) on one column, or on several dimensions at once; any value of an array column."""

    columns: tuple[str, ...]
    low: tuple[Any, ...]
    high: tuple[Any, ...]
    selector: str | None = None  # "min" or "max": of an array column that value alone

    @classmethod
    def of(cls, column: str, low: Any, high: Any, selector: str | None = None) -> Range:
        return cls((column,), (low,), (high,), selector)


@dataclass(frozen=True)
class MatchAll(Clause):
    pass


@dataclass(frozen=True)
class MatchNone(Clause):
    reason: str = ""


@dataclass(frozen=True)
class Boolean(Clause):
    """All of must, none of must_not; without must, one of should. min_should counts clauses, duplicates too."""

    must: tuple[Clause, ...] = ()
    should: tuple[Clause, ...] = ()
    must_not: tuple[Clause, ...] = ()
    min_should: int = 0

    def with_must(self, *c: Clause) -> Boolean:
        return replace(self, must=self.must + c)

    def with_should(self, *c: Clause) -> Boolean:
        return replace(self, should=self.should + c)

    def with_must_not(self, *c: Clause) -> Boolean:
        return replace(self, must_not=self.must_not + c)


@dataclass(frozen=True)
class DisjunctionMax(Clause):
    clauses: tuple[Clause, ...]
    tie: float = 0.0


@dataclass(frozen=True)
class ConstantScore(Clause):
    inner: Clause
    score: float = 1.0


@dataclass(frozen=True)
class Boost(Clause):
    inner: Clause
    factor: float = 1.0


SPANS = (SpanTerm, SpanNear, SpanOr)


def children(c: Clause) -> Sequence[Clause]:
    if isinstance(c, Boolean):
        return (*c.must, *c.should, *c.must_not)
    if isinstance(c, (DisjunctionMax, SpanNear, SpanOr)):
        return c.clauses
    return (c.inner,) if isinstance(c, (ConstantScore, Boost)) else ()


def rewrite(c: Clause) -> Clause:
    """The same matches and scores with less nesting: single clauses unwrapped, must_not without repetitions."""
    if isinstance(c, Phrase) and len(c.terms) < 2:
        return Term(c.field, c.terms[0]) if c.terms else MatchNone("a phrase of no terms")
    if isinstance(c, DisjunctionMax):
        return replace(c, clauses=tuple(map(rewrite, c.clauses)))
    if isinstance(c, (ConstantScore, Boost)):
        return replace(c, inner=rewrite(c.inner))
    if not isinstance(c, Boolean):
        return c
    c = replace(c, must=tuple(map(rewrite, c.must)), should=tuple(map(rewrite, c.should)), must_not=tuple(dict.fromkeys(map(rewrite, c.must_not))))
    if not c.must_not:
        if len(c.must) == 1 and not c.should and c.min_should == 0:
            return c.must[0]
        if len(c.should) == 1 and not c.must and c.min_should <= 1:
            return c.should[0]
    return c


@dataclass(frozen=True)
class Explanation:
    matched: bool
    value: float
    description: str
    details: tuple[Explanation, ...] = field(default=())

    @classmethod
    def match(cls, value: float, description: str, *details: Explanation) -> Explanation:
        return cls(True, value, description, details)

    @classmethod
    def no_match(cls, description: str, *details: Explanation) -> Explanation:
        return cls(False, 0.0, description, details)

    def rows(self, depth: int = 0) -> list[tuple[int, bool, float, str]]:
        """The tree flattened: depth, matched, value, description."""
        return [(depth, self.matched, self.value, self.description), *(r for d in self.details for r in d.rows(depth + 1))]

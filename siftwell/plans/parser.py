"""The query-string language.

    +must -must_not optional field:word "a phrase" /regular expression/ prefix* wi?d*card fuzzy~1 (group) boost^2
    field:[1 TO 9] field:{1 TO *}

Words are analyzed, patterns are not. AND, OR and NOT are words.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from siftwell.functions.text import Analyzer
from siftwell.plans.query import Boolean, Boost, Clause, Fuzzy, MatchNone, Phrase, Prefix, Range, Regexp, Term, Wildcard

LOW, HIGH = -(1 << 63), (1 << 63) - 1


class ParseError(ValueError):
    """at: the letter of the query where reading failed."""

    def __init__(self, message: str, at: int) -> None:
        super().__init__(f"{message} at {at}")
        self.at = at


class EmptyQuery(ParseError): ...


class UnclosedQuote(ParseError): ...


class UnclosedRegexp(ParseError): ...


class UnclosedParen(ParseError): ...


class UnmatchedParen(ParseError): ...


class MissingField(ParseError): ...


class BadFuzziness(ParseError): ...


class BadBoost(ParseError): ...


class BadRange(ParseError): ...


class Unsupported(ParseError): ...


class UnexpectedEnd(ParseError): ...


class UnexpectedLetter(ParseError): ...


_FIELD = re.compile(r"([A-Za-z0-9_.-]+):")
_STOPS = frozenset(" \t\r\n()[]{}\"/^~:")
_RANGE = re.compile(r"([\[{])\s*(\S+?)\s+TO\s+([^\s\]}]+)\s*([\]}])")


class _Parser:
    def __init__(self, text: str, default: str | None, analyzer_of: Callable[[str], Analyzer | None]) -> None:
        self.text, self.default, self.analyzer_of, self.at = text, default, analyzer_of, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def blanks(self) -> None:
        while self.peek().isspace():
            self.at += 1

    def clauses(self, inside: bool) -> Clause:
        must: list[Clause] = []
        should: list[Clause] = []
        must_not: list[Clause] = []
        opened = self.at
        while True:
            self.blanks()
            c = self.peek()
            if not c:
                if inside:
                    raise UnclosedParen("unclosed parenthesis", opened)
                break
            if c == ")":
                if not inside:
                    raise UnmatchedParen("unmatched parenthesis", self.at)
                self.at += 1
                break
            into = must if c == "+" else must_not if c == "-" else should
            self.at += c in "+-"
            into.append(self.clause())
        if not (must or should or must_not):
            raise EmptyQuery("an empty query", opened)
        if len(should) == 1 and not must and not must_not:
            return should[0]
        return Boolean(tuple(must), tuple(should), tuple(must_not))

    def clause(self) -> Clause:
        if not self.peek() or self.peek().isspace():
            raise UnexpectedEnd("a clause is missing", self.at)
        if self.peek() == "(":
            self.at += 1
            out = self.clauses(True)
        else:
            out = self.term()
        if self.peek() == "^":
            m = re.compile(r"\^(\d+(?:\.\d*)?|\.\d+)(?=[\s)]|\Z)").match(self.text, self.at)
            if not m:
                raise BadBoost("a bad boost", self.at)
            self.at = m.end()
            out = Boost(out, float(m[1]))
        return out

    def term(self) -> Clause:
        start, field = self.at, self.default
        if m := _FIELD.match(self.text, self.at):
            field, self.at = m[1], m.end()
            if not self.peek() or self.peek().isspace():
                raise UnexpectedEnd("a term is missing", self.at)
        if field is None:
            raise MissingField("no field and no default field", start)
        c = self.peek()
        if c == '"':
            return self.words(field, self.quoted('"', UnclosedQuote))
        if c == "/":
            return Regexp(field, self.quoted("/", UnclosedRegexp))
        if c in "[{":
            return self.range(field)
        return self.word(field)

    def quoted(self, mark: str, error: type[ParseError]) -> str:
        start, out = self.at, []
        self.at += 1
        while (c := self.peek()) != mark:
            if not c:
                raise error(f"an unclosed {mark}", start)
            self.at += 1
            if c == "\\" and self.peek():
                # an escape of the mark is the mark; a regular expression keeps its other escapes
                c = self.peek() if mark == '"' or self.peek() == mark else c + self.peek()
                self.at += 1
            out.append(c)
        self.at += 1
        return "".join(out)

    def range(self, field: str) -> Clause:
        m = _RANGE.match(self.text, self.at)
        if not m:
            raise BadRange("a bad range", self.at)
        bounds = []
        for text, step, open_ in ((m[2], m[1] == "{", LOW), (m[3], -(m[4] == "}"), HIGH)):
            if text == "*":
                bounds.append(open_)
            elif re.fullmatch(r"[+-]?\d+", text) and LOW <= int(text) <= HIGH:
                bounds.append(max(LOW, min(HIGH, int(text) + step)))
            else:
                raise BadRange(f"a bad bound {text!r}", self.at)
        self.at = m.end()
        return Range.of(field, *bounds)

    def word(self, field: str) -> Clause:
        start, plain, raw, stars = self.at, [], [], []
        while (c := self.peek()) and c not in _STOPS:
            self.at += 1
            if c == "\\":
                if not self.peek():
                    raise UnexpectedEnd("an escape of nothing", self.at)
                raw.append(c + self.peek())
                plain.append(self.peek())
                self.at += 1
                continue
            if c in "*?":
                stars.append(len(plain))
            plain.append(c)
            raw.append(c)
        if not plain:
            raise UnexpectedLetter(f"unexpected {c!r}", start)
        text = "".join(plain)
        if self.peek() == "~":
            m = re.compile(r"~(\d*)").match(self.text, self.at)
            self.at = m.end()
            if self.peek() == "." or (m[1] and int(m[1]) > 2):
                raise BadFuzziness("edits must be 0, 1 or 2", start)
            if stars:
                raise Unsupported("fuzziness of a pattern", start)
            return Fuzzy(field, text, int(m[1]) if m[1] else 2)
        if self.peek() and self.peek() not in "^)" and not self.peek().isspace():
            raise UnexpectedLetter(f"unexpected {self.peek()!r}", self.at)
        if stars == [len(plain) - 1] and plain[-1] == "*":
            return Prefix(field, text[:-1])
        if stars:
            return Wildcard(field, "".join(raw))
        return self.words(field, text)

    def words(self, field: str, text: str) -> Clause:
        analyzer = self.analyzer_of(field)
        if analyzer is None:
            return Phrase(field, tuple(text.split())) if len(text.split()) > 1 else Term(field, text)
        terms = tuple(t.term for t in analyzer.analyze(text))
        if not terms:
            return MatchNone("no terms after analysis")
        return Term(field, terms[0]) if len(terms) == 1 else Phrase(field, terms)


def parse(text: str, default: str | None = None, analyzer: Analyzer | Callable[[str], Analyzer | None] | None = None) -> Clause:
    """The clause of a query string. default: the field of words that name none; analyzer: for all fields or by field."""
    of = analyzer if callable(analyzer) else lambda _: analyzer
    return _Parser(text, default, of).clauses(False)

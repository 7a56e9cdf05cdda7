"""Patterns over terms: globs and regular expressions translated for rlike(), and edit distances."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

_META = set(r"\.+*?()[]{}|^$-&~#")


class PatternError(ValueError):
    """A regular expression outside the supported syntax."""


def quote(text: str) -> str:
    return "".join("\\" + c if c in _META else c for c in text)


def _whole(body: str) -> str:
    return rf"\A(?s:{body})\z"


def glob(pattern: str) -> tuple[str, str]:
    """A whole-term expression for * (any letters), ? (one) and \\ (the next letter itself), and the literal prefix."""
    body, prefix, literal, k = [], [], True, 0
    while k < len(pattern):
        c = pattern[k]
        if c in "*?":
            body.append(".*" if c == "*" else ".")
            literal = False
        else:
            if c == "\\" and k + 1 < len(pattern):
                k += 1
                c = pattern[k]
            body.append(quote(c))
            prefix += [c] * literal
        k += 1
    return _whole("".join(body)), "".join(prefix)


class _Reader:
    """A recursive-descent reader of: alternation, sequence, * + ? {n} {n,} {n,m}, classes, groups, dot, \\ escapes."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def next(self) -> str:
        if not (c := self.peek()):
            raise PatternError("unexpected end")
        self.at += 1
        return c

    def alternation(self) -> str:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return "|".join(parts)

    def sequence(self) -> str:
        out = []
        while self.peek() and self.peek() not in "|)":
            out.append(self.repeated())
        return "".join(out)

    def repeated(self) -> str:
        atom = self.atom()
        while (c := self.peek()) and c in "*+?{":
            if c == "{":
                m = re.compile(r"\{(\d+)(?:(,)(\d*))?\}").match(self.text, self.at)
                if not m or (m[3] and int(m[3]) < int(m[1])):
                    raise PatternError(f"bad repetition at {self.at}")
                self.at = m.end()
                atom = f"(?:{atom}){m[0]}"
            else:
                self.at += 1
                atom = f"(?:{atom}){c}"
        return atom

    def atom(self) -> str:
        c = self.next()
        if c == "(":
            inner = self.alternation()
            if self.peek() != ")":
                raise PatternError("unclosed group")
            self.at += 1
            return f"(?:{inner})"
        if c == "[":
            return self.klass()
        if c in "*+?{":
            raise PatternError(f"nothing to repeat at {self.at - 1}")
        if c == ".":
            return "."
        return quote(self.next() if c == "\\" else c)

    def klass(self) -> str:
        negated = self.peek() == "^"
        self.at += negated
        items = []
        while self.peek() != "]" or not items:
            c = self.next()
            if c == "]":
                raise PatternError("empty class")
            c = self.next() if c == "\\" else c
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                d = self.next()
                d = self.next() if d == "\\" else d
                if d < c:
                    raise PatternError(f"bad range {c}-{d}")
                items.append(f"{quote(c)}-{quote(d)}")
            else:
                items.append(quote(c))
        self.at += 1
        return f"[{'^' if negated else ''}{''.join(items)}]"


def regexp(pattern: str) -> tuple[str, str]:
    """A whole-term expression for a checked pattern, and its literal prefix."""
    r = _Reader(pattern)
    body = r.alternation()
    if r.at < len(pattern):
        raise PatternError(f"unexpected {pattern[r.at]!r} at {r.at}")
    m = re.match(r"[A-Za-z0-9_ ]*", pattern)[0]
    if "|" in pattern:
        m = ""
    elif len(m) < len(pattern) and pattern[len(m)] in "*?{":
        m = m[:-1]
    return _whole(body), m


def osa(a: str, b: str, transpositions: bool = True) -> int:
    """Edit distance in letters; a swap of neighbours counts once with transpositions (and neither is edited again)."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if transpositions and i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1]


def osa_udf(target: str):
    """The distance of each term of a column to target; meant for distinct terms of about its length."""

    @F.pandas_udf(IntegerType())
    def distance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: osa(t, target)).astype("int32")

    return distance

import pytest
from hypothesis import given
from hypothesis import strategies as st

from siftwell.functions.text import ENGLISH_STOP_WORDS, Analyzer
from siftwell.plans import parser as p
from siftwell.plans.query import Boolean, Boost, Fuzzy, MatchNone, Phrase, Prefix, Range, Regexp, Term, Wildcard

A = Analyzer.standard(ENGLISH_STOP_WORDS)


def b(x):
    return Term("body", x)


GOOD = {
    "cat": b("cat"), "Cat": b("cat"), "+cat -dog bird": Boolean((b("cat"),), (b("bird"),), (b("dog"),)), "+cat": Boolean((b("cat"),)), "-cat": Boolean((), (), (b("cat"),)),
    "(cat dog)^2.5": Boost(Boolean((), (b("cat"), b("dog"))), 2.5), "((cat))": b("cat"), "title:cat^3": Boost(Term("title", "cat"), 3.0), 'title:"Red Fox"': Phrase("title", ("red", "fox")),
    '"the"': MatchNone("no terms after analysis"), '"one"': b("one"), '"red of fox"': Phrase("body", ("red", "fox")), "cat*": Prefix("body", "cat"), "*": Prefix("body", ""), "c?t*": Wildcard("body", "c?t*"), "c\\*t?": Wildcard("body", "c\\*t?"),
    "/ca[tb]+/": Regexp("body", "ca[tb]+"), "/a\\/b\\./": Regexp("body", "a/b\\."), "cat~": Fuzzy("body", "cat", 2), "cat~1": Fuzzy("body", "cat", 1), "cat~0^2": Boost(Fuzzy("body", "cat", 0), 2.0), "n:[1 TO 5]": Range.of("n", 1, 5), "n:{1 TO 5}": Range.of("n", 2, 4), "n:[* TO 5}": Range.of("n", p.LOW, 4), "n:{1 TO *]": Range.of("n", 2, p.HIGH),
    "cat AND dog": Boolean((), (b("cat"), MatchNone("no terms after analysis"), b("dog"))), "NOT": MatchNone("no terms after analysis"), "wi-fi": Phrase("body", ("wi", "fi")),
}


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    assert p.parse(text, "body", A) == GOOD[text]


BAD = {"": p.EmptyQuery, "  ": p.EmptyQuery, "()": p.EmptyQuery, '"a': p.UnclosedQuote, "/a": p.UnclosedRegexp, "(a": p.UnclosedParen, "a)": p.UnmatchedParen, "a~3": p.BadFuzziness, "a~0.5": p.BadFuzziness, "a*~1": p.Unsupported, "a^x": p.BadBoost, "n:[1 5]": p.BadRange, "n:[a TO b]": p.BadRange, '"a b"~2': p.UnexpectedLetter, "+": p.UnexpectedEnd, "f: a": p.UnexpectedEnd, "a\\": p.UnexpectedEnd}


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    with pytest.raises(BAD[text]):
        p.parse(text, "body", A)


def test_no_default_field():
    with pytest.raises(p.MissingField):
        p.parse("cat")
    assert p.parse("f:cat") == Term("f", "cat")


@given(st.text(alphabet='ab+-()":^~*?/\\[]{} 1TO', max_size=20))
def test_any_text_is_a_clause_or_a_parse_error(text):
    try:
        p.parse(text, "body", A)
    except p.ParseError as e:
        assert 0 <= e.at <= len(text)

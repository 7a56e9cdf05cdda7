"""Text analysis: tokens, filters and analyzers. Offsets are in code points."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import regex

from siftwell.functions.stemmers import porter, porter2

# The default English and French stop words.
ENGLISH_STOP_WORDS = frozenset(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)
FRENCH_STOP_WORDS = frozenset(
    """au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous
    on ou par pas pour qu que qui sa se ses sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y
    étée étées étant suis es êtes sont serai seras sera serons serez seront serais serait serions seriez seraient
    étais était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient
    fusse fusses fussions fussiez fussent ayant eu eue eues eus ai avons avez ont
    aurai aurons aurez auront aurais aurait aurions auriez auraient avais avait aviez avaient
    eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent
    ceci cela celà cet cette ici ils les leurs quel quels quelle quelles sans soi""".split()
)
# Letters that ASCII folding changes, and what they become.
FOLDED = {
    "A": "ÀÁÂÃÄÅĄ", "AE": "Æ", "C": "ÇĆČ", "D": "ÐĎ", "E": "ÈÉÊËĘ", "I": "ÌÍÎÏ", "L": "Ł", "N": "ÑŃŇ", "O": "ÒÓÔÕÖØ", "OE": "Œ",
    "S": "ŚŠ", "T": "Ť", "TH": "Þ", "U": "ÙÚÛÜ", "Y": "Ý", "Z": "ŹŽŻ",
    "a": "àáâãäåą", "ae": "æ", "c": "çćč", "d": "ðď", "e": "èéêëę", "i": "ìíîï", "l": "ł", "n": "ñńň", "o": "òóôõöø", "oe": "œ",
    "s": "śš", "ss": "ß", "t": "ť", "th": "þ", "u": "ùúûü", "y": "ýÿ", "z": "źžż",
}
_FOLD = str.maketrans({c: to for to, letters in FOLDED.items() for c in letters})


@dataclass(frozen=True)
class Token:
    term: str
    start: int
    end: int
    pos_inc: int = 1
    pos_len: int = 1


_BOUNDARY = regex.compile(r"(?w)\b")
_SIMPLE = regex.compile(r"[\p{L}\p{N}]+")


def tokenize(text: str) -> list[Token]:
    """Words by the Unicode segmentation rules that hold a letter or a digit."""
    cuts = sorted({0, len(text), *(m.start() for m in _BOUNDARY.finditer(text))})
    return [Token(text[a:b], a, b) for a, b in zip(cuts, cuts[1:], strict=False) if any(map(str.isalnum, text[a:b]))]


def tokenize_simple(text: str) -> list[Token]:
    """Runs of letters and digits: the fast tokenizer, which SQL can follow as `[\\p{L}\\p{N}]+`."""
    return [Token(m[0], *m.span()) for m in _SIMPLE.finditer(text)]


def fold(tokens: Iterable[Token]) -> list[Token]:
    return [t if t.term.isascii() else replace(t, term=t.term.translate(_FOLD)) for t in tokens]


def lowercase(tokens: Iterable[Token]) -> list[Token]:
    return [replace(t, term=t.term.lower()) for t in tokens]


def stop(tokens: Iterable[Token], words: frozenset[str]) -> list[Token]:
    """Without words; the next token that stays takes over the gap."""
    out, gap = [], 0
    for t in tokens:
        if t.term in words:
            gap += t.pos_inc
        else:
            out.append(replace(t, pos_inc=t.pos_inc + gap))
            gap = 0
    return out


@lru_cache(maxsize=200_000)
def _stem(term: str, english2: bool) -> str:
    return porter2(term) if english2 else porter(term)


def stem(tokens: Iterable[Token], english2: bool = False) -> list[Token]:
    return [replace(t, term=_stem(t.term, english2)) for t in tokens]


def synonyms(tokens: Iterable[Token], table: Mapping[str, Sequence[str]]) -> list[Token]:
    """Each synonym stands at its token's place, after it."""
    return [x for t in tokens for x in (t, *(replace(t, term=s, pos_inc=0) for s in table.get(t.term, ())))]


def both_ways(table: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The table with each pair reversed besides, once each; no further closure."""
    out: dict[str, list[str]] = {}
    pairs = [(a, b) for a, bs in table.items() for b in bs]
    for a, b in [*pairs, *((b, a) for a, b in pairs)]:
        if b not in out.setdefault(a, []):
            out[a].append(b)
    return out


@dataclass(frozen=True)
class SynonymRule:
    phrase: tuple[str, ...]
    outputs: tuple[tuple[str, ...], ...]


def multiword_synonyms(tokens: Sequence[Token], rules: Sequence[SynonymRule]) -> list[Token]:
    """At each place the longest phrase that fits; its tokens stay, its outputs are added.

    A single word spans the phrase (pos_len); the words of a longer output stand over the phrase's places in turn, the
    last one over those that are left.
    """
    out, k = [], 0
    while k < len(tokens):
        fits = [r for r in rules if r.phrase and tuple(t.term for t in tokens[k : k + len(r.phrase)]) == r.phrase]
        if not fits:
            out.append(tokens[k])
            k += 1
            continue
        n = max(len(r.phrase) for r in fits)
        whole = tokens[k : k + n]
        start, end = whole[0].start, whole[-1].end
        added: list[list[Token]] = [[] for _ in whole]
        for r in (r for r in fits if len(r.phrase) == n):
            for words in r.outputs:
                for w, word in enumerate(words):
                    last = w == len(words) - 1
                    added[min(w, n - 1)].append(Token(word, start, end, 0, max(1, n - w) if last else 1))
        for t, more in zip(whole, added, strict=True):
            out += [t, *more]
        k += n
    return out


def ngrams(tokens: Iterable[Token], least: int, most: int, edge: bool = False) -> list[Token]:
    """Grams of least..most letters by start, then length (edge: prefixes only); the first keeps its token's step."""
    if least < 1 or most < least:
        raise ValueError(f"bad gram sizes {least}..{most}")
    out = []
    for t in tokens:
        spans = [(s, s + n) for s in range(1 if edge else len(t.term)) for n in range(least, most + 1) if s + n <= len(t.term)]
        out += [Token(t.term[a:b], t.start + a, t.start + b, t.pos_inc if k == 0 else 0) for k, (a, b) in enumerate(spans)]
    return out


@dataclass(frozen=True)
class Analyzer:
    """Tokenize, fold, lower-case, stop, stem, synonyms: always in this order. keyword: the text itself, even if empty."""

    tokenizer: str = "standard"  # or "simple", "keyword"
    folds: bool = False
    lowers: bool = True
    stops: frozenset[str] = frozenset()
    stemmer: str | None = None  # "porter", "english"
    synonym_pairs: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @classmethod
    def standard(cls, stops: frozenset[str] = frozenset()) -> Analyzer:
        return cls(stops=stops)

    @classmethod
    def simple(cls) -> Analyzer:
        return cls(tokenizer="simple")

    @classmethod
    def keyword(cls) -> Analyzer:
        return cls(tokenizer="keyword", lowers=False)

    def with_folding(self) -> Analyzer:
        return replace(self, folds=True)

    def with_stemming(self, stemmer: str = "porter") -> Analyzer:
        return replace(self, stemmer=stemmer)

    def with_synonyms(self, table: Mapping[str, Sequence[str]], bidirectional: bool = False) -> Analyzer:
        table = both_ways(table) if bidirectional else table
        return replace(self, synonym_pairs=tuple((k, tuple(v)) for k, v in table.items()))

    @property
    def plain(self) -> bool:
        """Whether tokens are the words as they stand, but for their case: each a step of one."""
        return self.tokenizer == "simple" and not (self.folds or self.stops or self.stemmer or self.synonym_pairs)

    def words(self, text: str) -> Iterator[tuple[str, int, int, int]]:
        """term, step, start, end of each token."""
        if self.plain:
            for m in _SIMPLE.finditer(text):
                yield m[0].lower() if self.lowers else m[0], 1, m.start(), m.end()
        else:
            for t in self.analyze(text):
                yield t.term, t.pos_inc, t.start, t.end

    def analyze(self, text: str) -> list[Token]:
        if self.tokenizer == "keyword":
            return [Token(text, 0, len(text))]
        return self.filtered(tokenize(text) if self.tokenizer == "standard" else tokenize_simple(text))

    def filtered(self, tokens: list[Token]) -> list[Token]:
        """What the filters make of tokens. But for the steps, each token's outcome is its own."""
        if self.tokenizer == "keyword":
            return tokens
        if self.folds:
            tokens = fold(tokens)
        if self.lowers:
            tokens = lowercase(tokens)
        if self.stops:
            tokens = stop(tokens, self.stops)
        if self.stemmer:
            tokens = stem(tokens, self.stemmer == "english")
        if self.synonym_pairs:
            tokens = synonyms(tokens, dict(self.synonym_pairs))
        return tokens

"""The tokens of many texts at once, as arrays: texts are cut by numpy, and each distinct word is analyzed once.

The filters of an analyzer look at one token at a time; only the step from token to token depends on its neighbours, and
that is counted here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftwell.functions.text import _SIMPLE, Token, tokenize

Change = Callable[[list[Token]], list[Token]]

#: Bytes of text that are analyzed at once; a longer text stands alone.
SLICE = 4 << 20
#: Words and runs whose analysis a task remembers.
REMEMBERED = 200_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether the simple tokenizer keeps it."""
    codes = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    out = np.zeros(0x110000, bool)
    for m in _SIMPLE.finditer("".join(map(chr, codes.tolist()))):
        out[codes[m.start() : m.end()]] = True
    return out


@lru_cache(maxsize=1)
def _openers() -> np.ndarray:
    """For each code point, whether a word boundary before it is certain after a space or a line's end: no space, and none that extends what it follows."""
    out = np.zeros(0x110000, bool)
    out[0x21:0x7F] = True
    out[0xC0:0x250] = True
    return out


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.Table]:
    """The rows of batches in their order, in tables of about `size` bytes."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        rows = max(1, b.num_rows * size // max(1, b.nbytes))
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            for piece in _halves(part, size):
                held.append(piece)
                total += piece.nbytes
                if total >= size:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _halves(b: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    if b.num_rows > 1 and b.nbytes > 2 * size:
        yield from _halves(b.slice(0, b.num_rows // 2), size)
        yield from _halves(b.slice(b.num_rows // 2), size)
    else:
        yield b


def column(table: pa.Table, k: int) -> pa.Array:
    """A column of a table of slices() as one array."""
    c = table.column(k)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


@dataclass
class Texts:
    """Texts without null, as bytes and code points."""

    data: np.ndarray
    codes: np.ndarray
    byte_at: np.ndarray | None  # the byte of each code point, or None: each is one byte
    first: np.ndarray  # the code point where each text starts, and the end

    @classmethod
    def of(cls, texts: pa.Array) -> Texts:
        texts = texts.cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        if not len(data) or data.max() < 0x80:
            return cls(data, data, None, at)
        byte_at = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        return cls(data, codes, byte_at, np.searchsorted(byte_at, at))

    def bytes_at(self, points: np.ndarray) -> np.ndarray:
        return points if self.byte_at is None else np.append(self.byte_at, len(self.data))[points]

    def text_of(self, points: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, points, side="right") - 1

    def runs(self, kept: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """First code points, ends and strings of the runs of kept code points; a run begins anew where opens says so."""
        before, after = np.zeros(len(kept), bool), np.zeros(len(kept), bool)
        before[1:] = kept[:-1] & ~opens[1:]
        after[:-1] = kept[1:] & ~opens[1:]
        start, end = np.flatnonzero(kept & ~before), np.flatnonzero(kept & ~after) + 1
        at = np.zeros(len(start) + 1, np.int64)
        np.cumsum(self.bytes_at(end) - self.bytes_at(start), out=at[1:])
        mask = kept if self.byte_at is None else np.repeat(kept, np.diff(self.byte_at, append=len(self.data)))
        strings = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(self.data[mask]))
        return start, end, strings

    def heads(self) -> np.ndarray:
        """For each code point, whether a text starts there."""
        out = np.zeros(len(self.codes), bool)
        out[self.first[:-1][self.first[:-1] < len(out)]] = True
        return out


def _coded(strings: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


@dataclass
class Tokens:
    """One entry a token, in the order of the texts: its text, the number of its term, step, start and end."""

    terms: list[str]
    text: np.ndarray
    term: np.ndarray
    step: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lengths: np.ndarray  # of the texts, in code points

    def strings(self) -> pa.Array:
        return pa.array(self.terms, pa.string()).take(pa.array(self.term))


class Batches:
    """An analyzer for arrays of texts: a tokenizer, and what becomes of a single token."""

    def __init__(self, tokenizer: str, change: Change) -> None:
        self.tokenizer, self.change = tokenizer, change
        self._changed: dict[str, tuple[str, ...]] = {}
        self._cut: dict[str, list[Token]] = {}

    def _outputs(self, words: list[str]) -> list[tuple[str, ...]]:
        """What becomes of each word; none if it is dropped."""
        known, out = self._changed, []
        for w in words:
            x = known.get(w)
            if x is None:
                x = tuple(t.term for t in self.change([Token(w, 0, len(w))]))
                if len(known) < REMEMBERED:
                    known[w] = x
            out.append(x)
        return out

    def _standard(self, x: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Cut where a boundary is certain; a distinct run is segmented once."""
        opens = x.heads()
        if len(opens):
            space = (x.codes == 0x20) | (x.codes == 0x0A)
            opens[1:] |= space[:-1] & _openers()[x.codes[1:]]
        start, _, strings = x.runs(np.ones(len(x.codes), bool), opens)
        run, runs = _coded(strings)
        numbers: dict[str, int] = {}
        firsts, ids, at, ends = np.zeros(len(runs) + 1, np.int64), [], [], []
        for k, text in enumerate(runs):
            found = self._cut.get(text)
            if found is None:
                word = text.rstrip(" \n")
                found = [Token(word, 0, len(word))] if word.isascii() and word.isalnum() else tokenize(text)
                if len(self._cut) < REMEMBERED:
                    self._cut[text] = found
            for t in found:
                ids.append(numbers.setdefault(t.term, len(numbers)))
                at.append(t.start)
                ends.append(t.end)
            firsts[k + 1] = len(ids)
        row, of = _spread(firsts, run)
        ids, at, ends = (np.array(v, np.int64) for v in (ids, at, ends))
        return start[row] + at[of], start[row] + ends[of], ids[of], list(numbers)

    def _raw(self, texts: pa.Array, x: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Text, start, end, word of each token before the filters, and the words."""
        if self.tokenizer == "keyword":
            word, words = _coded(texts)
            return np.arange(len(word)), x.first[:-1], x.first[1:], word, words
        if self.tokenizer == "standard":
            start, end, word, words = self._standard(x)
        else:
            start, end, strings = x.runs(_letters()[x.codes], x.heads())
            word, words = _coded(strings)
        return x.text_of(start), start, end, word, words

    def tokens(self, texts: pa.Array) -> Tokens:
        x = Texts.of(texts)
        text, start, end, word, words = self._raw(texts, x)
        outputs = self._outputs(words)
        numbers: dict[str, int] = {}
        flat = np.array([numbers.setdefault(t, len(numbers)) for out in outputs for t in out], np.int64)
        firsts = np.zeros(len(outputs) + 1, np.int64)
        np.cumsum([len(o) for o in outputs], out=firsts[1:])
        row, of = _spread(firsts, word)
        fresh = np.ones(len(row), bool)  # the first output of its word
        fresh[1:] = row[1:] != row[:-1]
        step = np.zeros(len(row), np.int64)
        lead = row[fresh]
        # words since the one kept before, in the same text
        gap = np.diff(lead, prepend=-1)
        head = np.ones(len(lead), bool)
        head[1:] = text[lead[1:]] != text[lead[:-1]]
        gap[head] = lead[head] - np.searchsorted(text, text[lead[head]]) + 1
        step[fresh] = gap
        at = x.first[text[row]]
        return Tokens(list(numbers), text[row], flat[of], step, start[row] - at, end[row] - at, np.diff(x.first))

    def words(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The distinct words of the texts before the filters, and how often each stands there."""
        *_, word, words = self._raw(texts, Texts.of(texts))
        return words, np.bincount(word, minlength=len(words))

    def counts(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Terms, and how often each stands in the texts; a term may come twice."""
        return self.changed(*self.words(texts))

    def changed(self, words: list[str], n: np.ndarray) -> tuple[list[str], np.ndarray]:
        """What becomes of words that stand n times each."""
        outputs = self._outputs(words)
        return [t for out in outputs for t in out], np.repeat(n, [len(o) for o in outputs])


def _spread(firsts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with a key whose entries are firsts[key]..firsts[key + 1]: row and entry of each, in order."""
    n = firsts[keys + 1] - firsts[keys]
    if len(n) and n.min() == 1 == n.max():
        return np.arange(len(keys)), firsts[keys]
    row = np.repeat(np.arange(len(keys)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + firsts[keys[row]]


def without_nulls(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts that aren't null, and their rows."""
    there = pc.is_valid(texts)
    return texts.filter(there), np.flatnonzero(there.to_numpy(zero_copy_only=False))

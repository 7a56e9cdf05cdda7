"""Whole columns of text cut into a tokenizer's pieces with numpy, and a table from pieces to token ids.

Texts are joined (a lone surrogate, which no valid text holds, stands between them) and become one array of code points;
classes of characters come from a table that the tokenizer library's own expressions fill, so both agree on every
character. Piece boundaries, hashes and ids are then array operations; Python runs once for each new piece only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np

OTHER, LETTER, NUMBER, SPACE, STOP, SPECIAL = range(6)
#: Ends a text; the special token k of the tokenizer stands as FIRST_SPECIAL + k.
END, FIRST_SPECIAL = 0xD800, 0xDC00
#: Code points in one go; longer texts are cut where a space stands between ASCII letters, as all patterns here do.
CHUNK = 1 << 19
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def character_classes() -> bytes:
    """One byte for each code point, from the tokenizer library's expressions."""
    from tokenizers import Regex, normalizers

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    out = np.zeros(0x110000, np.uint8)
    text = "".join(map(chr, points))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        got = np.frombuffer(normalizers.Replace(Regex(pattern), "\x00").normalize_str(text).encode("utf-32-le"), "<u4")
        out[points[got != points]] = kind
    out[0xD800:0xE000] = STOP
    out[FIRST_SPECIAL : FIRST_SPECIAL + 256] = SPECIAL
    return out.tobytes()


def chunks(texts: Sequence[str]) -> Iterator[tuple[list[int], str]]:
    """(row of each part, parts joined, each ended by END), of about CHUNK code points; a longer text is cut."""
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > CHUNK and (m := _CUT.search(text, at + CHUNK - 1)):
                end = m.start()
            rows.append(row)
            parts.append(text[at:end])
            held += end - at
            if held >= CHUNK:
                yield rows, chr(END).join([*parts, ""])
                rows, parts, held = [], [], 0
            at = end
            if at >= len(text):
                break
    if parts:
        yield rows, chr(END).join([*parts, ""])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _runs(cp: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags of where runs of one class start; the runs' starts and ends. Stops and specials are runs of one."""
    flag = np.empty(len(cp), bool)
    flag[:1] = True
    np.not_equal(cls[1:], cls[:-1], out=flag[1:])
    flag |= cls >= STOP
    starts = np.flatnonzero(flag)
    return flag, starts, np.append(starts[1:], len(cp))


def _contractions(cp: np.ndarray, cls: np.ndarray, flag: np.ndarray, starts: np.ndarray, ends: np.ndarray, free: np.ndarray) -> None:
    """'s 't 'm 'd 're 've 'll become pieces where an apostrophe on its own begins a piece (free); sets flag."""
    at = np.flatnonzero((cp[starts] == 0x27) & (ends - starts == 1) & free)
    at = at[at + 1 < len(starts)]
    at = at[cls[starts[at + 1]] == LETTER]
    for k in at:  # few
        p, end = int(starts[k]), int(ends[k + 1])
        word = "".join(map(chr, cp[p + 1 : min(p + 3, end)]))
        n = 1 if word[:1] in ("s", "t", "m", "d") else 2 if word in ("re", "ve", "ll") else 0
        if n:
            flag[p + 1] = False
            if p + 1 + n < end:
                flag[p + 1 + n] = True


def byte_level_pieces(cp: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of the byte-level pattern: a space goes with the run that follows it."""
    flag, starts, ends = _runs(cp, cls)
    kind = cls[starts]
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (kind[:-1] == SPACE) & (kind[1:] < SPACE)
    last = ends[follows] - 1
    flag[last] = True
    joined = cp[last] == 0x20
    flag[last[joined] + 1] = False
    free = np.ones(len(starts), bool)
    free[1:] = ~(follows[:-1] & (cp[starts[1:] - 1] == 0x20))
    _contractions(cp, cls, flag, starts, ends, free)
    return _between(flag, cls)


def word_pieces(cp: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters, single numbers and runs of other characters; white space is dropped."""
    flag, starts, ends = _runs(cp, cls)
    _contractions(cp, cls, flag, starts, ends, np.ones(len(starts), bool))
    flag |= cls == NUMBER
    s, e = _between(flag, cls)
    keep = cls[s] != SPACE
    return s[keep], e[keep]


def _between(flag: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(flag)
    ends = np.append(starts[1:], len(cls))
    keep = cls[starts] != STOP
    return starts[keep], ends[keep]


def spans_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start .. start + length - 1 of all spans, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class PieceTable:
    """From pieces (spans of code points) to arrays of token ids; at most `most` pieces, then it starts anew."""

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], most: int = 600_000) -> None:
        self.encode, self.most = encode, most
        self.up = self.down = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.n, self.bits = 0, 21
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.hash = np.zeros(1 << 16, np.uint64)
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.id_start, self.id_length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.chars, self.n_chars = np.zeros(1 << 18, np.uint32), 0
        self.ids, self.n_ids = np.zeros(1 << 18, np.int32), 0

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", _INVERSE)):
                    a = np.full(n, base, np.uint64)
                    a[0] = 1
                    setattr(self, name, np.multiply.accumulate(a))

    def hashes(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(cp) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * self.up[: len(cp)], out=total[1:])
            h = (total[ends] - total[starts]) * self.down[starts]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(open_):
            e = self.slot[at[open_]]
            same = (e >= 0) & (self.hash[e] == h[open_])
            out[open_[same]] = e[same]
            open_ = open_[(e >= 0) & ~same]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def _grow(self, name: str, n: int) -> None:
        a = getattr(self, name)
        if len(a) < n:
            b = np.zeros(max(n, 2 * len(a)), a.dtype)
            b[: len(a)] = a
            setattr(self, name, b)

    def add(self, pieces: list[str], h: np.ndarray | None) -> np.ndarray:
        """Entries for new pieces; without h they can't be found again."""
        ids = self.encode(pieces)
        new = np.arange(self.n, self.n + len(pieces))
        chars = np.concatenate([code_points(p) for p in pieces])
        length, n_ids = np.array([len(p) for p in pieces]), np.array([len(i) for i in ids])
        end = self.n + len(pieces)
        for name in ("hash", "start", "length", "id_start", "id_length"):
            self._grow(name, end)
        self._grow("chars", self.n_chars + len(chars))
        self._grow("ids", self.n_ids + int(n_ids.sum()))
        self.chars[self.n_chars : self.n_chars + len(chars)] = chars
        self.ids[self.n_ids : self.n_ids + int(n_ids.sum())] = np.fromiter((i for x in ids for i in x), np.int32, int(n_ids.sum()))
        self.start[new], self.length[new] = self.n_chars + np.cumsum(length) - length, length
        self.id_start[new], self.id_length[new] = self.n_ids + np.cumsum(n_ids) - n_ids, n_ids
        self.n, self.n_chars, self.n_ids = end, self.n_chars + len(chars), self.n_ids + int(n_ids.sum())
        if h is not None:
            self.hash[new] = h
            self._place(new)
        return new

    def _place(self, entries: np.ndarray) -> None:
        if 2 * self.n > len(self.slot):
            self.bits += 1
            self.slot = np.full(1 << self.bits, -1, np.int32)
            entries = np.arange(self.n)
        at = (self.hash[entries] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(entries):
            free = self.slot[at] < 0
            _, first = np.unique(at[free], return_index=True)
            winner = np.flatnonzero(free)[first]
            self.slot[at[winner]] = entries[winner]
            left = np.ones(len(entries), bool)
            left[winner] = False
            entries, at = entries[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def lookup(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each piece; each is compared with the entry's own characters, so hashes decide nothing."""
        if self.n > self.most:
            self.clear()
        h = self.hashes(cp, starts, ends)
        entry = self.find(h)
        if len(new := np.flatnonzero(entry < 0)):
            _, first = np.unique(h[new], return_index=True)
            chosen = new[first]
            self.add([self._text(cp, starts[i], ends[i]) for i in chosen], h[chosen])
            entry[new] = self.find(h[new])
        length = ends - starts
        wrong = self.length[entry] != length
        if not wrong.any():
            differs = self.chars[spans_index(self.start[entry], length)] != cp[spans_index(starts, length)]
            if differs.any():
                wrong[np.repeat(np.arange(len(entry)), length)[differs]] = True
        elif len(ok := np.flatnonzero(~wrong)):
            differs = self.chars[spans_index(self.start[entry[ok]], length[ok])] != cp[spans_index(starts[ok], length[ok])]
            wrong[np.repeat(ok, length[ok])[differs]] = True
        if len(bad := np.flatnonzero(wrong)):
            entry[bad] = self.add([self._text(cp, starts[i], ends[i]) for i in bad], None)
        return entry

    @staticmethod
    def _text(cp: np.ndarray, start: int, end: int) -> str:
        return cp[start:end].tobytes().decode("utf-32-le", "surrogatepass")

    def ids_of(self, entry: np.ndarray) -> np.ndarray:
        return self.ids[spans_index(self.id_start[entry], self.id_length[entry])]

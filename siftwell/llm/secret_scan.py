"""Secret scans: keywords, then anchored expressions, then embedded checksums.

One Aho-Corasick automaton over the keywords of all kinds passes each whole text; the expression of a kind runs only at
the places where one of its keywords begins (where the expression could match at all, so nothing is lost). Kinds that
embed a checksum count only if it is right. Hexadecimal strings have no keyword; every eighth byte is looked at, a
string of 32 shows four hexadecimal bytes in a row there, and only around such hits the text itself is read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm._common import lean, table

KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
BASE = KINDS[:3]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_TOKEN36 = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
_XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
_HEX, _HEX4 = re.compile(rb"[0-9a-f]+"), re.compile(rb"[0-9a-f]{4,}")
_HEX_BYTES = frozenset(b"0123456789abcdef")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
}
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
Span = tuple[str, int, int]


def crc_of(body: str) -> str:
    """The last six letters of a token whose first thirty are body: its CRC-32 in base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = _B62[k] + out
    return out


def check58(text: str) -> bool:
    """Whether the last four of the bytes that text gives in base 58 are their checksum."""
    n = 0
    for c in text:
        n = 58 * n + _B58.index(c)
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return len(raw) == 82 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def _anchored(kind: str, text: str, at: int) -> tuple[int, bool]:
    """The end of what kind's expression matches at this place (0: nothing), and whether it passes."""
    if kind == "assign":
        return (m.end(), len(m[2]) >= 8) if (m := _ASSIGN.match(text, at)) else (0, False)
    if kind == "access":
        return (m.end(), m.end() - at >= 16) if (m := _ACCESS.match(text, at)) else (0, False)
    if kind == "xprv":
        return (m.end(), check58(m[0])) if (m := _XPRV.match(text, at)) else (0, False)
    return (m.end(), crc_of(m[1]) == m[2]) if (m := _TOKEN36.match(text, at)) else (0, False)


def scan(text: str, ac: ahocorasick.Automaton) -> list[Span]:
    """The spans (kind, start, end in code points) by start, then kind as listed."""
    raw = text.encode()
    plain = len(raw) == len(text)
    out, done = [], dict.fromkeys(KINDS, 0)
    hits = [(end + 1 - n, kind) for end, (kind, n) in ac.iter(raw.lower().decode("latin-1"))]
    hits.sort()
    counted: list[np.ndarray] = []

    def place(b: int) -> int:
        """The code point that begins at byte b; counted once for the whole text."""
        if plain or not b:
            return b
        if not counted:
            counted.append(np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, dtype=np.int64))
        return int(counted[0][b - 1])

    for b, kind in hits:
        at = place(b)
        if at >= done[kind]:
            end, passes = _anchored(kind, text, at)
            if end:
                done[kind] = end
                if passes:
                    out.append((kind, at, end))
    for m in _HEX4.finditer(raw[::8]):
        b = 8 * m.start()
        while b and raw[b - 1] in _HEX_BYTES:
            b -= 1
        run = _HEX.match(raw, b)
        while run and run.start() <= 8 * (m.end() - 1):  # strings with a short gap show as one there
            if run.end() - run.start() >= 32:
                at = place(run.start())
                out.append(("hex", at, at + run.end() - run.start()))
            run = _HEX.search(raw, run.end())
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end) for every row of (doc_id, text).

    A null or empty text has no spans; repeated rows are scanned each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ac = automaton()
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, ac)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPANS)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for _, start, end in spans:
        if end > at:
            if start >= at:
                out += [text[at:start], mark]
            at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of every text replaced by mark (overlapping spans by one) and n_chars, if there, corrected.

    All rows and columns stay; texts without secrets, nulls and n_chars of unchanged rows stay as they are.
    """
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ac = automaton()
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [scan(t, ac) if t else [] for t in texts]
            if any(found):
                new = [redacted(t, s, mark) if s else t for t, s in zip(texts, found, strict=True)]
                arrays = list(b.columns)
                arrays[at] = pa.array(new, b.schema.field(at).type)
                if count is not None:
                    length = pa.array([len(t) if t is not None else None for t in new], pa.int64()).cast(arrays[count].type)
                    arrays[count] = pc.if_else(pa.array([bool(s) for s in found]), length, arrays[count])
                b = pa.RecordBatch.from_arrays(arrays, schema=b.schema)
            yield b

    return docs.mapInArrow(lean(run), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from find_secrets()."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*BASE)), said), ",")
    return found.select("doc_id", *map(n, KINDS), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in all documents."""
    return digest(find_secrets(table(spark, sf_dir, "documents")))

"""Byte-level BPE encoding and decoding, with encodings of shared word prefixes computed once.

Texts are cut into the pattern's pieces (see _pieces). The different new pieces of a batch form a trie, which is walked
depth first in byte order. The state at a node is the last token of the encoding of the prefix that ends there: of the
tokens that the prefix ends in, the only one that is compatible with the last token of the prefix before it. Two tokens
are compatible if the merges leave their boundary standing. Words that share a prefix share its states; a word's ids are
read backwards from its own node. Tokens of the vocabulary that their own bytes don't encode to are never last.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import _pieces
from siftwell.llm._common import lean, table

NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE tokenizer file."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes: dict[int, bytes] = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        self.id = {b: i for i, b in self.bytes.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(vocab[a + b], (rank, *pair))
        self.ends = {b[k:] for b in self.bytes.values() for k in range(len(b))}
        self._spine: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._own: dict[int, bool] = {}

    def spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens that stand at this edge of token while it is built, each with the rank of the merge that ends it."""
        if (got := self._spine.get((token, right))) is None:
            got, t, until = [(token, NEVER)], token, NEVER
            while t in self.parts:
                until, *both = self.parts[t]
                t = both[right]
                got.append((t, until))
            self._spine[token, right] = got
        return got

    def _crossed(self, a: int, b: int, but_whole: bool) -> bool:
        """Whether a merge joins the end of a to the start of b. Of equal merges the left one comes first."""
        for x, x_end in self.spine(a, True):
            for y, y_end in self.spine(b, False):
                r = self.rank.get((x, y))
                if r is not None and r < x_end and r <= y_end and not (but_whole and x == a and y == b):
                    return True
        return False

    def fits(self, a: int, b: int) -> bool:
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > 250_000:
                self._fits.clear()
            got = self._fits[a, b] = not self._crossed(a, b, False)
        return got

    def own(self, t: int) -> bool:
        """Whether the bytes of t are encoded as t."""
        got = self._own.get(t)
        if got is None:
            if len(self.bytes[t]) == 1:
                got = True
            elif t not in self.parts:
                got = False
            else:
                _, a, b = self.parts[t]
                got = self.own(a) and self.own(b) and not self._crossed(a, b, True)
            self._own[t] = got
        return got

    def last(self, word: bytes, end: int, states: list[int], ends: list[int]) -> tuple[int, int]:
        """The last token of the encoding of word[:end], and where it starts; states, ends: those of shorter prefixes."""
        found = []
        start = end - 1
        while start >= 0 and (part := word[start:end]) in self.ends:
            t = self.id.get(part)
            if t is not None and self.own(t):
                found.append((t, start))
            start -= 1
        for t, start in reversed(found):
            if not start or self.fits(states[start], t):
                return t, start
        raise ValueError(f"no token ends {word[:end]!r}")

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word. Sorted words in turn are the depth-first walk of their trie: what two neighbours share is its common path."""
        out: list[list[int]] = [[] for _ in words]
        states, starts, before = [0], [0], b""
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = words[k]
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], starts[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                t, s = self.last(word, end, states, starts)
                states.append(t)
                starts.append(s)
            before, at, ids = word, len(word), out[k]
            while at:
                ids.append(states[at])
                at = starts[at]
            ids.reverse()
        return out


class Encoder:
    """What a Python worker that encodes keeps of one tokenizer file."""

    def __init__(self, spec: dict, classes: bytes) -> None:
        self.vocabulary = v = Vocabulary(spec)
        self.classes = np.frombuffer(classes, np.uint8)
        self.marks = {content: chr(_pieces.FIRST_SPECIAL + k) for k, content in enumerate(v.special)}
        ids_of_mark = {self.marks[c]: [i] for c, i in v.special.items()}

        def encode(pieces: list[str]) -> list[list[int]]:
            ids = v.encode_words([b"" if p in ids_of_mark else p.encode() for p in pieces])
            return [ids_of_mark.get(p, i) for p, i in zip(pieces, ids, strict=True)]

        self.pieces = _pieces.PieceTable(encode, most=400_000)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        texts = [t or "" for t in texts]
        for content, mark in self.marks.items():
            texts = [t.replace(content, mark) if content in t else t for t in texts]
        counts, ids = np.zeros(len(texts), np.int64), []
        for rows, joined in _pieces.chunks(texts):
            cp = _pieces.code_points(joined)
            cls = self.classes[cp]
            starts, ends = _pieces.byte_level_pieces(cp, cls)
            entry = self.pieces.lookup(cp, starts, ends)
            ids.append(self.pieces.ids_of(entry))
            part = np.searchsorted(np.flatnonzero(cp == _pieces.END), starts)
            np.add.at(counts, np.array(rows), np.bincount(part, self.pieces.id_length[entry], len(rows)).astype(np.int64))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))


class Decoder:
    """The bytes of every token, one after the other: all that a worker that decodes keeps."""

    def __init__(self, spec: dict) -> None:
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        whole = {i: bytes(to_byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        whole |= {i: c.encode() for c, i in special.items()}
        size = max(whole) + 1
        self.byte_length = np.array([len(whole.get(i, b"")) for i in range(size)])
        self.byte_start = np.cumsum(self.byte_length) - self.byte_length
        self.all_bytes = np.frombuffer(b"".join(whole.get(i, b"") for i in range(size)), np.uint8)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        length = self.byte_length[flat]
        raw = self.all_bytes[_pieces.spans_index(self.byte_start[flat], length)]
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)]
        return pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


_encoders: dict[str, Encoder] = {}
_decoders: dict[str, Decoder] = {}


class Tokenizer:
    """A tokenizer file as it goes to executors: packed, so that its path need not exist there; its size bounds the broadcast."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        raw = open(path, encoding="utf-8").read()
        self.name = hashlib.sha256(raw.encode()).hexdigest()
        self.packed = spark.sparkContext.broadcast((zlib.compress(raw.encode()), zlib.compress(_pieces.character_classes())))

    def encoder(self) -> Encoder:
        if self.name not in _encoders:
            spec, classes = map(zlib.decompress, self.packed.value)
            _encoders[self.name] = Encoder(json.loads(spec), classes)
        return _encoders[self.name]

    def decoder(self) -> Decoder:
        if self.name not in _decoders:
            _decoders[self.name] = Decoder(json.loads(zlib.decompress(self.packed.value[0])))
        return _decoders[self.name]


def encode(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id and ids (array of int) for every row of (doc_id, text).

    A null or empty text has no ids; repeated rows are encoded each; special tokens in a text are single ids, as the
    tokenizers library has it. Other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.encoder()
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column(1).to_pylist())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id, ids and the text that ids stand for; bytes that are no valid UTF-8 become U+FFFD, null ids an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = tokenizer.decoder()
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns, decoder.decode(part.column(1))], names=["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, ids array<int>, text string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded again."""
    import public_tokenizers

    tokenizer = Tokenizer(spark, spark.conf.get("siftwell.bpe.tokenizer", public_tokenizers.path("byte_bpe_50k.json")))
    rows = decode(encode(table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))

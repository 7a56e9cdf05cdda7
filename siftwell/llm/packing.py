"""Best-fit packing of token sequences by exact complements.

Documents are encoded and cut into pieces of at most `size` tokens. Only the histogram of piece lengths (at most `size`
rows) reaches the driver. There each sequence is planned from the longest length on: the gap is looked up among the
sums of one, two and three lengths that are still available; if one fills it exactly, it is consumed, else the longest
length that fits goes in and the smaller gap is looked up. A plan is consumed as often as the counts allow, so the work
depends on the number of lengths, not of documents. Pieces find their places by their rank among pieces of one length.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm import _pieces
from siftwell.llm._common import lean, materialize, table
from siftwell.llm.bpe import byte_letters

SIZE, SEPARATOR = 4096, 1


class Codec:
    """A word-level BPE file with the library's normalisation (NFC, white space to spaces, lower case) done on arrays."""

    def __init__(self, raw: str, classes: bytes, lower: bytes) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        model = Tokenizer.from_str(raw).model
        letters = dict(enumerate(byte_letters()))
        self.classes, self.lower = np.frombuffer(classes, np.uint8), np.frombuffer(lower, "<u4")
        self.marks = {t["content"]: chr(_pieces.FIRST_SPECIAL + k) for k, t in enumerate(spec["added_tokens"])}
        special = {self.marks[t["content"]]: [t["id"]] for t in spec["added_tokens"]}

        def encode(pieces: list[str]) -> list[list[int]]:
            return [special.get(p) or [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(letters))] for p in pieces]

        self.pieces = _pieces.PieceTable(encode)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        texts = [t or "" for t in texts]
        for content, mark in self.marks.items():
            texts = [t.replace(content, mark) if content in t else t for t in texts]
        texts = [t if t.isascii() else (t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).replace("İ", "i̇") for t in texts]
        held: list[np.ndarray] = []
        row = 0
        for rows, joined in _pieces.chunks(texts):
            cp = self.lower[_pieces.code_points(joined)]
            cls = self.classes[cp]
            starts, ends = _pieces.word_pieces(cp, cls)
            entry = self.pieces.lookup(cp, starts, ends)
            ids = self.pieces.ids_of(entry)
            part = np.searchsorted(np.flatnonzero(cp == _pieces.END), starts)
            n = np.bincount(part, self.pieces.id_length[entry], len(rows)).astype(np.int64)
            for r, x in zip(rows, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                while row < r:
                    yield np.concatenate(held)
                    held, row = [], row + 1
                held.append(x)
        if held:
            yield np.concatenate(held)


def lower_table() -> bytes:
    """The lower case of each code point, as the tokenizer library has it (U+0130 has two, which the codec sees to)."""
    from tokenizers import normalizers

    points = np.concatenate([np.arange(0x130), np.arange(0x131, 0xD800), np.arange(0xE000, 0x110000)])
    out = np.arange(0x110000, dtype="<u4")
    out[points] = np.frombuffer(normalizers.Lowercase().normalize_str("".join(map(chr, points))).encode("utf-32-le"), "<u4")
    return out.tobytes()


_codecs: dict[str, Codec] = {}


class Tokenizer:
    """A tokenizer file as it goes to executors; its size bounds the broadcast."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        raw = open(path, encoding="utf-8").read()
        self.name = hashlib.sha256(raw.encode()).hexdigest()
        self.packed = spark.sparkContext.broadcast([zlib.compress(x) for x in (raw.encode(), _pieces.character_classes(), lower_table())])

    def codec(self) -> Codec:
        if self.name not in _codecs:
            raw, classes, lower = map(zlib.decompress, self.packed.value)
            _codecs[self.name] = Codec(raw.decode(), classes, lower)
        return _codecs[self.name]


def cut(docs: DataFrame, tokenizer: Tokenizer, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of (doc_id, text), a separator at each end."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokenizer.codec()
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                row, piece, start, chunk = [], [], [], []
                for k, ids in enumerate(codec.encode(part.column(1).to_pylist())):
                    ids = np.append(ids, SEPARATOR).astype("<u4")
                    for p, at in enumerate(range(0, len(ids), size)):
                        row.append(k)
                        piece.append(p)
                        start.append(at)
                        chunk.append(ids[at : at + size])
                length = np.array([len(c) for c in chunk], np.int64)
                out = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array([zlib.crc32(c.tobytes()) for c in chunk], pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(np.concatenate(chunk).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Gaps:
    """The sums of one, two and three available lengths, looked up by gap.

    Counts only fall, so what can't fill a gap never can: each gap keeps where its search for triples has come to.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.no_pair = np.zeros(len(counts), bool)
        self.triple_at = np.arange(len(counts))

    def pair(self, gap: int) -> tuple[int, ...]:
        if gap < 2 or self.no_pair[gap]:
            return ()
        half = gap // 2
        there = (self.counts[gap - half : gap] > 0) & (self.counts[half:0:-1] > 0)  # larger and smaller part
        if gap % 2 == 0 and self.counts[half] < 2:
            there[0] = False
        k = int(there.size - 1 - np.argmax(there[::-1])) if there.any() else -1
        if k < 0:
            self.no_pair[gap] = True
            return ()
        return gap - half + k, half - k

    def triple(self, gap: int) -> tuple[int, ...]:
        a = int(self.triple_at[gap])
        while a > 0:
            if self.counts[a] > 0 and a <= gap - 2:
                self.counts[a] -= 1
                was = self.no_pair[gap - a]
                rest = self.pair(gap - a)
                self.no_pair[gap - a] = was if not rest else False
                self.counts[a] += 1
                if rest:
                    self.triple_at[gap] = a
                    return (a, *rest)
            a -= 1
        self.triple_at[gap] = 0
        return ()

    def fill(self, gap: int) -> tuple[int, ...]:
        return (gap,) if self.counts[gap] > 0 else self.pair(gap) or self.triple(gap)


@dataclass(frozen=True)
class Plan:
    """`times` sequences from `first` on, each of `parts`: (length, how many side by side)."""

    first: int
    times: int
    parts: tuple[tuple[int, int], ...]


def plan(histogram: dict[int, int], size: int = SIZE) -> list[Plan]:
    """Sequences for so many pieces of each length. Each plan uses up a length, or leaves less of it than a plan takes."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    gaps, out, first = Gaps(counts), [], 0
    largest = size
    while True:
        while largest and not counts[largest]:
            largest -= 1
        if not largest:
            return out
        used: dict[int, int] = {}

        def take(length: int, n: int = 1) -> None:
            counts[length] -= n
            used[length] = used.get(length, 0) + n

        take(largest)
        gap, top = size - largest, largest
        while gap:
            if found := gaps.fill(gap):
                for x in found:
                    take(x)
                break
            top = min(top, gap)
            while top and not counts[top]:
                top -= 1
            if not top:
                break
            # many of one length at once, as long as three more could still fill the rest exactly
            n = int(max(1, min(counts[top], gap // top - 3)))
            take(top, n)
            gap -= n * top
        times = 1 + min(int(counts[x]) // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * (times - 1)
        out.append(Plan(first, times, tuple(sorted(used.items(), reverse=True))))
        first += times


def places(plans: list[Plan]) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of one length by rank: keys (length << 40 | first rank), and first sequence, offset, how many side by side."""
    rows, ranks = [], {}
    for p in plans:
        offset = 0
        for length, n in p.parts:
            rank = ranks.get(length, 0)
            rows.append((length << 40 | rank, p.first, offset, n))
            ranks[length] = rank + n * p.times
            offset += n * length
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return a[:, 0].copy(), a[:, 1:].copy()


def place(pieces: DataFrame, size: int = SIZE, buckets: int = 128) -> DataFrame:
    """pieces with sequence_id and offset. Only lengths, ids and counts are shuffled; a hot length is ranked in buckets."""
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    counts = pieces.select("length", bucket.alias("bucket")).groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = materialize(counts.withColumn("before", F.sum("count").over(before) - F.col("count")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `size` rows
    key, to = places(plan(histogram, size))
    # a plan uses up a length, and its different lengths add up to `size` at most: so the arrays have a bound
    shared = pieces.sparkSession.sparkContext.broadcast((key, to))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("bucket", bucket).withColumn("nth", F.row_number().over(own) - 1)
    ranked = ranked.join(F.broadcast(counts.select("length", "bucket", "before")), ["length", "bucket"])  # at most size x buckets rows
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("nth")).alias("rank"))

    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, to = shared.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 40 | rank, "right") - 1
            nth = rank - (key[at] & ((1 << 40) - 1))
            first, offset, n = to[at].T
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(first + nth // n), pa.array(offset + nth % n * length)], names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(lean(run), schema)


def pack(docs: DataFrame, tokenizer: Tokenizer, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for the pieces of all documents.

    A null or empty text is one piece of the separator alone. Repeated rows are packed each; rows that agree in doc_id,
    piece and checksum may change places with one another. Other columns are not read; an empty table gives no rows.
    """
    return place(materialize(cut(docs, tokenizer, size, with_ids), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids from what pack() gives with_ids; a sequence has at most `size` ids."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def production_tokenizer(spark: SparkSession) -> Tokenizer:
    import public_tokenizers

    return Tokenizer(spark, spark.conf.get("siftwell.packing.tokenizer", public_tokenizers.path("word_bpe_49k.json")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), production_tokenizer(spark))

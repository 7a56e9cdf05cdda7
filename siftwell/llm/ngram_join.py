"""N-gram Jaccard join and its components, by a pigeonhole over a partition of the universe.

A document is its set of word shingles (64-bit hashes). Two sets that link differ in few shingles, at most `reach` of
the smaller one's size band. If hashes deal the universe into segments of which each allows 0 or 1 differences, and the
allowances (each plus one) add up to more than reach, two linked sets agree in some segment within its allowance: they
share the segment's hash, or that of the segment with one shingle deleted. A set is indexed under its own band and the
one below. How many segments allow 0 and how many 1 is chosen for each band by cost: signatures written against chance
collisions to be verified, which grow with the number of documents. Where signatures are many, they are made, written and
counted in slices of their hashes, one after the other, so that their disk doesn't grow with them.

Each band has more segments than it needs, and so each set may leave out as many: its empty ones, then those of the longest
lists, as counted over the corpus. What two linked sets share is worth more than either may leave out, and as all order
signatures alike (longest list first), neither leaves out the last of what they share.

Equal sets are one class; classes meet, not copies. In a signature's bucket each class is first verified against one
leader. Links make components; then every pair of a bucket that the components still separate is looked at, so no link
that could join two components is missed, and none within one need be looked for. Pairs are never rows: where sizes and
parity sketches allow a link (a shingle flips one of 512 bits, so two sets differ in at least as many shingles as their
sketches in bits) the two classes are sent to a task, block against block, which counts whole sets and returns what joins.

A document's number of links takes every pair: all links of a class lie in its component, so each component's sets are
dealt into blocks, and every two blocks meet in one task, which counts all their overlaps and returns sums, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm._common import free, fresh, lean, materialize, small, table, written

_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


@dataclass(frozen=True)
class Join:
    """Shingles of `words` words; sets link if percent_of * intersection >= percent * union; n: documents, for costs."""

    words: int = 5
    percent: int = 80
    percent_of: int = 100
    n: int = 1_000_000
    #: For costs: the share of other documents that have a good part of their shingles in common with a document, that
    #: part, and a pair's cost in signatures (most pairs end at their sketches: 37 ns measured, beside 1.2 us of the JVM's).
    related: float = 1e-4
    common: float = 0.5
    pair_cost: float = 0.03
    #: Segments to be left out, as a share of those that are needed.
    spare_share: float = 0.1
    #: Signatures that are on disk at once, as a share of the shingles.
    at_once: float = 0.4

    def links(self, both: int, a: int, b: int) -> bool:
        return self.percent_of * both >= self.percent * (a + b - both)

    @lru_cache(maxsize=None)  # noqa: B019
    def lowest(self, band: int) -> int:
        """The smallest size of a band: the sizes of a band can link with each other and with the next band's only."""
        return 1 if band == 0 else (self.lowest(band - 1) * self.percent_of) // self.percent + 1

    def edges(self, size: int) -> list[int]:
        """The lowest sizes of all bands up to that of this size."""
        out = [self.lowest(0)]
        while (low := self.lowest(len(out))) <= size:
            out.append(low)
        return out

    def band(self, size: int) -> int:
        return len(self.edges(size)) - 1

    @lru_cache(maxsize=None)  # noqa: B019
    def reach(self, band: int) -> int:
        """The most by which two linked sets differ, the smaller one being in this band."""
        low, high = self.lowest(band), self.lowest(band + 1) - 1
        most = high + high * self.percent_of // self.percent
        return max(s - 2 * -(-self.percent * s // (self.percent + self.percent_of)) for s in range(max(2 * low, most - 2 * self.percent_of), most + 1))

    def spare(self, band: int) -> int:
        """What a set may leave out: a segment that allows no difference counts 1, one that allows one counts 2."""
        return math.ceil((self.reach(band) + 1) * self.spare_share) if self.reach(band) else 0

    @lru_cache(maxsize=None)  # noqa: B019
    def segments(self, band: int) -> tuple[int, int]:
        """How many segments allow no difference, and how many one, at the least estimated cost; none if only equal sets link."""
        need, size = self.reach(band) + 1 + self.spare(band), self.lowest(band)
        if not self.reach(band):
            return 1, 0

        def cost(ones: int) -> float:
            zeros = max(0, need - 2 * ones)
            each = size / (zeros + ones)
            signatures = zeros + ones * (1 + each)
            return signatures + self.pair_cost * self.n * self.related * self.common**each * signatures

        steps = sorted({0, *range(1, min(8, (need + 1) // 2) + 1), *np.linspace(1, (need + 1) // 2, 16).astype(int).tolist()})
        ones = min((k for k in steps if k <= (need + 1) // 2), key=lambda k: (cost(k), k))
        return max(0, need - 2 * ones), ones

    def slices(self) -> int:
        """In how many slices, one after the other, signatures are written and counted."""
        size, k = 256, self.band(256)
        signatures = sum(zeros + ones * (1 + size / (zeros + ones)) for zeros, ones in map(self.segments, (k, max(0, k - 1))))
        return max(1, math.ceil(signatures / size / self.at_once))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word, A-Z lower-cased, from UTF-8 bytes."""
    n = len(data)
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    data = lut[data]
    word = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15)
    return _mix(h), np.searchsorted(offsets, starts, "right") - 1


_power: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _power or len(_power[0]) < n:
        base = 0xD1342543DE82EF95
        with np.errstate(over="ignore"):
            a = np.full((2, max(n, 1 << 20)), 1, _U)
            a[0, 1:], a[1, 1:] = _U(base), _U(pow(base, -1, 1 << 64))
            _power[:] = list(np.multiply.accumulate(a, axis=1))
    return _power[0], _power[1]


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text, text by text in order, and how many each has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    n = len(texts)
    if not len(data):
        return np.zeros(0, _U), np.zeros(n, np.int64)
    h, doc = _words(data, offsets - offsets[0])
    per = np.bincount(doc, minlength=n)
    first = np.cumsum(per) - per
    with np.errstate(over="ignore"):
        long = np.flatnonzero(np.arange(len(h)) - first[doc] <= per[doc] - words)
        s = np.zeros(len(long), _U)
        for k in range(words):
            s = _mix(s * _U(0x9E3779B97F4A7C15) + h[long + k] + _U(k))
        short = np.flatnonzero((per > 0) & (per < words))
        t = np.zeros(len(short), _U)
        for k in range(words - 1):
            more = per[short] > k
            t[more] = _mix(t[more] * _U(0x9E3779B97F4A7C15) + h[first[short[more]] + k] + _U(k))
        t = _mix(t + per[short].astype(_U))
    s, owner = np.concatenate([s, t]), np.concatenate([doc[long], short])
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], np.bincount(owner[new], minlength=n)


def _sums(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of 64-bit values (modulo 2^64) by group; group must be sorted."""
    out = np.zeros(groups, _U)
    if len(values):
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        with np.errstate(over="ignore"):
            out[group[at]] = np.add.reduceat(values, at)
    return out


def set_hashes(s: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(size)), size)
    with np.errstate(over="ignore"):
        return tuple(_mix(_sums(_mix(s + _U(k)), owner, len(size)) + size.astype(_U)) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def allocated(s: np.ndarray, size: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The signatures of each set, set by set in order, how many each has, and what it may still leave out in its schemes
    of even and of odd number.

    The lowest bit of a signature is that of its scheme's number; the next is set if its segment allows a difference.
    Empty segments are left out first, as far as may be.
    """
    n = len(size)
    found, owners, spare = [], [], [np.zeros(n, np.int32), np.zeros(n, np.int32)]
    bands = np.where(size > 0, np.searchsorted(join.edges(int(size.max(initial=0))), size, "right") - 1, -1)
    owner = np.repeat(np.arange(n), size)
    for step in (0, 1):
        scheme = np.where(size > 0, bands - step, -1)
        table_ = {int(k): (*join.segments(int(k)), join.lowest(int(k) + 1) - 1, join.spare(int(k))) for k in np.unique(scheme) if k >= 0}
        zeros, ones, high, extra = (np.array([table_[int(k)][x] if k >= 0 else 0 for k in scheme], np.int64) for x in range(4))
        takes = (scheme >= 0) & ((step == 0) | (size * join.percent <= high * join.percent_of))
        m = np.where(takes, zeros + ones, 0)
        base = np.cumsum(m) - m
        in_ = takes[owner]
        e, o = s[in_], owner[in_]
        # the high bits of a remixed hash choose the segment
        part = (((_mix(e ^ _U(0xA0761D6478BD642F)) >> _U(32)) * m[o].astype(_U)) >> _U(32)).astype(np.int64)
        seg = base[o] + part
        order = np.argsort(seg, kind="stable")
        e, o, part, seg = e[order], o[order], part[order], seg[order]
        weight = _mix(e)
        total = _sums(weight, seg, int(m.sum()))
        seg_owner = np.repeat(np.arange(n), m)
        place = np.arange(len(total)) - base[seg_owner]
        one = place >= zeros[seg_owner]  # the last segments allow one difference
        units = np.where(np.bincount(seg, minlength=len(total)) == 0, 1 + one, 0)
        left_out = np.cumsum(units)
        left_out -= (left_out - units)[np.minimum(base, len(total) - 1)][seg_owner] if len(total) else 0
        gone = (units > 0) & (left_out <= extra[seg_owner])
        rest = np.where(takes, extra - np.bincount(seg_owner[gone], weights=units[gone], minlength=n).astype(np.int64), 0)
        for parity in (0, 1):
            spare[parity] += np.where(scheme % 2 == parity, rest, 0).astype(np.int32)
        with np.errstate(over="ignore"):
            tag = _mix(scheme[seg_owner].astype(_U) * _U(0x9E3779B97F4A7C15) + place.astype(_U))
            marks = (scheme[seg_owner] & 1).astype(_U) | (one.astype(_U) << _U(1))
            found.append((_mix(total + tag) & ~_U(3) | marks)[~gone])
            owners.append(seg_owner[~gone])
            drop = one[seg]
            found.append(_mix(total[seg[drop]] - weight[drop] + tag[seg[drop]]) & ~_U(3) | marks[seg[drop]])
            owners.append(o[drop])
    sig, own = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return sig[order], np.bincount(own, minlength=n), spare


def signatures(s: np.ndarray, size: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of each set, set by set in order, and how many each has."""
    return allocated(s, size, join)[:2]


def _lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _parts(b: pa.RecordBatch, most: int = 1 << 18, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Slices of about a quarter MB of text and so many rows at most: what a worker needs for them is some hundred bytes a byte."""
    length = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
    edge = np.flatnonzero(np.diff(np.cumsum(length) // most) | np.diff(np.arange(len(length)) // rows)) + 1
    for a, z in zip([0, *edge], [*edge, b.num_rows], strict=True):
        if z > a:
            yield b.slice(a, z - a)


SKETCH = 8


def sketches(s: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The parity sketch of each set as SKETCH 64-bit columns."""
    n, bits = len(size), 64 * SKETCH
    owner = np.repeat(np.arange(n), size)
    bit = (_mix(s ^ _U(0x2545F4914F6CDD1D)) >> _U(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(owner * bits + bit, minlength=n * bits) & 1).astype(np.uint8)
    packed = np.packbits(odd.reshape(n, bits), axis=1).view(np.int64).reshape(n, SKETCH)
    return [np.ascontiguousarray(packed[:, k]) for k in range(SKETCH)]


MARKS = [f"s{k}" for k in range(SKETCH)]
_MARKS = "".join(f", {m} long" for m in MARKS)


def index(docs: DataFrame, join: Join, nth: int = 0) -> DataFrame:
    """doc_id, n (size of the set), a, b (128-bit hash of the set), sigs (its signatures of the nth slice), spare (what it may
    leave out in schemes of even and of odd number), in the first slice s0 .. (its sketch) for every row."""
    slices, marks = join.slices(), MARKS if nth == 0 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in _parts(whole):
                s, size = shingle_sets(x.column(1), join.words)
                a, b = set_hashes(s, size)
                sig, count, spare = allocated(s, size, join)
                own = ((sig >> _U(32)) * _U(slices)) >> _U(32) == _U(nth)  # by the high bits
                count = np.bincount(np.repeat(np.arange(len(count)), count)[own], minlength=len(count))
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _lists(sig[own], count), *map(pa.array, spare), *map(pa.array, sketches(s, size) if marks else ())], names=["doc_id", "n", "a", "b", "sigs", "spare0", "spare1", *marks])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, a long, b long, sigs array<long>, spare0 int, spare1 int" + _MARKS * (nth == 0))


def sets(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, a, b and the set itself for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in _parts(whole):
                s, size = shingle_sets(x.column(1), join.words)
                a, b = set_hashes(s, size)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _lists(s, size)], names=["doc_id", "a", "b", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, a long, b long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id of the edges (u, v).

    In each round every id takes the smallest of itself and its neighbours, then what that one takes, and the edges are
    drawn anew between the labels; the smallest id of a component never changes, so the last label is it.
    """
    live = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    steps: list[DataFrame] = []
    while True:
        both = live.select("u", F.col("v").alias("near")).union(live.select("v", "u"))
        taken = materialize(both.groupBy("u").agg(F.min("near").alias("near")).select(F.col("u").alias("id"), F.least("u", "near").alias("to")), "taken")
        then = taken.select(F.col("id").alias("to"), F.col("to").alias("x"))
        steps.append(materialize(taken.join(then, "to").select("id", F.least("to", "x").alias("label")), "labels"))
        if not steps[-1].limit(1).count():
            break
        before, live = live, materialize(_relabelled(live, steps[-1], "label"), "edges")
        free(before, taken)
        if not live.limit(1).count():
            break
    out = steps[0].select("id", F.col("label").alias("component"))
    for later in steps[1:]:
        out = out.join(later.select(F.col("id").alias("component"), "label"), "component", "left").select("id", F.coalesce("label", "component").alias("component"))
    out = materialize(out, "components")
    free(live, *steps)
    return out


def _relabelled(edges: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """The edges between the labels of their ends; ids without a label keep themselves."""
    at = lambda end: labels.select(F.col("id").alias(end), F.col(label).alias(f"new_{end}"))
    rows = edges.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("new_u", "u").alias("u"), F.coalesce("new_v", "v").alias("v"))
    return rows.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _may_link(join: Join) -> Column:
    """Whether sizes and sketches of the sides x and y allow a link."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{m}_x").bitwiseXOR(F.col(f"{m}_y"))) for m in MARKS])
    both = F.col("n_x") + F.col("n_y")
    # least overlap of a link: percent / (percent + percent_of) of both sizes, rounded up
    allowed = both - 2 * F.ceil(F.lit(join.percent) * both / F.lit(join.percent + join.percent_of))
    return (F.lit(join.percent_of) * F.least("n_x", "n_y") >= F.lit(join.percent) * F.greatest("n_x", "n_y")) & (differ <= allowed)


def _side(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{c}_{side}") for c in ("a", *columns)])


def _sets_of(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """a, id, n, shingles of the classes in pairs (a_x, a_y); no other sets are shuffled or written."""
    wanted = pairs.select(F.col("a_x").alias("a")).union(pairs.select("a_y")).distinct()
    wanted = materialize(nodes.select("a", "b", "id", "n").join(wanted, "a", "left_semi"), "wanted")
    chosen = _chosen(docs, wanted, small(wanted, 1_000_000), join)  # 32 bytes a row, a million at most
    found = materialize(chosen.select("a", "id", "n", "shingles"), "sets")  # rows that repeat a doc_id repeat links, which become distinct
    free(wanted)
    return found


def _chosen(docs: DataFrame, wanted: DataFrame, few: bool, join: Join) -> DataFrame:
    """The wanted classes (a, b, id and more) with their sets, each from the rows of its id; few: whether to broadcast wanted."""
    if few:  # then other texts aren't even taken apart
        docs = docs.select("doc_id", "text").join(F.broadcast(wanted.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    return sets(docs, join).join(F.broadcast(wanted) if few else wanted, ["a", "b"]).filter("doc_id = id")


def _linked(pairs: DataFrame, found: DataFrame, join: Join) -> DataFrame:
    """The linked ones of pairs (a_x, a_y: class hashes) as edges (u, v) of ids."""
    pairs = pairs.select("a_x", "a_y")
    rows = pairs.join(_side(found, "y", "id", "n", "shingles"), "a_y").join(_side(found, "x", "id", "n", "shingles"), "a_x")
    rows = rows.withColumn("both", F.size(F.array_intersect("shingles_x", "shingles_y")).cast("long"))
    rows = rows.filter(F.lit(join.percent_of) * F.col("both") >= F.lit(join.percent) * (F.col("n_x") + F.col("n_y") - F.col("both")))
    return materialize(rows.select(F.col("id_x").alias("u"), F.col("id_y").alias("v")).filter("u <> v").distinct(), "links")


def _same_document(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (u, v) that join the classes of each doc_id with several sets."""
    worded = rows.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "a", "b")
    several = worded.groupBy("doc_id").agg(F.min("a").alias("first"), F.max("a").alias("last")).filter("first < last").select("doc_id")
    own = worded.join(materialize(several, "several"), "doc_id", "left_semi").join(nodes.select("n", "a", "b", "id"), ["n", "a", "b"])
    own = materialize(own.select("doc_id", "id").distinct(), "own")
    return own.join(own.groupBy("doc_id").agg(F.min("id").alias("u")), "doc_id").select("u", F.col("id").alias("v")).filter("u <> v").distinct()


#: Bits of the bitmap of shared signatures: 16 for each, as long as it has no more than MOST_BITS (32 MB).
MOST_BITS = 1 << 28


def _sifted(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The keys of rows without most of those that aren't shared: a bitmap of bounded size lets some of them through."""
    bits = min(MOST_BITS, 1 << max(10, (16 * shared.count()).bit_length()))
    at = F.shiftright("key", 2).bitwiseAND(bits - 1)
    words = shared.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((shiftright(key, 2) & {bits - 1}) & 63 AS INT))")).alias("set")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["set"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value.view(_U)
        for b in batches:
            lists = b.column(4)
            key, count = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            place = (key.view(_U) >> _U(2)) & _U(bits - 1)
            hit = np.flatnonzero((bitmap[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1))
            row = np.repeat(np.arange(b.num_rows), count)[hit]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(row)) for k in range(4)), pa.array(key[hit])], names=["a", "b", "spare0", "spare1", "key"])

    return rows.filter("n > 0 AND doc_id IS NOT NULL").select("a", "b", "spare0", "spare1", "sigs").mapInArrow(lean(run), "a long, b long, spare0 int, spare1 int, key long")


def _members(docs: DataFrame, rows: DataFrame, join: Join) -> DataFrame:
    """key, a, lead (the smallest a) for the signatures that two classes or more have and don't leave out; rows: the index."""
    found = []
    for nth in range(join.slices()):
        part = materialize(index(docs, join, nth), "slice") if nth else rows
        keys = part.filter("n > 0 AND doc_id IS NOT NULL").select("a", "b", "spare0", "spare1", F.explode("sigs").alias("key"))
        shared = keys.groupBy("key").agg(F.count("*").alias("length"), F.min("a").alias("first"), F.max("a").alias("last"))
        shared = materialize(shared.filter("first < last").select("key", "length"), "shared")
        found.append(materialize(_sifted(part, shared).join(shared, "key").distinct(), "listed"))
        free(shared, *[part] * (nth > 0))
    listed = reduce(DataFrame.unionByName, found)
    # a set's own: longest list first
    own = Window.partitionBy("a", "b", F.col("key").bitwiseAND(1)).orderBy(F.desc("length"), "key")
    worth = F.when(F.col("key").bitwiseAND(2) == 0, 1).otherwise(2)
    kept = listed.withColumn("so_far", F.sum(worth).over(own)).filter(F.col("so_far") > F.when(F.col("key").bitwiseAND(1) == 0, F.col("spare0")).otherwise(F.col("spare1")))
    kept = materialize(kept.select("key", "a").distinct(), "kept")
    free(*found)
    leads = kept.groupBy("key").agg(F.min("a").alias("lead"), F.max("a").alias("last")).filter("lead < last").select("key", "lead")
    members = materialize(kept.join(leads, "key"), "members")
    free(kept)
    return members


#: Rows of a block of a bucket, and of those of small buckets that meet in one task.
BUCKET_ROWS = 4096
#: Pairs whose sketches are compared in one go.
PAIRS = 1 << 20


def _met(rows: DataFrame, group: str, sizes: DataFrame, bins: int) -> DataFrame:
    """rows dealt for applyInArrow by own, bin, i, j: every two blocks of a large group meet, small groups meet in bins.

    sizes: the groups, with how many blocks each has.
    """
    own = F.when(F.col("blocks") > 1, F.col(group))
    dealt = rows.join(sizes, group).withColumns({"own": own, "bin": F.when(own.isNull(), F.pmod(F.xxhash64(group), F.lit(bins))), "block": F.pmod(F.xxhash64("a"), F.col("blocks"))})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def _possible(t: pa.Table, join: Join) -> pa.Table:
    """lead and a of those rows that sizes and sketches allow a link with a row of their key and of another component."""
    key, n, component, block = (t[c].to_numpy() for c in ("key", "n", "component", "block"))
    order = np.lexsort((n, key))
    key, n, component, block = key[order], n[order], component[order], block[order]
    marks = [t[m].to_numpy()[order].view(_U) for m in MARKS]  # of a negative number numpy counts the bits of its absolute value
    two = t["i"][0].as_py() != t["j"][0].as_py()
    # by key, then size: what a row may link with are the next ones of its key, up to a size
    most = int(n.max()) + 1
    base = np.cumsum(np.append(False, key[1:] != key[:-1])) * most
    at = np.arange(len(n))
    count = np.searchsorted(base + n, base + np.minimum(n * join.percent_of // join.percent, most - 1), "right") - at - 1
    may = np.zeros(len(n), bool)
    part = np.cumsum(count) // PAIRS
    for rows in np.split(at, np.flatnonzero(np.diff(part)) + 1):
        x, y = np.repeat(rows, count[rows]), _spans(rows + 1, count[rows])
        asked = (component[x] != component[y]) & ~(may[x] & may[y])
        if two:
            asked &= block[x] != block[y]
        x, y = x[asked], y[asked]
        both = n[x] + n[y]
        allowed = both + 2 * (-join.percent * both // (join.percent + join.percent_of))
        for m in marks:
            allowed = allowed - np.bitwise_count(m[x] ^ m[y])
            near = allowed >= 0
            x, y, allowed = x[near], y[near], allowed[near]
        may[x] = may[y] = True
    found = order[may]
    return t.select(["lead", "a"]).take(pa.array(found))


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the edges (u, v), and for each the smallest that it reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    to = np.arange(len(ids))
    while True:
        least, new = np.minimum(to[x], to[y]), to.copy()
        for end in (x, y, to[x], to[y]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == to).all():
            return ids, ids[to]
        to = new


def _blocks(t: pa.Table) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The rows of the blocks i and j (perhaps one) of t, the shingles of each in order with the places of their rows in
    the block, and the sizes of all sets."""
    lists = t["shingles"].combine_chunks()
    size = pc.list_value_length(lists).to_numpy().astype(np.int64)
    e, owner = lists.flatten().to_numpy().view(_U), np.repeat(np.arange(len(size)), size)
    order = np.argsort(e, kind="stable")
    e, owner = e[order], owner[order]
    block = t["block"].to_numpy()
    rows, sides = [], []
    for k in (t["i"][0].as_py(), t["j"][0].as_py()):
        own = block == k
        place = np.cumsum(own) - 1
        rows.append(np.flatnonzero(own))
        sides.append((e[own[owner]], place[owner[own[owner]]]))
    return rows, sides, size


def _joined(t: pa.Table, join: Join) -> pa.Table:
    """Edges (u, v) between the components that links of two rows with one lead join; no more than there are rows."""
    t = t.take(pa.array(np.lexsort((t["a"].to_numpy(), t["lead"].to_numpy()))))
    lead, a = t["lead"].to_numpy(), t["a"].to_numpy()
    t = t.filter(pa.array(np.append(True, (lead[1:] != lead[:-1]) | (a[1:] != a[:-1]))))  # rows that repeat a doc_id
    edge = np.flatnonzero(np.diff(t["lead"].to_numpy())) + 1
    out = []
    for start, end in zip([0, *edge], [*edge, len(t)], strict=True):
        cell = t.slice(start, end - start)
        component = cell["component"].to_numpy()
        (x, y), sides, size = _blocks(cell)
        if len(x) and len(y):
            both = overlaps(*sides, len(x), len(y))
            linked = join.percent_of * both >= join.percent * (size[x][:, None] + size[y][None, :] - both)
            k, l = np.nonzero(linked & (component[x][:, None] != component[y][None, :]))
            out.append(_stars(component[x][k], component[y][l]))
    u, v = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*out, strict=True) if out else ((), ())))
    return pa.table({"u": u[u != v], "v": v[u != v]})


def _between(docs: DataFrame, members: DataFrame, known: DataFrame, join: Join) -> DataFrame:
    """Edges (u, v) between components whose classes share a signature and link.

    Pairs are no rows: in each bucket a task finds the rows that may link with a row of another component, and the sets
    of these meet by the leaders of their buckets, where a task counts them all.
    """
    placed = members.select("key", "a").join(known.select("a", "component"), "a")
    apart = placed.groupBy("key").agg(F.min("component").alias("s"), F.max("component").alias("t"), F.count("*").alias("rows")).filter("s < t")
    apart = materialize(apart.select("key", "rows", F.ceil(F.col("rows") / BUCKET_ROWS).cast("long").alias("blocks")), "apart")
    bins = 1 + (apart.agg(F.sum("rows")).first()[0] or 0) // BUCKET_ROWS
    looked = members.join(known.select("a", "n", "component", *MARKS), "a")
    met = _met(looked, "key", apart.select("key", "blocks"), bins).select("own", "bin", "i", "j", "block", "key", "lead", "a", "n", "component", *MARKS)
    may = materialize(met.groupBy("own", "bin", "i", "j").applyInArrow(lambda t: _possible(t, join), "lead long, a long").distinct(), "possible")
    free(apart)
    wanted = materialize(known.select("a", "b", "id", "n", "component").join(may.select("a").distinct(), "a", "left_semi"), "wanted")
    cells = may.join(wanted.select("a", "n"), "a").groupBy("lead").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    cells = materialize(cells.withColumn("blocks", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)).cast("long")), "cells")
    one = cells.filter("blocks = 1").agg(F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles")).first()
    bins = 1 + max((one["sets"] or 0) // (BLOCK_SETS // 2), (one["shingles"] or 0) // (BLOCK_SHINGLES // 2))
    found = materialize(_chosen(docs, wanted, small(wanted, 1_000_000), join).select("a", "component", "shingles"), "sets")
    met = _met(may.join(found, "a"), "lead", cells.select("lead", "blocks"), bins).select("own", "bin", "i", "j", "block", "lead", "a", "component", "shingles")
    edges = materialize(met.groupBy("own", "bin", "i", "j").applyInArrow(lambda t: _joined(t, join), "u long, v long").distinct(), "between")
    free(may, wanted, cells, found)
    return edges


def _labelled(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """The index of all rows; n, a, b, id, component of all classes (id: the smallest doc_id, null if there is none)."""
    rows = materialize(index(docs, join), "index")
    classes = materialize(rows.filter("n > 0").groupBy("n", "a", "b", *MARKS).agg(F.min("doc_id").alias("id")), "classes")
    members = _members(docs, rows, join)
    nodes = classes.filter("id IS NOT NULL")
    # one leader for each class first: of those that sizes and sketches allow the one that it shares most signatures with
    first = members.filter("a <> lead").groupBy("a", "lead").count().select(F.col("lead").alias("a_x"), F.col("a").alias("a_y"), "count")
    first = first.join(_side(nodes, "y", "n", *MARKS), "a_y").join(_side(nodes, "x", "n", *MARKS), "a_x").filter(_may_link(join))
    first = materialize(first.groupBy("a_y").agg(F.max_by("a_x", F.struct("count", "a_x")).alias("a_x")), "first")
    found = _sets_of(docs, first, nodes, join)
    edges = _linked(first, found, join)
    label = components(edges.union(_same_document(rows, nodes)))
    free(found, edges, first)
    known = materialize(nodes.join(label, "id", "left").select("a", "b", "id", "n", F.coalesce("component", "id").alias("component"), *MARKS), "known")
    edges = _between(docs, members, known, join)
    last = components(edges).select(F.col("id").alias("component"), F.col("component").alias("to"))
    named = known.select("n", "a", "b", "id", "component").join(last, "component", "left").select("n", "a", "b", "id", F.coalesce("to", "component").alias("component"))
    free(members, edges, label)
    alone = classes.filter("id IS NULL").select("n", "a", "b", "id", F.col("id").alias("component"))
    return rows, named.union(alone)


def join_components(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of (doc_id, text).

    Texts without words (null, empty, blank) have empty sets and are linked with nothing. Repeated rows and rows that
    share a doc_id are one document and have one component. A row without a doc_id links nothing itself; it gets the
    component of its class, or null. Other columns are not read; an empty table gives no rows.
    """
    rows, named = _labelled(docs, join)
    out = rows.select("doc_id", "n", "a", "b").join(named.select("n", "a", "b", "component"), ["n", "a", "b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


#: Classes and shingles of a block, as a mean.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1 .. of each span of count places, one after the other."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def overlaps(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], nx: int, ny: int, most: int = 1 << 22) -> np.ndarray:
    """How many values each set of x has in common with each of y; x and y: values in order, and the set of each."""
    (ex, ox), (ey, oy) = x, y
    u = np.intersect1d(ex, ey)
    lx, ly = np.searchsorted(ex, u), np.searchsorted(ey, u)
    cx, cy = np.searchsorted(ex, u, "right") - lx, np.searchsorted(ey, u, "right") - ly
    often = cx * cy > 1024
    total = np.zeros(nx * ny, np.int64)
    # what few sets have: its pairs one by one
    l, c, m, k = lx[~often], cx[~often], ly[~often], cy[~often]
    parts = np.cumsum(c * k) // most
    for part in np.unique(parts):
        at = np.flatnonzero(parts == part)
        each = np.repeat(k[at], c[at])
        total += np.bincount(np.repeat(ox[_spans(l[at], c[at])], each) * ny + oy[_spans(np.repeat(m[at], c[at]), each)], minlength=nx * ny)
    total = total.reshape(nx, ny)
    # what many have: a product of matrices, exact below 2^24
    l, c, m, k = lx[often], cx[often], ly[often], cy[often]
    for at in range(0, len(l), 1024):
        has = []
        for start, count, owner, n in ((l, c, ox, nx), (m, k, oy, ny)):
            start, count = start[at : at + 1024], count[at : at + 1024]
            has.append(np.zeros((n, len(start)), np.float32))
            has[-1][owner[_spans(start, count)], np.repeat(np.arange(len(start)), count)] = 1
        total += (has[0] @ has[1].T).astype(np.int64)
    return total


def _near(t: pa.Table, join: Join) -> pa.Table:
    """a and near (copies of its linked classes) from the sets of two blocks i and j, or of one."""
    t = t.take(np.unique(t["a"].to_numpy(), return_index=True)[1])  # rows that repeat a doc_id
    # of one component only: a remixed hash
    lists = t["shingles"].combine_chunks()
    each = np.repeat(_mix(t["component"].to_numpy().view(_U)), pc.list_value_length(lists).to_numpy())
    own = _lists(_mix(lists.flatten().to_numpy().view(_U) ^ each), pc.list_value_length(lists).to_numpy())
    a, copies = (t[c].to_numpy() for c in ("a", "copies"))
    rows, sides, size = _blocks(t.set_column(t.schema.get_field_index("shingles"), "shingles", own))
    x, y = rows
    if not len(x) or not len(y):
        return pa.table({"a": pa.array([], pa.int64()), "near": pa.array([], pa.int64())})
    both = overlaps(*sides, len(x), len(y))
    linked = join.percent_of * both >= join.percent * (size[x][:, None] + size[y][None, :] - both)
    if t["i"][0] == t["j"][0]:
        np.fill_diagonal(linked, False)
        return pa.table({"a": a[x], "near": linked @ copies[y]})
    return pa.table({"a": np.concatenate([a[x], a[y]]), "near": np.concatenate([linked @ copies[y], copies[x] @ linked])})


def join_links(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, n_links for every row of (doc_id, text).

    class_id is the smallest doc_id of the same set; n_links counts all other documents that are linked with the row's
    set, those of the same set too. A doc_id with several sets counts once in each. Without words a row is a class of
    its own with no links; without a doc_id its n_links is null. Otherwise as join_components().
    """
    rows, named = _labelled(docs, join)
    copies = rows.filter("n > 0 AND doc_id IS NOT NULL").select("a", "doc_id").distinct().groupBy("a").agg(F.count("*").alias("copies"))
    named = materialize(named.join(copies, "a", "left"), "named")
    # blocks: of a large component several, of small ones many components in one bin
    large = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("long")
    sizes = named.filter("id IS NOT NULL").groupBy("component").agg(large.alias("blocks"), F.count("*").alias("sets"), F.sum("n").alias("shingles")).filter("sets > 1")
    sizes = materialize(sizes, "sizes")
    one = sizes.filter("blocks = 1").agg(F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles")).first()
    bins = 1 + max((one["sets"] or 0) // (BLOCK_SETS // 2), (one["shingles"] or 0) // (BLOCK_SHINGLES // 2))
    bin_ = F.when(F.col("blocks") > 1, F.col("component"))  # a large component's own group; the others' in bin
    wanted = named.join(sizes, "component").select("a", "b", "id", "component", "copies", "blocks", bin_.alias("own"), F.when(bin_.isNull(), F.pmod(F.xxhash64("component"), F.lit(bins))).alias("bin"), F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"))
    wanted = materialize(wanted, "wanted")
    chosen = _chosen(docs, wanted, small(wanted, 500_000), join)  # 72 bytes a row
    met = chosen.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("own", "bin", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "a", "component", "copies", "shingles")
    near = met.groupBy("own", "bin", "i", "j").applyInArrow(lambda t: _near(t, join), "a long, near long").groupBy("a").agg(F.sum("near").alias("near"))
    named = materialize(named.join(near, "a", "left").select("n", "a", "b", "id", "component", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links")), "links")
    out = rows.select("doc_id", "n", "a", "b").join(named, ["n", "a", "b"], "left")
    own = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id"))
    links = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("links")).otherwise(0))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("id").alias("class_id"), own("component").alias("component_id"), links.alias("n_links"))


def keep_one(docs: DataFrame, join: Join) -> DataFrame:
    """The rows of docs without those whose component has a smaller doc_id; of rows that share a doc_id the first by text.

    Rows without a doc_id stay, as do texts without words. All columns stay.
    """
    with written() as made:
        found = materialize(join_components(docs, join), "components")
    free(*[x for x in made if x is not found])
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    again = found.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    gone = F.broadcast(gone) if small(gone) else gone
    out = docs.join(gone, "doc_id", "left_anti")
    if again.limit(1).count():
        again = F.broadcast(again) if small(again) else again
        order = fresh(docs, "__order")
        once = out.join(again, "doc_id", "left_semi").withColumn(order, F.struct("text", *[c for c in docs.columns if c != "text"])).groupBy("doc_id").agg(F.min(order).alias(order))
        out = out.join(again, "doc_id", "left_anti").unionByName(once.select(*[F.col(order)[c].alias(c) for c in docs.columns]))
    return out.select(*docs.columns)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: sets of three words, linked at 90 %."""
    docs = table(spark, sf_dir, "documents")
    return join_components(docs, Join(words=3, percent=90, n=docs.count()))


def op8_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as in op8_ngram_jaccard, with their classes and numbers of links."""
    docs = table(spark, sf_dir, "documents")
    return join_links(docs, Join(words=3, percent=90, n=docs.count()))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p WHERE 100 * common >= 90 * (na + nb - common)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.v AS doc_id, r.c FROM r JOIN l ON l.u = r.doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) AS m USING (doc_id)
"""

OP8_LINKS_SQL = OP8_SQL[: OP8_SQL.rindex("SELECT s.doc_id")] + r"""SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY list_sort(s.s)) END AS class_id, m.c AS component_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) AS m USING (doc_id) LEFT JOIN (SELECT u AS doc_id, count(*) AS n FROM l GROUP BY 1) AS k USING (doc_id)
"""

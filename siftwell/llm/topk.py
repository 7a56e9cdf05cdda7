"""Exact top-k by integer inner product, by vector-approximation files.

Vectors become integers floor(256 * x). One pass writes the approximation file: blocks of one byte cell a component, with
the block's edges. A cell stands for `width` neighbouring integers from its lower edge, so one product of a query with the
cells gives both bounds of every score: the score at the lower edges, plus what the query's negative (its positive)
components may add within a cell. Only queries are sent to the blocks. Each block gives, for each query, the vectors whose
upper bound reaches its own k-th lower bound; those that reach the k-th lower bound of all blocks are left. Exact vectors
are read for them in the order of the upper bound: first the foremost ones of each query, then those whose upper bound
reaches the k-th exact score found so far; then the k-th result is certain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm._common import free, materialize, table

LONG = (1 << 63) - 1
CELLS = 256
#: Bytes of vectors that a block may hold, and pairs of blocks for which cells are copied so that tasks have work.
BLOCK_BYTES, PAIRS = 32 << 20, 64


def to_integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) in float64, or as Python integers where float64 sums could be inexact."""
    out = np.floor(256.0 * values.astype(np.float64))
    if out.size and (not np.isfinite(out).all() or np.abs(out).max() ** 2 * max(1, out.shape[1]) >= 2.0**52):
        return _big(values)
    return out


def _big(values: np.ndarray) -> np.ndarray:
    flat = [math.floor(float(x) * 256) if abs(float(x)) < 1e300 else int(float(x)) * 256 for x in values.ravel()]
    return np.array(flat, dtype=object).reshape(values.shape)


def is_wide(values: np.ndarray) -> np.ndarray:
    """Rows whose bounds could be inexact in float64."""
    most = np.abs(values).max(axis=1, initial=0.0) * 256 + CELLS
    with np.errstate(over="ignore"):
        return most * most * max(1, values.shape[1]) >= 2.0**46


def approximate(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, and by component the lowest edge and the width of a cell, all integers."""
    lo, hi = vectors.min(axis=0), vectors.max(axis=0)
    width = np.maximum(-(-(hi - lo + 1) // CELLS), 1)
    return ((vectors - lo) // width).astype(np.uint8), lo, width


def _outward(x: int, up: bool) -> float:
    """The next double that is not below (up) or not above x."""
    try:
        f = float(x)
    except OverflowError:
        f = math.inf if x > 0 else -math.inf
    if abs(x) < 1 << 53:
        return f
    return math.nextafter(f, math.inf if up else -math.inf)


def bounds(queries: np.ndarray, cells: np.ndarray, lo: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores of queries and cells, as doubles."""
    at = (queries * width) @ cells.astype(queries.dtype).T + (queries @ lo)[:, None]
    least, most = (f(queries, 0) @ (width - 1) for f in (np.minimum, np.maximum))
    if queries.dtype == object:
        as_doubles = lambda rows, up: np.array([[_outward(int(x), up) for x in r] for r in rows], np.float64).reshape(at.shape)
        return as_doubles(at + least[:, None], False), as_doubles(at + most[:, None], True)
    return at + least[:, None], at + most[:, None]


def _matrices(b: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their vectors, one matrix for each length of vector in the column."""
    column = b.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f8", copy=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, flat[first[at][:, None] + np.arange(d)]


def _foremost(ids: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    """Of the rows of each vector (hash h) those of its k + 1 smallest ids, one row for each: one may be the query's own."""
    order = np.lexsort((ids, h))
    i, g = ids[order], h[order]
    group = np.append(True, g[1:] != g[:-1])[: len(g)]
    new = group | np.append(True, i[1:] != i[:-1])[: len(i)]
    order, group = order[new], group[new]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))
    return order[rank <= k]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """dim, wide, ids, hashes, vectors of a task's rows (vec_id, h, values), in blocks of bounded rows and bytes."""
    held: dict[tuple[int, bool], list] = {}

    def block(key: tuple[int, bool]):
        ids, h, v = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
        return (*key, ids, h, v)

    for b in batches:
        ids, h = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "h"))
        for at, v in _matrices(b, "values"):
            wide = is_wide(v)
            most = max(1, min(rows, BLOCK_BYTES // (8 * max(1, v.shape[1]))))
            for w in (False, True):
                mine = np.flatnonzero(wide == w)
                while len(mine):
                    key = (v.shape[1], w)
                    got = held.setdefault(key, [])
                    now, mine = np.split(mine, [most - sum(len(x[0]) for x in got)])
                    got.append((ids[at[now]], h[at[now]], v[now]))
                    if sum(len(x[0]) for x in got) >= most:
                        yield block(key)
    for key in [*held]:
        yield block(key)


_CELLS = "dim int, block long, wide boolean, ids binary, hashes binary, lo array<string>, width array<string>, cells binary"
_ASKED = "dim int, q_wide boolean, q_ids binary, q_hashes binary, q_data binary"
_FOUND = "query_id long, qh long, vec_id long, h long, lower double, upper double"
_SCORED = "query_id long, vec_id long, times int, score long, beyond binary, low double"


def _file(k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, (dim, wide, ids, h, v) in enumerate(_gathered(batches, rows)):
            keep = _foremost(ids, h, k)
            cells, lo, width = approximate(_big(v[keep]) if wide else np.floor(256.0 * v[keep]))
            edges = [pa.array([[str(int(x)) for x in e]], pa.list_(pa.string())) for e in (lo, width)]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part << 24 | n]), pa.array([wide]), pa.array([ids[keep].astype("<i8").tobytes()]), pa.array([h[keep].astype("<i8").tobytes()]), *edges, pa.array([cells.tobytes()])], names=["dim", "block", "wide", "ids", "hashes", "lo", "width", "cells"])

    return run


def _asked(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, wide, ids, h, v in _gathered(batches, rows):
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([wide]), *(pa.array([x.tobytes()]) for x in (ids.astype("<i8"), h.astype("<i8"), v))], names=["dim", "q_wide", "q_ids", "q_hashes", "q_data"])

    return run


def _scan(k: int):
    """For each pair of blocks the vectors that may be among the k best of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own, qh, ids, h = (np.frombuffer(r[c], "<i8") for c in ("q_ids", "q_hashes", "ids", "hashes"))
                exact = r["wide"] or r["q_wide"]
                values = np.frombuffer(r["q_data"], "<f8").reshape(len(own), r["dim"])
                queries = _big(values) if exact else np.floor(256.0 * values)
                cells = np.frombuffer(r["cells"], np.uint8).reshape(len(ids), r["dim"])
                lo, width = (np.array([int(x) for x in r[c]], object if exact else np.float64) for c in ("lo", "width"))
                for s in range(0, len(own), 32):
                    lower, upper = bounds(queries[s : s + 32], cells, lo, width)
                    other = own[s : s + 32, None] != ids[None, :]
                    ranked = np.where(other, lower, -np.inf)
                    sure = np.partition(ranked, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(lower), -np.inf)
                    q, c = np.nonzero(other & (upper >= sure[:, None]))
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[s + q], qh[s + q], ids[c], h[c], lower[q, c], upper[q, c])], names=["query_id", "qh", "vec_id", "h", "lower", "upper"])

    return run


def _sortable(score: int) -> bytes | None:
    """For scores at or beyond the ends of 64 bits: bytes in the order of the scores."""
    if -LONG - 1 < score < LONG:
        return None
    size = (abs(score).bit_length() + 7) // 8
    key = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return key if score > 0 else bytes(255 - x for x in key)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for (at, v), (_, q) in zip(_matrices(b, "values"), _matrices(b, "q_values"), strict=True):
            v, q = to_integers(v), to_integers(q)
            exact = [int(x) for x in (v.astype(object) * q.astype(object) if object in (v.dtype, q.dtype) else v * q).sum(axis=1)]
            rows = b.take(pa.array(at))
            found = [pa.array([max(-LONG - 1, min(LONG, x)) for x in exact], pa.int64()), pa.array([_sortable(x) for x in exact], pa.binary()), pa.array([_outward(x, False) for x in exact], pa.float64())]
            yield pa.RecordBatch.from_arrays([rows.column("query_id"), rows.column("vec_id"), rows.column("times"), *found], names=["query_id", "vec_id", "times", "score", "beyond", "low"])


def top_k(vectors: DataFrame, is_query, k: int = 5, rows: int = 16384, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for every row of (vec_id, embedding) that is_query picks.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id; vectors meet
    only those of their own length. Rows with the query's vec_id are not its candidates; a vec_id that several rows
    repeat is a candidate once for each, and as a query the best of all its different vectors' candidates are ranked
    together. Scores beyond 64 bits are ranked exactly and shown as the nearest 64-bit value.
    Fewer than k candidates: all of them; none, or an empty table: no rows. Other columns are not read.
    rows, query_rows: vectors in a block of cells and in a block of queries, within BLOCK_BYTES.
    """
    v = F.col("values")
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    all_ = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("values")).filter(F.col("vec_id").isNotNull() & usable)
    all_ = all_.select("vec_id", F.xxhash64("values").alias("h"), "values")
    queries = all_.filter(is_query).distinct()
    cells = materialize(all_.mapInArrow(_file(k, rows), _CELLS), "cells")
    n = max(1, cells.count())
    copies = -(-PAIRS // n)  # one, once there are as many blocks
    asked = queries.mapInArrow(_asked(query_rows), _ASKED)
    asked = asked.withColumn("copy", F.pmod(F.xxhash64("q_ids"), F.lit(copies))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = cells.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    pairs = asked.join(dealt.hint("shuffle_hash"), ["dim", "g", "copy"])
    found = materialize(pairs.mapInArrow(_scan(k), _FOUND), "bounds", batch=8)
    free(cells)

    query = ["query_id", "qh"]
    by_lower = Window.partitionBy(*query).orderBy(F.desc("lower"))
    sure = found.select(*query, "lower").withColumn("r", F.row_number().over(by_lower)).filter(F.col("r") <= k).groupBy(*query).agg(F.min("lower").alias("sure"), F.count("*").alias("of")).filter(F.col("of") == k)
    live = found.join(sure.drop("of"), query, "left").filter(F.col("sure").isNull() | (F.col("upper") >= F.col("sure")))
    live = live.groupBy(*query, "h", "vec_id").agg(F.max("upper").alias("upper"))
    live = live.withColumn("r", F.row_number().over(Window.partitionBy(*query, "h").orderBy("vec_id"))).filter(F.col("r") <= k)  # of equal vectors the smallest ids
    live = materialize(live.withColumn("r", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("upper"), "vec_id"))), "survivors")
    free(found)

    def scored(part: DataFrame) -> DataFrame:
        wanted = all_.join(part.select("vec_id", "h").distinct(), ["vec_id", "h"], "left_semi")
        wanted = wanted.groupBy("vec_id", "h", "values").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
        q = queries.select(F.col("vec_id").alias("query_id"), F.col("h").alias("qh"), F.col("values").alias("q_values"))
        both = part.join(wanted, ["vec_id", "h"]).join(q, query).filter(F.size("values") == F.size("q_values"))
        return both.select("query_id", "vec_id", "times", "values", "q_values").mapInArrow(_score, _SCORED)

    first = materialize(scored(live.filter(F.col("r") <= 2 * k)), "scored")
    by_low = Window.partitionBy("query_id").orderBy(F.desc("low"))
    kth = first.select("query_id", "low").withColumn("r", F.row_number().over(by_low)).filter(F.col("r") == k).select("query_id", F.col("low").alias("kth"))
    later = live.filter(F.col("r") > 2 * k).join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    second = materialize(scored(later), "scored")
    free(live)
    best = first.union(second).withColumn("one", F.explode(F.sequence(F.lit(1), "times")))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return best.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

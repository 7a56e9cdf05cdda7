"""Shards by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each node every child draws ln(u) / weight with u a hash of (row key, child)
in (0, 1), and the largest draw wins: children get rows in proportion to their weights, and a change of one child's
weight moves rows only between that child and its siblings, so movement stays in the subtrees whose weights change.
A shard that is added comes as a region of its own; no other weight changes, so rows move only into it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm._common import table


@dataclass(frozen=True)
class Node:
    """An inner node (children) or a shard (shard). The weight of an inner node is the sum of its children's."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, racks: int = 2, per_rack: int = 2, weights: Sequence[float] | None = None) -> Node:
    """Shards 0.. in racks of per_rack, racks in regions; weights by shard (1 each if not given, 0: takes no rows)."""
    leaf = [Node(f"s{k}", shard=k, own_weight=float(weights[k]) if weights else 1.0) for k in range(shards)]
    rack = [Node(f"k{k // per_rack}", tuple(leaf[k : k + per_rack])) for k in range(0, shards, per_rack)]
    return Node("root", tuple(Node(f"r{k // racks}", tuple(rack[k : k + racks])) for k in range(0, len(rack), racks)))


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and a rack of its own."""
    new = Node(f"s{shard}", shard=shard, own_weight=weight)
    return Node(root.name, (*root.children, Node(f"r+{shard}", (Node(f"k+{shard}", (new,)),))))


def draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.log(u) / F.lit(weight)


def descend(node: Node, key: Column) -> Column:
    """The shard that key reaches below node."""
    open_ = [c for c in node.children if c.weight > 0]
    if not node.children:
        return F.lit(node.shard)
    if not open_:
        raise ValueError(f"no weight below {node.name}")
    if len(open_) == 1:
        return descend(open_[0], key)
    best = F.array_max(F.array(*[F.struct(draw(key, c.name, c.weight).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(open_)]))["i"]
    out = descend(open_[-1], key)
    for i in range(len(open_) - 2, -1, -1):
        out = F.when(best == i, descend(open_[i], key)).otherwise(out)
    return out


def assign(docs: DataFrame, root: Node, extra: int, buckets: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law: `key`. Slots are gapless in a shard: rows are numbered in (shard, bucket of the doc_id) groups, which stay
    small at any size, and a table of at most shards x buckets counts gives each group its first slot. Only narrow
    columns are shuffled; the text is read once, for its size and checksum.

    A null text has size 1 and checksum 0; an empty one the same. Null doc_ids all hash alike. Rows that repeat a
    doc_id share a shard and have slots of their own. An empty table gives no rows. Other columns are not read.
    """
    key = F.col("doc_id")
    ids = docs.select("doc_id").select(descend(root, key).alias("shard"), F.pmod(F.xxhash64(F.lit("slot"), key), F.lit(buckets)).alias("bucket"))
    first = (
        ids.groupBy("shard", "bucket").count()
        .withColumn("first", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count"))
        .select("shard", "bucket", "first")
    )
    rows = docs.select("doc_id", "text").select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(root, key).alias("shard"),
        F.pmod(F.xxhash64(F.lit("slot"), key), F.lit(buckets)).alias("bucket"),
        descend(grown(root, extra), key).alias("grown_shard"),
    )
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(own) - 1)
        .join(F.broadcast(first), ["shard", "bucket"])  # at most shards x buckets rows of 20 bytes
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), "grown_shard")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7; grown_shard: with shard 8 besides."""
    return assign(table(spark, sf_dir, "documents"), tree(8), 8)

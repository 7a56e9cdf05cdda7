"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation several times, once for each turn it had grown by. The prefix of k turns has a rolling
hash: the exclusive or of hashes of (place, role, text), twice, 128 bits in all. A conversation is dropped if its whole
hash is the hash of a proper prefix of another (an anti-join), and of equal ones the smallest conv_id stays. Both sides
of the join hold each hash once, so a first turn or a conversation that a third of all rows share is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm._common import materialize, table

OPEN, CLOSE = "<|", "|>"
END = "<|end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, k, whole (whether k is its last turn), a, b: the two 64-bit halves of the hash of the first k turns."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = [F.col("k"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("k", F.row_number().over(w)).withColumn("whole", F.lead(F.lit(1)).over(w).isNull())
    rows = rows.withColumn("x", F.xxhash64(F.lit("a"), *parts)).withColumn("y", F.xxhash64(F.lit("b"), *parts, F.lit("b")))
    return rows.select("conv_id", "k", "whole", F.bit_xor("x").over(so_far).alias("a"), F.bit_xor("y").over(so_far).alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that prefix no longer one; of equal ones the smallest conv_id."""
    p = materialize(turn_prefixes(turns), "prefixes")
    whole = p.filter("whole").groupBy("k", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    longer = p.filter(~F.col("whole")).select("k", "a", "b").distinct()
    return whole.join(longer, ["k", "a", "b"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"))


def _plain(c: Column) -> Column:
    """Text in which no marker of the format can be read."""
    return F.replace(c, F.lit(OPEN), F.lit("< |"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, n_turns, text: `<|role|>`, a new line, the turn's text and `<|end|>` for every turn, line by line."""
    turn = F.concat(F.lit(OPEN), _plain(F.coalesce("role", F.lit("unknown"))), F.lit(CLOSE + "\n"), _plain(F.coalesce("text", F.lit(""))), F.lit(END))
    rows = turns.select("conv_id", "turn", "role", "text").join(kept.select(F.col("conv_id").alias("id")), F.col("conv_id").eqNullSafe(F.col("id")), "left_semi")
    rows = rows.select("conv_id", F.struct("turn", "role", "text", turn.alias("said")).alias("t"))
    # one row of the result is one conversation, which its task has to hold
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return out.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", lambda t: t["said"]), "\n").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """The maximal conversations of (conv_id, turn, role, text), rendered.

    Turns are in the order of turn, then role, then text, nulls first; ties and repeated rows are turns of their own. A
    null role is `unknown`, a null text empty, but in hashes null differs from both. Rows without a conv_id make up one
    conversation, whose conv_id is null. Other columns are not read; an empty table gives no rows.
    """
    return render(turns, maximal(turns))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations."""
    return format_chats(table(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH t AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM conversations GROUP BY conv_id),
c AS (SELECT min(conv_id) AS conv_id, l FROM t GROUP BY l)
SELECT conv_id, len(l)::BIGINT AS n_turns,
  array_to_string(list_transform(l, lambda x: '<|' || replace(coalesce(x.r, 'unknown'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(x.t, ''), '<|', '< |') || '<|end|>'), chr(10)) AS text
FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS d WHERE len(d.l) > len(c.l) AND d.l[1:len(c.l)] = c.l)
"""

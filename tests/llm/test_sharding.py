import zlib
from collections import Counter

from siftwell.llm import sharding

SCHEMA = "doc_id long, text string, shard string"


def rows_of(spark, rows, n=8):
    return sharding.assign(spark.createDataFrame(rows, SCHEMA), sharding.tree(n), n).collect()


def test_law_slots_sizes(spark):
    rows = [(i, None if i % 11 == 0 else f"é{i % 5}", "clash") for i in range(4000)] + [(7, "again", "x"), (None, None, None), (None, "", "y")]
    got = rows_of(spark, rows)
    assert len(got) == len(rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and 350 < len(slots) < 650
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert 300 < sum(r.grown_shard == 8 for r in got) < 600
    text = {i: t for i, t, _ in rows[:4000]}
    for r in got:
        if r.doc_id is not None and r.doc_id != 7:
            b = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law) == (len(b) + 1, zlib.crc32(b), "key")
    assert len({r.shard for r in got if r.doc_id == 7}) == 1


def test_the_grown_shards_are_those_of_nine(spark):
    docs = spark.createDataFrame([(i, "t", "") for i in range(500)], SCHEMA)
    a = {r.doc_id: r.grown_shard for r in sharding.assign(docs, sharding.tree(8), 8).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign(docs, sharding.grown(sharding.tree(8), 8), 9).collect()}
    assert a == b


def test_movement_stays_in_the_changed_subtree(spark):
    docs = spark.createDataFrame([(i, "t", "") for i in range(6000)], SCHEMA)
    before = {r.doc_id: r.shard for r in sharding.assign(docs, sharding.tree(8), 8).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign(docs, sharding.tree(8, weights=[1, 1, 1, 1, 1, 1, 1, 3]), 8).collect()}
    moves = Counter((before[i], after[i]) for i in before if before[i] != after[i])
    assert moves and all(b // 4 == 1 for _, b in moves) and not any(a // 4 == 1 and b // 4 == 0 for a, b in moves)


def test_empty(spark):
    assert rows_of(spark, []) == []

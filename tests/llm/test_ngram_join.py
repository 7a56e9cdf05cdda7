import random
import re

import pyarrow as pa
import pytest

from siftwell.llm import ngram_join
from siftwell.llm.ngram_join import Join

SCHEMA = "doc_id long, text string, n long, component string"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, join):
    """Rows that share a doc_id are one node; sets link if the contract's inequality holds."""
    s = [(i, shingles(t, join.words)) for i, t in rows]
    root = {i: i for i, _ in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if i is not None and j is not None and a and b and join.links(len(a & b), len(a), len(b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    out = []
    for i, a in s:
        same = [find(j) for j, b in s if j is not None and b == a] if a else []
        out.append((i, len(a), find(i) if i is not None else min(same, default=None)))
    return sorted(out, key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "İx", "ABC"]
    base = [rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 6, 9, 12, 15, 20, 40, 80, 200])) for _ in range(n // 6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            p = rng.randrange(len(w) + 1)
            kind = rng.random()
            if kind < 0.4 and p < len(w):
                w[p] = rng.choice(vocab)
            elif kind < 0.7:
                w.insert(p, rng.choice(vocab))
            elif p < len(w) > 1:
                del w[p]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize(("join", "seed"), [(Join(3, 90, n=160), 1), (Join(5, 80, n=160), 2), (Join(3, 90, n=10**11), 3)])
def test_components_against_brute_force(spark, join, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (905, "a"), (3, corpus(seed)[3][1]), (None, corpus(seed)[5][1]), (None, "alone here now and more"), (None, None)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    got = sorted(map(tuple, ngram_join.join_components(docs, join).collect()), key=str)
    assert got == brute(rows, join)


@pytest.mark.parametrize("join", [Join(3, 90, n=1000), Join(5, 80, n=1000), Join(3, 90, n=10**12), Join(5, 80, n=10**12)])
def test_every_linked_pair_shares_a_signature(join):
    """The pigeonhole itself: sets at the threshold share a signature, whatever the sizes."""
    rng = random.Random(5)
    import numpy as np

    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(6):
            a = rng.sample(range(1 << 62), size)
            gone = rng.randint(0, size // 4)
            b = a[gone:] + rng.sample(range(1 << 62), rng.randint(0, max(1, size // 5)))
            if not join.links(size - gone, size, len(b)):
                continue
            s = np.concatenate([np.sort(np.array(x, np.uint64)) for x in (a, b)])
            sig, n = ngram_join.signatures(s, np.array([len(a), len(b)]), join)
            assert {*sig[: n[0]].tolist()} & {*sig[n[0] :].tolist()}, (size, len(b))


def test_costs_turn_to_deletions_as_the_corpus_grows():
    few, many = Join(3, 90, n=1000), Join(3, 90, n=10**12)
    band = few.band(30)
    assert few.segments(band)[1] == 0 and many.segments(band)[1] > 0
    for j in (few, many):
        for k in range(60):
            zeros, ones = j.segments(k)
            assert zeros + 2 * ones >= j.reach(k) + 1


def test_shingles_of_slices_and_nulls():
    texts = pa.array(["skip me now", None, "a b c d", "", "a b", "É é b\tc\x0bd", "x" * 10])
    s, n = ngram_join.shingle_sets(texts.slice(1), 3)
    assert n.tolist() == [len(shingles(t, 3)) for t in texts.slice(1).to_pylist()]
    assert ngram_join.shingle_sets(pa.array([], pa.string()), 3)[1].tolist() == []


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g", 1, "x"), (3, "A b c d e f g", 1, "y"), (7, "other words in a text of its own", 2, None), (7, "other words in a text of its own", 2, None), (8, None, None, None), (9, None, 0, ""), (None, "a b c d e f g", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = ngram_join.keep_one(docs, Join())
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[1], rows[2], *rows[4:]], key=str)
    assert ngram_join.keep_one(docs.limit(0), Join()).count() == 0 and ngram_join.join_components(docs.limit(0), Join()).count() == 0


def test_hot_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{i}_{k}" for k in range(60)])) for i in range(50)]
    join = Join(3, 90, n=200)
    docs = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    assert sorted(map(tuple, ngram_join.join_components(docs, join).collect()), key=str) == brute(rows, join)


def links_by_brute_force(rows, join):
    """n_links of each row: the other doc_ids of linked sets, each counted once for each of its sets."""
    s = [(i, frozenset(shingles(t, join.words))) for i, t in rows]
    nodes = {x for x in s if x[0] is not None and x[1]}
    linked = lambda a, b: join.links(len(a & b), len(a), len(b))
    return sorted([(i, None if i is None else sum(linked(a, b) for k, b in nodes if (k, b) != (i, a)) if a else 0) for i, a in s], key=str)


@pytest.mark.parametrize(("join", "seed", "block"), [(Join(3, 90, n=160), 1, 1024), (Join(5, 80, n=160), 2, 4), (Join(3, 90, n=10**11), 3, 16)])
def test_links_against_brute_force(spark, monkeypatch, join, seed, block):
    """All links, those inside a component too, in one block or in many."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rng = random.Random(seed)
    base = [f"v{i}" for i in range(80)]
    group = [(2000 + i, " ".join(base[:p] + [f"x{i}"] + base[p + 1 :])) for i, p in enumerate(rng.choices(range(80), k=60))]
    rows = corpus(seed) + group + [(3000, group[0][1]), (900, None), (901, ""), (903, "A b"), (904, "a B"), (3, corpus(seed)[3][1]), (None, corpus(seed)[5][1]), (None, "alone here"), (None, None)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    got = ngram_join.join_links(docs, join).collect()
    assert sorted([(r.doc_id, r.n_links) for r in got], key=str) == links_by_brute_force(rows, join)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute(rows, join)
    assert max(r.n_links for r in got if r.doc_id is not None and r.doc_id >= 2000) > 1
    assert ngram_join.join_links(docs.limit(0), join).count() == 0


def test_links_query_against_its_sql(spark):
    import duckdb

    from siftwell.llm import registry

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(registry.ORACLE_SQL["op8_ngram_links"])
    got = registry.QUERIES["op8_ngram_links"](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_a_doc_id_with_two_texts_joins_their_classes(spark):
    one, two = "one text of seven words in all", "quite another text that has other words"
    rows = [(5, one), (5, two), (7, one), (3, two), (9, "a third text with no copy at all"), (None, one)]
    docs = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    got = sorted(map(tuple, ngram_join.join_components(docs, Join(3, 90, n=6)).collect()), key=str)
    assert got == brute(rows, Join(3, 90, n=6))
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs, Join(3, 90, n=6)).collect() if r.doc_id is not None) == [3, 9]


def similar(rng, n, size, differ):
    """Texts that share most of their words, of which few or no two link."""
    base = [f"w{i}" for i in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for p in rng.sample(range(size), differ):
            w[p] = f"x{i}_{p}"
        out.append((i, " ".join(w)))
    return out


def test_pairs_of_similar_texts_are_no_rows(spark, monkeypatch):
    """Long texts, whose sketches tell nothing, share signatures and don't link: no table holds their pairs."""
    rows = similar(random.Random(4), 40, 6000, 150)
    written, kept = {}, ngram_join.materialize

    def counted(df, label, *args):
        out = kept(df, label, *args)
        if {"a_x", "a_y"} <= set(out.columns) or {"u", "v"} <= set(out.columns):
            written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    docs = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    assert {(r.doc_id, r.component_id) for r in ngram_join.join_components(docs, Join(3, 90, n=40)).collect()} == {(i, i) for i, _ in rows}
    assert written and max(written.values()) <= len(rows), written


def test_buckets_in_many_blocks(spark, monkeypatch):
    """Blocks and chunks of a few rows find what brute force finds."""
    for name, most in (("BUCKET_ROWS", 4), ("BLOCK_SETS", 4), ("PAIRS", 16)):
        monkeypatch.setattr(ngram_join, name, most)
    rng = random.Random(6)
    rows = corpus(6) + [(1000 + i, t) for i, (_, t) in enumerate(similar(rng, 40, 120, 2) + similar(rng, 40, 300, 5))]
    join = Join(3, 90, n=240)
    docs = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    assert sorted(map(tuple, ngram_join.join_components(docs, join).collect()), key=str) == brute(rows, join)


def test_signatures_of_a_large_corpus_are_written_in_slices(spark, monkeypatch):
    """With millions of documents segments allow differences and signatures are many: no table holds more than a slice."""
    join = Join(5, 80, n=100_000_000)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(500)], k=300))) for i in range(10)] + similar(rng, 30, 300, 8)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    most, kept = [], ngram_join.materialize

    def counted(df, label, *args):
        out = kept(df, label, *args)
        if "sigs" in out.columns:
            most.append(out.selectExpr("sum(size(sigs)) / sum(n)").first()[0])
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    docs = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    assert sorted(map(tuple, ngram_join.join_components(docs, join).collect()), key=str) == brute(rows, join)
    assert len(most) > 2 and max(most) < 0.6, most

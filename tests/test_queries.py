"""Every query against its SQL at the smallest scale, and the stream."""

import glob
import os

import duckdb
import pytest

from siftwell.queries import QUERIES, SQL, snapshot

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    want = con.sql(SQL[name])
    assert sorted(want.columns) == cols
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(rows, key=key) == sorted(want.select(*cols).fetchall(), key=key)


@pytest.mark.parametrize(("name", "sql", "descending"), [("k07_sort_missing_all", "SELECT count(*) FROM documents", False), ("k10_multi_valued_sort_all", "SELECT count(DISTINCT l_orderkey) FROM lineitem", True)])
def test_full_sorts(spark, con, name, sql, descending):
    """Every candidate in order, ties to smaller doc_ids; real values are among them."""
    rows = [(r.value, r.doc_id) for r in QUERIES[name](spark, SF).collect()]
    assert len(rows) == con.sql(sql).fetchall()[0][0] and len({v for v, _ in rows}) > 2
    assert rows == sorted(rows, key=lambda r: (-r[0] if descending else r[0], r[1]))


def test_one_scan_and_one_shuffle(spark):
    """A boolean query scans the postings once and groups once; its term filters reach the scan."""
    from siftwell.plans.compiler import Compiler
    from siftwell.plans.query import Boolean, Term

    c = Boolean(must=(Term("body", "the"),), should=(Term("body", "of"), Term("body", "with")))
    plan = Compiler(snapshot(spark, SF)).compile(c)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1 and "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_bounds_leave_out_light_terms():
    from siftwell.operators.maxscore import split, weights
    from siftwell.plans.query import Boolean, Boost, Term

    a, b, c = Term("f", "a"), Term("f", "b"), Term("f", "c")
    assert weights(Boolean(should=(a, Boost(b, 2), Boost(Boolean(should=(a, c)), 3)))) == {("f", "a"): 4.0, ("f", "b"): 2.0, ("f", "c"): 3.0}
    assert weights(Boolean(must=(a,))) is None and weights(Boost(a, -1)) is None
    assert split({"x": 3.0, "y": 0.5, "z": 0.4}, 1.0) == (["x"], ["z", "y"]) and split({"x": 3.0, "y": 0.5}, 0.5) == (["x", "y"], [])


@pytest.mark.parametrize("n", [1, 3, 10, 100_000])
def test_search_by_bounds(spark, n):
    """The same best hits as the plain search, for boosts that make one term heavy and for none; clauses of other kinds, too."""
    from siftwell.plans.query import Boolean, Boost, Term
    from siftwell.searcher import Searcher

    s = Searcher(snapshot(spark, SF))
    of = lambda w: Term("body", w)
    for c in (Boolean(should=(of("the"), Boost(of("with"), 20))), Boolean(should=(of("the"), of("of"), of("absent"))), Boolean(must=(of("the"),), should=(of("of"),)), of("the")):
        plain, short = ([(r.doc_id, round(r.score, 9)) for r in s.search(c, n, by_bounds=b).collect()] for b in (False, True))
        assert plain == short


def test_stream(spark, tmp_path):
    from siftwell.searcher import Searcher
    from siftwell.plans.query import MatchAll, Term
    from siftwell.sources.index import FieldSpec, Index, IndexSchema, MergePolicy
    from siftwell.streaming.ingest import ingest

    for k in range(3):
        spark.createDataFrame([(10 * k + i, f"word{i} batch{k}") for i in range(4)], "doc_id long, body string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    index = Index.open(spark, f"{tmp_path}/ix", IndexSchema((FieldSpec("body"),)))
    stream = spark.readStream.schema("doc_id long, body string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = ingest(stream, index, f"{tmp_path}/ck", MergePolicy(at_once=2, per_tier=2, floor=1))
    q.awaitTermination(120)
    s = Searcher(index.snapshot())
    assert s.count(MatchAll()) == 12 and [r.doc_id for r in s.ids(Term("body", "batch1")).collect()] == [10, 11, 12, 13]
    assert len(index.commit_at().segments) == 2

"""Golden values of the five-document corpus, and the index's life."""

import pytest

from siftwell.operators import collect, facets, suggest, vectors
from siftwell.plans.query import Boolean, Boost, ConstantScore, DisjunctionMax, Fuzzy, MatchAll, MatchNone, Phrase, Prefix, Range, Regexp, SpanNear, SpanOr, SpanTerm, Term, TermInSet, Wildcard, rewrite
from siftwell.functions.patterns import PatternError
from siftwell.searcher import QueryCache, Searcher
from siftwell.sources.index import FieldSpec, Index, IndexSchema, MergePolicy, Segment, SortKey

BODY = [(0, "cat cat dog", 5, ["a", "b"]), (1, "dog bird", None, ["b"]), (2, "cat", 7, None), (3, None, 1, ["c", "a"]), (4, "bird bird bird", 7, [])]
SCHEMA = "doc_id long, body string, v long, tags array<string>"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    ix = Index.open(spark, f"{tmp_path_factory.mktemp('ix')}/body", IndexSchema((FieldSpec("body"),)))
    ix.add(spark.createDataFrame(BODY, SCHEMA))
    ix.commit()
    return ix


@pytest.fixture(scope="module")
def search(index):
    return Searcher(index.snapshot())


def t(x):
    return Term("body", x)


def ids(search, c):
    return [r.doc_id for r in search.ids(c).collect()]


def scores(search, c):
    return {r.doc_id: pytest.approx(r.score, rel=1e-6) for r in search.hits(c).collect()}


def test_statistics(index):
    s = index.snapshot()
    assert s.field_stats["body"] == dict(doc_count=4, n_terms=3, sum_df=6, sum_ttf=9, live=4, sum_length=9, field="body") or s.field_stats["body"]["doc_count"] == 4
    assert {(r.term, r.df, r.ttf) for r in s.terms.collect()} == {("cat", 2, 3), ("dog", 2, 2), ("bird", 2, 4)}
    assert s.mean_length("body") == 9 / 4
    assert [r.term for r in s.seek_ceil("body", "c", 2).collect()] == ["cat", "dog"] and s.seek_floor("body", "c").first().term == "bird"
    assert {(r.term, r.freq) for r in s.term_vector(0, "body").collect()} == {("cat", 2), ("dog", 1)}


CASES = [
    (t("cat"), [0, 2]), (t("dog"), [0, 1]), (t("none"), []), (Term("nofield", "cat"), []),
    (TermInSet("body", ("cat", "cat", "dog")), [0, 1, 2]), (TermInSet("body", ()), []),
    (Prefix("body", "b"), [1, 4]), (Prefix("body", ""), [0, 1, 2, 4]), (Prefix("body", "a*b?c"), []),
    (Wildcard("body", "ca?"), [0, 2]), (Wildcard("body", "*"), [0, 1, 2, 4]), (Wildcard("body", "do\\*"), []), (Wildcard("body", "do\\g"), [0, 1]),
    (Regexp("body", "ca"), []), (Regexp("body", "do*g"), [0, 1]), (Regexp("body", "bi+rd"), [1, 4]), (Regexp("body", "[cb]at"), [0, 2]), (Regexp("body", "cat|dog"), [0, 1, 2]), (Regexp("body", "bi{1,}rd"), [1, 4]),
    (Fuzzy("body", "cta", 1), [0, 2]), (Fuzzy("body", "cta", 1, transpositions=False), []), (Fuzzy("body", "dat", 1, 1), []), (Fuzzy("body", "dat", 1), [0, 2]), (Fuzzy("body", "cog", 2, max_expansions=1), [0, 2]),
    (Phrase("body", ("cat", "dog")), [0]), (Phrase("body", ("dog", "cat")), []), (Phrase("body", ()), []), (Phrase("body", ("cat",)), [0, 2]), (Phrase("body", ("bird", "bird")), [4]),
    (MatchAll(), [0, 1, 2, 3, 4]), (MatchNone("x"), []), (Range.of("v", 5, 7), [0, 2, 4]), (Range.of("v", None, None), [0, 2, 3, 4]), (Range.of("tags", "b", "b"), [0, 1]), (Range.of("tags", "b", None, "max"), [0, 1, 3]), (Range(("v", "tags"), (1, "a"), (5, "a")), [0, 3]),
    (Boolean(must=(t("cat"),), must_not=(t("dog"),)), [2]), (Boolean(must_not=(t("dog"),)), []), (Boolean(should=(t("cat"), t("bird"))), [0, 1, 2, 4]), (Boolean(should=(t("cat"), t("dog")), min_should=2), [0]), (Boolean(should=(t("cat"), t("cat")), min_should=2), [0, 2]), (Boolean(must=(t("cat"),), should=(t("dog"),), min_should=2), []), (Boolean(must=(MatchAll(),), must_not=(t("bird"),)), [0, 2, 3]), (Boolean(must=(Range.of("v", 7, 9), t("cat"))), [2]),
    (DisjunctionMax((t("cat"), t("bird"))), [0, 1, 2, 4]), (DisjunctionMax(()), []),
    (SpanTerm("body", "cat"), [0, 2]), (SpanOr((SpanTerm("body", "cat"), SpanTerm("body", "bird"))), [0, 1, 2, 4]), (SpanNear((SpanTerm("body", "dog"), SpanTerm("body", "cat"))), []), (SpanNear((SpanTerm("body", "dog"), SpanTerm("body", "cat")), 0, False), [0]), (SpanNear((SpanOr((SpanTerm("body", "cat"), SpanTerm("body", "dog"))), SpanTerm("body", "bird"))), [1]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_matches(search, k):
    assert ids(search, CASES[k][0]) == CASES[k][1], CASES[k][0]


def test_bad_patterns(search):
    for p in ("a{2,1}", "[", "(a", "*a", "a)", "[b-a]"):
        with pytest.raises(PatternError):
            search.hits(Regexp("body", p))


def test_scores(search):
    assert scores(search, DisjunctionMax((t("cat"), t("dog")), 0.3)) == {0: 0.47926182, 1: 0.33007008, 2: 0.40773362}
    plain = {r.doc_id: r.score for r in search.hits(t("cat")).collect()}
    assert scores(search, Boost(t("cat"), 2.5)) == {k: 2.5 * v for k, v in plain.items()}
    assert scores(search, ConstantScore(t("cat"), 0.5)) == {0: 0.5, 2: 0.5}
    assert scores(search, Boolean(must=(t("cat"),), should=(t("cat"),))) == {k: 2 * v for k, v in plain.items()}
    assert scores(search, Prefix("body", "c")) == {0: 1.0, 2: 1.0}
    assert [r.doc_id for r in search.search(t("cat"), 1).collect()] == [2] and search.search(t("cat"), 0).count() == 0 and search.count(t("cat")) == 2


def test_slop_and_spans_over_a_gap(spark, tmp_path):
    ix = Index.open(spark, f"{tmp_path}/ix", IndexSchema((FieldSpec("body"),)))
    ix.add(spark.createDataFrame([(1, "alpha x y beta"), (2, "delta gamma")], "doc_id long, body string"))
    ix.commit()
    s = Searcher(ix.snapshot())
    for slop in range(6):
        want = [1] if slop >= 2 else []
        assert ids(s, Phrase("body", ("alpha", "beta"), slop)) == want
        assert ids(s, SpanNear((SpanTerm("body", "alpha"), SpanTerm("body", "beta")), slop)) == want
    near = lambda order: SpanNear((SpanTerm("body", "gamma"), SpanTerm("body", "delta")), 0, order)
    assert ids(s, near(True)) == [] and ids(s, near(False)) == [2] and ids(s, SpanOr((SpanTerm("body", "gamma"), SpanTerm("body", "delta")))) == [2]


def test_rewrite_keeps_results(search):
    c = Boolean(must=(Boolean(should=(t("cat"),)),), should=(Boolean(must=(t("dog"),)), t("dog")), must_not=(t("bird"), t("bird")))
    assert rewrite(Boolean(should=(Boolean(must=(t("cat"),)),))) == t("cat") and len(rewrite(c).must_not) == 1
    assert rewrite(Boolean(must_not=(t("a"),))) == Boolean(must_not=(t("a"),)) and rewrite(Boolean(should=(t("a"),), min_should=2)).min_should == 2


def test_explanations_agree_with_scores(search):
    phrase = Phrase("body", ("cat", "dog"))
    for c in (t("cat"), phrase, Boolean(must=(t("cat"),), should=(t("dog"),)), DisjunctionMax((t("cat"), t("dog")), 0.3), Boost(t("cat"), 3), ConstantScore(t("cat"), 4), Prefix("body", "c"), MatchAll(), Range.of("v", 1, 9), SpanTerm("body", "cat")):
        e = search.explain(c, 0)
        assert e.matched and e.value == scores(search, c)[0]
    assert search.explain(phrase, 0).details[0].details[1].details[0].value == 1.0
    for c in (t("zzz"), t("bird"), MatchNone(), Boolean(must_not=(t("cat"),)), Boolean(must=(t("cat"),), must_not=(t("dog"),)), DisjunctionMax(()), Phrase("body", ()), ConstantScore(t("bird"))):
        e = search.explain(c, 0)
        assert not e.matched and e.value == 0.0
    assert search.explain(t("cat"), 0).rows()[0][3] == "weight(body:cat), result of:"


def test_sorts_collapse_facets(search, spark):
    docs = search.index.documents
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(search.sorted_by(MatchAll(), "v")) == [(3, 1), (0, 5), (2, 7), (4, 7)]
    assert rows(search.sorted_by(MatchAll(), "v", 2, descending=True)) == [(2, 7), (4, 7)]
    assert rows(search.sorted_by(MatchAll(), "v", missing=6)) == [(3, 1), (0, 5), (1, 6), (2, 7), (4, 7)]
    assert rows(search.sorted_by(MatchAll(), "tags", selector="max")) == [(0, "b"), (1, "b"), (3, "c")]
    got = rows(search.collapsed(MatchAll(), "v"))
    assert [r[0] for r in got] == [0, 1, 2, 3]
    assert sorted(rows(search.facets(t("cat"), "tags"))) == [("a", 1), ("b", 1), ("c", 0)]
    assert rows(search.facets(MatchAll(), "tags", 2)) == [("a", 2), ("b", 2)]
    assert rows(facets.labels(docs, "tags").orderBy("ord")) == [(0, "a"), (1, "b"), (2, "c")]
    r = facets.NumericRange
    ranges = [r("low", None, 5), r("all"), r("open", 5, 7, False, False), r("none", 100)]
    assert rows(search.range_facets(MatchAll(), "v", ranges)) == [(0, "low", 2), (1, "all", 4), (2, "open", 0), (3, "none", 0)]
    assert [x.count for x in facets.range_facets(docs.limit(0), "v", ranges).select("count").collect()] and rows(facets.range_facets(docs.limit(0), "v", ranges))[1][2] == 0
    a, b = search.hits(t("cat")), search.hits(t("dog"))
    assert {x[0] for x in rows(collect.union_docs(a, b))} == {0, 1, 2} and rows(collect.common_docs(a, b)) == [(0,)] and rows(collect.without_docs(a, b)) == [(2,)]


def test_vectors_and_suggestions(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0])], "doc_id long, vector array<double>")
    top = lambda kind: [(r.doc_id, round(r.score, 6)) for r in vectors.nearest(v, [1.0, 0.0], 4, kind).collect()]
    assert top("cosine") == [(1, 1.0), (4, 1.0), (2, 0.5), (3, 0.5)] and top("dot") == [(4, 1.5), (1, 1.0), (2, 0.5), (3, 0.5)]
    assert top("euclidean")[0] == (1, 1.0) and top("inner_product")[0] == (4, 3.0)
    s = suggest.suggester(spark.createDataFrame([("cat", 5, 0), ("cab", 5, 1), ("cat", 9, 2), ("car", 7, 3), ("dog", 9, 4)], "term string, weight long, o long"), "o")
    assert [tuple(r) for r in suggest.completions(s, "ca", 2).collect()] == [("r", 7), ("b", 5)]


def test_life_of_an_index(spark, tmp_path):
    schema = IndexSchema((FieldSpec("body"),), soft_deletes="gone")
    ix = Index.open(spark, f"{tmp_path}/ix", schema)
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, body string, v long, gone long")
    ix.add(df([(1, "red apple", 1, None), (2, "green apple", 2, None)]))
    assert ix.pending_count() == 2 and ix.committed_count() == 0 and Searcher(ix.snapshot()).count(MatchAll()) == 0
    ix.commit()
    old = ix.snapshot()
    assert ix.open_if_changed(old) is None
    ix.add(df([(9, "dropped", 0, None)]))
    ix.rollback()
    ix.add(df([(3, "blue plum", 3, None), (4, "red plum", 4, None)]))
    ix.commit()
    new = ix.open_if_changed(old)
    assert new is not None and ids(Searcher(new), t("red")) == [1, 4] and ids(Searcher(old), t("red")) == [1]
    ix.delete(t("green"))
    assert ids(Searcher(ix.snapshot()), MatchAll()) == [1, 3, 4] and ix.committed_count() == 3
    ix.update(t("blue"), df([(3, "blue pear", 33, None)]))
    s = Searcher(ix.snapshot())
    assert ids(s, t("blue")) == [3] and ids(s, t("plum")) == [4] and ids(s, Range.of("v", 30, 40)) == [3]
    ix.update_values("v", spark.createDataFrame([(1, 100), (4, None)], "doc_id long, value long"))
    ix.update_values("v", spark.createDataFrame([(1, 101)], "doc_id long, value long"))
    assert [tuple(r) for r in Searcher(ix.snapshot()).sorted_by(MatchAll(), "v").collect()] == [(3, 33), (1, 101)]
    ix.soft_delete(t("red"))
    assert ids(Searcher(ix.snapshot()), MatchAll()) == [3] and ids(Searcher(ix.snapshot()), t("red")) == []
    assert all(ok for *_, ok in ix.check()) and all(ok for *_, ok in ix.verify())
    ix.delete(Range.of("v", 33, 33))
    ix.force_merge(1)
    assert len(ix.commit_at().segments) == 1 and ix.committed_count() == 2 and all(ok for *_, ok in ix.check())
    assert Index.open(spark, f"{tmp_path}/ix").schema == schema
    ix.add_term_frequencies(df([(50, None, 5, None)]), spark.createDataFrame([(50, "body", "given", 7)], "doc_id long, field string, term string, freq int"))
    assert ids(Searcher(ix.snapshot()), t("given")) == [50]
    with pytest.raises(FileExistsError):
        ix.files.publish(f"{ix.path}/schema.json", "{}")


def test_segments_scope_cache_deadline(spark, tmp_path):
    ix = Index.open(spark, f"{tmp_path}/ix", IndexSchema((FieldSpec("body"),)))
    for part in (BODY[:2], BODY[2:]):
        ix.add(spark.createDataFrame(part, SCHEMA))
        ix.commit()
    s = ix.snapshot()
    whole, parts = Searcher(s), Searcher(s, scope="segment")
    assert scores(whole, DisjunctionMax((t("cat"), t("dog")), 0.3)) == {0: 0.47926182, 1: 0.33007008, 2: 0.40773362}
    assert ids(parts, t("cat")) == ids(whole, t("cat")) and scores(parts, t("cat")) != scores(whole, t("cat"))
    cache = QueryCache(1)
    a = cache.hits(whole, t("cat"))
    assert cache.hits(whole, t("cat")) is a and cache.hits(whole, t("dog")) is not a and len(cache.kept) == 1
    cache.clear()
    rows, late = whole.search_within(t("cat"), 5, 600)
    assert [r.doc_id for r in rows] and not late


def test_sorted_segments_and_policies(spark, tmp_path):
    ix = Index.open(spark, f"{tmp_path}/ix", IndexSchema((FieldSpec("body"),), sort=(SortKey("v", True, True),)))
    ix.add(spark.createDataFrame(BODY, SCHEMA).coalesce(1))
    ix.commit()
    s = ix.commit_at().segments[0]
    assert [r.v for r in ix.read(s, "documents").coalesce(1).collect()] in ([None, 7, 7, 5, 1],)
    seg = [Segment(f"s{k}", 100, (k + 1) << 20, del_count=20 * (k == 3)) for k in range(12)]
    p = MergePolicy()
    assert len(p.find_merges(seg)) == 1 and len(p.find_merges(seg)[0]) == 10 and p.find_merges(seg[:10]) == [] and p.find_merges(seg)[0][0] == "s3"
    assert p.find_forced_merges(seg, 3) == [[f"s{k}" for k in range(10)]] and p.find_delete_merges(seg) == [["s3"]]

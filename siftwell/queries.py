"""The engine's queries by name, each over the whole tables of a folder, and the same in DuckDB's SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.batches import Batches, Change, column, slices, without_nulls
from siftwell.functions.similarity import Bm25
from siftwell.functions.text import ENGLISH_STOP_WORDS, Analyzer, Token, fold, ngrams, stop
from siftwell.operators import collect, facets, maxscore, suggest, vectors
from siftwell.plans.compiler import range_condition
from siftwell.plans.query import Boolean, Boost, Clause, ConstantScore, DisjunctionMax, Fuzzy, MatchAll, MatchNone, Phrase, Prefix, Range, Regexp, SpanNear, SpanOr, SpanTerm, Term, TermInSet, Wildcard, rewrite
from siftwell.searcher import Searcher
from siftwell.sources.files import scratch
from siftwell.sources.index import FieldSpec, Index, IndexSchema, MergePolicy, Snapshot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_open: dict[tuple[str, str], Snapshot] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The index of the documents in a folder, built once in a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _open:
        path = f"{scratch(spark)}/index-{hashlib.sha256(repr(key).encode()).hexdigest()[:16]}"
        index = Index.open(spark, path, IndexSchema((FieldSpec("body", "text", Analyzer.simple()),)))
        if not index.last_generation():
            index.add(table(spark, sf_dir, "documents"))
            index.commit()
        _open[key] = index.snapshot()
    return _open[key]


def searcher(spark: SparkSession, sf_dir: str, **how) -> Searcher:
    return Searcher(snapshot(spark, sf_dir), **how)


#: Tables of the SQL side: p (doc_id, term, freq, ps: positions), n (doc_id, dl), sc (doc_id, term, ps, freq, dl, idf, s: score).
CTE = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM w),
p AS (SELECT doc_id, term, count(*) AS freq, list(pos ORDER BY pos) AS ps FROM tok GROUP BY doc_id, term),
n AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY doc_id),
st AS (SELECT count(*) AS dc, avg(dl) AS mean FROM n),
df AS (SELECT term, count(*) AS df, sum(freq)::BIGINT AS ttf FROM p GROUP BY term),
sc AS (SELECT p.doc_id, p.term, ps, freq, dl, mean, ln(1 + (dc - df + 0.5) / (df + 0.5)) AS idf, ln(1 + (dc - df + 0.5) / (df + 0.5)) * freq / (freq + 1.2 * (0.25 + 0.75 * dl / mean)) AS s
  FROM p JOIN n USING (doc_id) JOIN df USING (term) CROSS JOIN st)
"""


def query(name: str, sql: str | None = None, cte: bool = True):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (CTE if cte else "") + sql
        return f

    return put


def rounded(hits: DataFrame, n: int | None = None) -> DataFrame:
    hits = hits.select("doc_id", F.round("score", 6).alias("score"))
    return hits if n is None else collect.top_docs(hits, n)


def t(term: str) -> Term:
    return Term("body", term)


def _hits(name: str, clause: Clause, sql: str) -> None:
    """A query for the ids and scores of a clause's matches."""
    query(name, sql)(lambda s, d: rounded(searcher(s, d).hits(clause)))


def _docs(where: str, score: str = "1.0::DOUBLE") -> str:
    return f"SELECT DISTINCT doc_id, {score} AS score FROM p WHERE {where}"


THE, OF, WITH = "SELECT doc_id, s FROM sc WHERE term = 'the'", "SELECT doc_id, s FROM sc WHERE term = 'of'", "SELECT doc_id, s FROM sc WHERE term = 'with'"
ABC = f"a AS ({THE}), b AS ({OF}), c AS ({WITH}), u AS (SELECT doc_id, a.s AS sa, b.s AS sb, c.s AS sc_ FROM a FULL JOIN b USING (doc_id) FULL JOIN c USING (doc_id))"
TOP10 = "ORDER BY score DESC, doc_id LIMIT 10"

# leaves
_hits("q01_term", t("the"), "SELECT doc_id, round(s, 6) AS score FROM sc WHERE term = 'the'")
_hits("q02_term_in_set", TermInSet("body", ("the", "und", "the", "stupid")), _docs("term IN ('the', 'und', 'stupid')"))
_hits("q03_prefix", Prefix("body", "sh"), _docs("starts_with(term, 'sh')"))
_hits("q04_wildcard", Wildcard("body", "t?e*ing"), _docs("regexp_full_match(term, '(?s)t.e.*ing')"))
_hits("q05_fuzzy_transpositions", Fuzzy("body", "teh", 1, 1), "SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM p WHERE term IN (SELECT term FROM df WHERE damerau_levenshtein(regexp_replace(term, '[^ -~]', '~', 'g'), 'teh') <= 1 AND starts_with(term, 't') ORDER BY term LIMIT 50)")
_hits("q05_fuzzy_edits", Fuzzy("body", "worthles", 2, transpositions=False), "SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM p WHERE term IN (SELECT term FROM df WHERE levenshtein(regexp_replace(term, '[^ -~]', '~', 'g'), 'worthles') <= 2 ORDER BY term LIMIT 50)")
_hits("q06_regexp", Regexp("body", "(an|the)+[a-f]{1,3}"), _docs("regexp_full_match(term, '(?:an|the)+[a-f]{1,3}')"))
#: h: positions of 'of' and 'the' alone; i: their idf together.
OF_THE = """h AS MATERIALIZED (SELECT doc_id, term, pos FROM tok WHERE term IN ('of', 'the')),
i AS (SELECT sum(ln(1 + (dc - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM h GROUP BY term) CROSS JOIN st),
m AS MATERIALIZED (SELECT a.doc_id, a.pos AS a, b.pos AS b FROM h AS a JOIN h AS b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 WHERE a.term = 'of' AND b.term = 'the')"""
PHRASE = f"{OF_THE}, x AS (SELECT doc_id, idf, f, dl, mean FROM (SELECT doc_id, count(*) AS f FROM m WHERE b = a + 1 GROUP BY doc_id) JOIN n USING (doc_id) CROSS JOIN st CROSS JOIN i)"
_hits("q07_phrase", Phrase("body", ("of", "the")), f", {PHRASE} SELECT doc_id, round(idf * f / (f + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM x WHERE f > 0")
_hits("q08_sloppy_phrase", Phrase("body", ("of", "the"), 2), f", {OF_THE}, x AS (SELECT doc_id, idf, dl, mean FROM (SELECT DISTINCT doc_id FROM m) JOIN n USING (doc_id) CROSS JOIN st CROSS JOIN i) SELECT doc_id, round(idf / (1 + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM x")
_hits("q09_span_term", SpanTerm("body", "the"), _docs("term = 'the'"))
_hits("q10_span_near", SpanNear((SpanTerm("body", "the"), SpanTerm("body", "of")), 1, False), "SELECT DISTINCT a.doc_id, 1.0::DOUBLE AS score FROM tok AS a JOIN tok AS b USING (doc_id) WHERE a.term = 'the' AND b.term = 'of' AND abs(a.pos - b.pos) BETWEEN 1 AND 2")
_hits("q11_span_or", SpanNear((SpanOr((SpanTerm("body", "the"), SpanTerm("body", "with"))), SpanTerm("body", "of"))), "SELECT DISTINCT a.doc_id, 1.0::DOUBLE AS score FROM tok AS a JOIN tok AS b USING (doc_id) WHERE a.term IN ('the', 'with') AND b.term = 'of' AND b.pos = a.pos + 1")
_hits("q13_points_range", Range(("n_chars", "doc_id"), (200, 10), (3000, 600)), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE n_chars BETWEEN 200 AND 3000 AND doc_id BETWEEN 10 AND 600")
_hits("q14_match_all", MatchAll(), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents")
_hits("q15_match_none", MatchNone("as asked"), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE false")
_hits("q16_numeric_range", Range.of("n_chars", 1000, 2000), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE n_chars BETWEEN 1000 AND 2000")
_hits("q18_ordinal_range", Range.of("lang", "de", "es"), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE lang BETWEEN 'de' AND 'es'")


@query("q17_range_with_statistics", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 100 AND 900", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem")
    return rows.filter(range_condition(Range.of("l_orderkey", 100, 900), rows)).select("l_orderkey", "l_linenumber")


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("long"))).alias("lines"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))


@query("q19_multi_valued_range", "SELECT l_orderkey AS doc_id FROM lineitem GROUP BY 1 HAVING max(l_linenumber) BETWEEN 3 AND 5", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = _orders(s, d)
    return rows.filter(range_condition(Range.of("lines", 3, 5, "max"), rows)).select("doc_id")


# compound clauses
_hits("c01_boolean", Boolean(must=(t("the"),), should=(t("of"),), must_not=(t("with"),)), f", {ABC} SELECT doc_id, round(sa + coalesce(sb, 0), 6) AS score FROM u WHERE sa IS NOT NULL AND sc_ IS NULL")
_hits("c01_pure_negation", Boolean(must_not=(t("the"),)), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE false")
_hits("c02_min_should", Boolean(should=(t("the"), t("of"), t("with")), min_should=2), f", {ABC} SELECT doc_id, round(coalesce(sa, 0) + coalesce(sb, 0) + coalesce(sc_, 0), 6) AS score FROM u WHERE (sa IS NOT NULL)::INT + (sb IS NOT NULL)::INT + (sc_ IS NOT NULL)::INT >= 2")
_hits("c03_dismax", DisjunctionMax((t("the"), t("of")), 0.3), f", {ABC} SELECT doc_id, round(greatest(coalesce(sa, 0), coalesce(sb, 0)) + 0.3 * least(coalesce(sa, 0), coalesce(sb, 0)), 6) AS score FROM u WHERE sa IS NOT NULL OR sb IS NOT NULL")
_hits("c04_constant_score", ConstantScore(t("the"), 2.5), _docs("term = 'the'", "2.5::DOUBLE"))
_hits("c05_boost", Boost(t("the"), 3.0), "SELECT doc_id, round(s * 3, 6) AS score FROM sc WHERE term = 'the'")
_hits("c06_nested", Boolean(must=(Boolean(should=(t("the"), Boost(t("of"), 2))), Range.of("n_chars", 500, 50_000))), f", {ABC} SELECT doc_id, round(coalesce(sa, 0) + 2 * coalesce(sb, 0) + 1, 6) AS score FROM u JOIN documents USING (doc_id) WHERE (sa IS NOT NULL OR sb IS NOT NULL) AND n_chars BETWEEN 500 AND 50000")
_hits("c07_rewrite", rewrite(Boolean(must=(Boolean(should=(Boolean(must=(t("the"),)),)),))), "SELECT doc_id, round(s, 6) AS score FROM sc WHERE term = 'the'")


@query("c08_set_algebra", "SELECT doc_id FROM p WHERE term = 'the' AND doc_id IN (SELECT doc_id FROM p WHERE term IN ('of', 'by')) AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'with')")
def _(s: SparkSession, d: str) -> DataFrame:
    h = searcher(s, d).hits
    return collect.without_docs(collect.common_docs(h(t("the")), collect.union_docs(h(t("of")), h(t("by")))), h(t("with")))


# scoring
@query("s03_custom_parameters", f"SELECT doc_id, round(idf * freq / (freq + 2.0 * (0.5 + 0.5 * dl / mean)), 6) AS score FROM sc WHERE term = 'the' {TOP10}")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(searcher(s, d, bm25=Bm25(2.0, 0.5)).hits(t("the")), 10)


ROUNDED = "CASE WHEN dl < 24 THEN dl ELSE 24 + ((dl - 24) >> greatest(length(bin(dl - 24)) - 4, 0)::INT << greatest(length(bin(dl - 24)) - 4, 0)::INT) END"


@query("s04_rounded_lengths", f", r AS (SELECT doc_id, {ROUNDED} AS rl FROM n), m AS (SELECT avg(rl) AS rm FROM r) SELECT doc_id, round(idf * freq / (freq + 1.2 * (0.25 + 0.75 * rl / rm)), 6) AS score FROM sc JOIN r USING (doc_id) CROSS JOIN m WHERE term = 'the'")
def _(s: SparkSession, d: str) -> DataFrame:
    x = snapshot(s, d)
    return rounded(Searcher(Snapshot(x.index, x.commit, exact_lengths=False)).hits(t("the")))


@query("s06_term_top10", f"SELECT doc_id, round(s, 6) AS score FROM sc WHERE term = 'the' {TOP10}")
def term_top10(s: SparkSession, d: str) -> DataFrame:
    return rounded(searcher(s, d).hits(t("the")), 10)


@query("s07_phrase_top10", f", {PHRASE} SELECT doc_id, round(idf * f / (f + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM x WHERE f > 0 {TOP10}")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(searcher(s, d).hits(Phrase("body", ("of", "the"))), 10)


@query("s08_boolean_top10", f", {ABC} SELECT doc_id, round(coalesce(sa, 0) + coalesce(sb, 0) + coalesce(sc_, 0), 6) AS score FROM u {TOP10}")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(searcher(s, d).hits(Boolean(should=(t("the"), t("of"), t("with")))), 10)


@query("s11_maxscore_top10", f", {ABC} SELECT doc_id, round(coalesce(sa, 0) + coalesce(sb, 0) + coalesce(sc_, 0), 6) AS score FROM u {TOP10}")
def _(s: SparkSession, d: str) -> DataFrame:
    """The rows of s08_boolean_top10, by bounds; what rounding makes equal to the tenth is among the contenders."""
    return rounded(maxscore.contenders(snapshot(s, d), Boolean(should=(t("the"), t("of"), t("with"))), 10, slack=1e-6), 10)


@query("s11_maxscore_boosted", f", {ABC} SELECT doc_id, round(coalesce(sa, 0) + 4 * coalesce(sc_, 0), 6) AS score FROM u WHERE sa IS NOT NULL OR sc_ IS NOT NULL {TOP10}")
def _(s: SparkSession, d: str) -> DataFrame:
    """A light and a heavy term: the light one's postings are read for few documents."""
    return rounded(maxscore.contenders(snapshot(s, d), Boolean(should=(t("the"), Boost(t("with"), 4))), 10, slack=1e-6), 10)


@query("s12_explain", f"SELECT doc_id, round(s, 6) AS value, 'weight(body:the), result of:' AS description FROM sc WHERE term = 'the' ORDER BY round(s, 6) DESC, doc_id LIMIT 1")
def _(s: SparkSession, d: str) -> DataFrame:
    e = searcher(s, d)
    best = rounded(e.hits(t("the")), 1).first()
    found = e.explain(t("the"), best["doc_id"]) if best else None
    return s.createDataFrame([(best["doc_id"], round(found.value, 6), found.description)] if found else [], "doc_id long, value double, description string")


# collectors
@query("k02_ids", "SELECT doc_id FROM p WHERE term = 'the'")
def _(s: SparkSession, d: str) -> DataFrame:
    return searcher(s, d).ids(t("the"))


@query("k03_count", "SELECT count(*) AS hits FROM p WHERE term = 'the'")
def _(s: SparkSession, d: str) -> DataFrame:
    return searcher(s, d).hits(t("the")).agg(F.count("*").alias("hits"))


@query("k05_top_by_field", "SELECT doc_id, n_chars AS value FROM documents JOIN p USING (doc_id) WHERE term = 'the' AND n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 20")
def _(s: SparkSession, d: str) -> DataFrame:
    return searcher(s, d).sorted_by(t("the"), "n_chars", 20, descending=True)


@query("k06_collapse", ", h AS (SELECT doc_id, s AS score, source AS key FROM sc JOIN documents USING (doc_id) WHERE term = 'the') SELECT doc_id, round(score, 6) AS score, key FROM h WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id) = 1 UNION ALL SELECT doc_id, round(score, 6), key FROM h WHERE key IS NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    e = searcher(s, d)
    return collect.collapse(e.hits(t("the")), e.index.documents, "source").withColumn("score", F.round("score", 6))


@query("k07_sort_missing", "SELECT doc_id, coalesce(quality, -1)::INTEGER AS value FROM (SELECT doc_id FROM documents) LEFT JOIN labels USING (doc_id) ORDER BY value, doc_id LIMIT 50", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return collect.by_field(rows, rows, "quality", 50, missing=-1)


@query("k07_sort_missing_all", "SELECT doc_id, coalesce(quality, -1)::INTEGER AS value FROM (SELECT doc_id FROM documents) LEFT JOIN labels USING (doc_id)", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    """Every candidate; k07_sort_missing has the first 50."""
    rows = table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return collect.by_field(rows, rows, "quality", missing=-1)


@query("k09_range_sorted", "SELECT o_orderkey AS doc_id, o_totalprice AS value FROM orders WHERE o_custkey BETWEEN 10 AND 500 ORDER BY value DESC, doc_id LIMIT 25", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").withColumnRenamed("o_orderkey", "doc_id")
    rows = rows.filter(range_condition(Range.of("o_custkey", 10, 500), rows))
    return collect.by_field(rows, rows, "o_totalprice", 25, descending=True)


@query("k10_multi_valued_sort", "SELECT l_orderkey AS doc_id, max(l_linenumber)::BIGINT AS value FROM lineitem GROUP BY 1 ORDER BY value DESC, doc_id LIMIT 25", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = _orders(s, d)
    return collect.by_field(rows, rows, "lines", 25, descending=True, selector="max")


@query("k10_multi_valued_sort_all", "SELECT l_orderkey AS doc_id, max(l_linenumber)::BIGINT AS value FROM lineitem GROUP BY 1", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    """Every candidate; k10_multi_valued_sort has the first 25."""
    rows = _orders(s, d)
    return collect.by_field(rows, rows, "lines", descending=True, selector="max")


# facets
@query("a01_facet_counts", "SELECT label, count(h.doc_id) AS count FROM (SELECT doc_id, source AS label FROM documents WHERE source IS NOT NULL) LEFT JOIN (SELECT doc_id FROM p WHERE term = 'the') AS h USING (doc_id) GROUP BY label")
def _(s: SparkSession, d: str) -> DataFrame:
    return searcher(s, d).facets(t("the"), "source")


@query("a01_facets_multi_valued", "SELECT l_returnflag AS label, count(DISTINCT l_orderkey) AS count FROM lineitem GROUP BY 1", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = _orders(s, d)
    return facets.facet_counts(rows, rows, "flags")


@query("a02_labels", "SELECT row_number() OVER (ORDER BY label) - 1 AS ord, label FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type IS NOT NULL)", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    return facets.labels(table(s, d, "events").withColumnRenamed("event_id", "doc_id"), "event_type")


@query("a03_top_facets", "SELECT o_orderpriority AS label, count(*) AS count FROM orders GROUP BY 1 ORDER BY count DESC, label LIMIT 3", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").withColumnRenamed("o_orderkey", "doc_id")
    return facets.top_facets(facets.facet_counts(rows, rows, "o_orderpriority"), 3)


@query("a04_range_facets", "SELECT ord, label, count FROM (SELECT 0 AS ord, 'small' AS label, count(*) FILTER (l_quantity < 10) AS count FROM lineitem UNION ALL SELECT 1, 'middle', count(*) FILTER (l_quantity >= 10 AND l_quantity <= 30) FROM lineitem UNION ALL SELECT 2, 'above 25', count(*) FILTER (l_quantity > 25) FROM lineitem UNION ALL SELECT 3, 'none', count(*) FILTER (l_quantity > 1000) FROM lineitem)", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    r = facets.NumericRange
    return facets.range_facets(table(s, d, "lineitem"), "l_quantity", [r("small", None, 10, high_in=False), r("middle", 10, 30), r("above 25", 25, None, low_in=False), r("none", 1000, None, low_in=False)])


@query("a06_term_statistics", "SELECT term, df, ttf FROM df")
def _(s: SparkSession, d: str) -> DataFrame:
    return snapshot(s, d).terms.select("term", "df", "ttf")


@query("a06_field_statistics", "SELECT (SELECT dc FROM st) AS doc_count, (SELECT count(*) FROM df) AS n_terms, (SELECT sum(df)::BIGINT FROM df) AS sum_df, (SELECT sum(ttf)::BIGINT FROM df) AS sum_ttf")
def _(s: SparkSession, d: str) -> DataFrame:
    x = snapshot(s, d).field_stats["body"]
    return s.createDataFrame([(x["doc_count"], x["n_terms"], x["sum_df"], x["sum_ttf"])], "doc_count long, n_terms long, sum_df long, sum_ttf long")


# analysis
def analyzed(docs: DataFrame, tokenizer: str, change: Change) -> DataFrame:
    """doc_id, k, term, pos_inc of the tokens of every text; change: what becomes of a single token."""

    def run(parts):
        import numpy as np
        import pyarrow as pa

        analyzer = Batches(tokenizer, change)
        for part in slices(parts):
            texts, rows = without_nulls(column(part, 1))
            t = analyzer.tokens(texts)
            first = np.searchsorted(t.text, t.text)
            ids = column(part, 0).take(pa.array(rows[t.text]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(first)) - first, pa.int32()), t.strings(), pa.array(t.step, pa.int32())], names=["doc_id", "k", "term", "pos_inc"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, k int, term string, pos_inc int")


def _counted(docs: DataFrame, tokenizer: str, change: Change) -> DataFrame:
    """term, n over the tokens of every text: words are counted first, then each distinct one is changed, once."""

    def cut(parts):
        import pyarrow as pa

        analyzer = Batches(tokenizer, change)
        for part in slices(parts):
            words, n = analyzer.words(without_nulls(column(part, 0))[0])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["term", "n"])

    def changed(parts):
        import pyarrow as pa

        for part in slices(parts):
            # words come once: none is remembered
            terms, n = Batches(tokenizer, change).changed(column(part, 0).to_pylist(), column(part, 1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(n, pa.int64())], names=["term", "n"])

    words = docs.select("text").mapInArrow(cut, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return words.mapInArrow(changed, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _stopped(tokens: list[Token]) -> list[Token]:
    return stop(Analyzer.simple().filtered(tokens), ENGLISH_STOP_WORDS)


def _folded(tokens: list[Token]) -> list[Token]:
    return fold(Analyzer.simple().filtered(tokens))


@query("t01_tokenize_simple", "SELECT doc_id, pos::INTEGER AS k, term, 1::INTEGER AS pos_inc FROM tok")
def _(s: SparkSession, d: str) -> DataFrame:
    return analyzed(table(s, d, "documents"), "simple", Analyzer.simple().filtered)


@query("t01_tokenize_standard")
def _(s: SparkSession, d: str) -> DataFrame:
    return _counted(table(s, d, "documents"), "standard", lambda x: x)


_STOPS = ", ".join(f"'{w}'" for w in sorted(ENGLISH_STOP_WORDS))


@query("t03_stop", f"SELECT term, count(*) AS n FROM tok WHERE term NOT IN ({_STOPS}) GROUP BY term")
def _(s: SparkSession, d: str) -> DataFrame:
    return _counted(table(s, d, "documents"), "simple", _stopped)


@query("t05_fold", "SELECT translate(replace(replace(replace(term, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'àáâãäåçèéêëìíîïðñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiidnoooooouuuuyy') AS term, count(*) AS n FROM tok GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return _counted(table(s, d, "documents"), "simple", _folded)


@query("t06_porter")
def _(s: SparkSession, d: str) -> DataFrame:
    return _counted(table(s, d, "documents"), "simple", Analyzer.simple().with_stemming().filtered)


@query("t07_english_stemmer")
def _(s: SparkSession, d: str) -> DataFrame:
    return _counted(table(s, d, "documents"), "simple", Analyzer.simple().with_stemming("english").filtered)


@query("t08_synonyms", "SELECT term, count(*) AS n FROM (SELECT term FROM tok UNION ALL SELECT 'article' FROM tok WHERE term = 'the' UNION ALL SELECT 'the' FROM tok WHERE term = 'article') GROUP BY term")
def _(s: SparkSession, d: str) -> DataFrame:
    return _counted(table(s, d, "documents"), "simple", Analyzer.simple().with_synonyms({"the": ["article"]}, True).filtered)


@query("t11_ngrams", "SELECT g AS term, count(*) AS n FROM (SELECT unnest(flatten(list_transform(range(1, length(p_name) + 1), lambda i: list_transform(range(2, 4), lambda m: CASE WHEN i + m - 1 <= length(p_name) THEN substr(p_name, i, m) END)))) AS g FROM part) WHERE g IS NOT NULL GROUP BY g", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    return _counted(rows, "keyword", lambda x: ngrams(x, 2, 3))


@query("t12_edge_ngrams", "SELECT substr(p_name, 1, m) AS term, count(*) AS n FROM part, (SELECT unnest([1, 2, 3]) AS m) WHERE length(p_name) >= m GROUP BY 1", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    return _counted(rows, "keyword", lambda x: ngrams(x, 1, 3, edge=True))


@query("t14_invert", "SELECT term, doc_id, freq::INTEGER AS freq, array_to_string(ps, ',') AS positions FROM p")
def _(s: SparkSession, d: str) -> DataFrame:
    return snapshot(s, d).postings.select("term", "doc_id", "freq", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


# query strings
def _parsed(name: str, text: str, sql: str) -> None:
    query(name, sql)(lambda s, d: rounded(searcher(s, d).hits(text, "body")))


_parsed("p01_parsed_boolean", "+the of^2 -with", f", {ABC} SELECT doc_id, round(sa + 2 * coalesce(sb, 0), 6) AS score FROM u WHERE sa IS NOT NULL AND sc_ IS NULL")
_parsed("p02_parsed_groups", "+(the of) +n_chars:[500 TO *]", f", {ABC} SELECT doc_id, round(coalesce(sa, 0) + coalesce(sb, 0) + 1, 6) AS score FROM u JOIN documents USING (doc_id) WHERE (sa IS NOT NULL OR sb IS NOT NULL) AND n_chars >= 500")
_parsed("p03_parsed_range", "n_chars:{500 TO 1000]", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE n_chars > 500 AND n_chars <= 1000")
_parsed("p04_parsed_patterns", "+sh* +body:/.*ing/ -t?e", "SELECT DISTINCT doc_id, 2.0::DOUBLE AS score FROM p WHERE starts_with(term, 'sh') AND doc_id IN (SELECT doc_id FROM p WHERE regexp_full_match(term, '(?s).*ing')) AND doc_id NOT IN (SELECT doc_id FROM p WHERE regexp_full_match(term, '(?s)t.e'))")
_parsed("p05_parsed_phrase", '"Of the"', f", {PHRASE} SELECT doc_id, round(idf * f / (f + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM x WHERE f > 0")


# highlighting, vectors, suggestions
@query("h02_matched_offsets", r"SELECT doc_id, count(*) AS n FROM tok WHERE term IN ('the', 'of') GROUP BY doc_id")
def _(s: SparkSession, d: str) -> DataFrame:
    from siftwell.operators.highlight import matched_offsets

    return matched_offsets(snapshot(s, d).postings, "body", ["the", "of"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("h03_highlight")
def _(s: SparkSession, d: str) -> DataFrame:
    return searcher(s, d).highlights(t("the"), "body", ["the"], 10)


def _first_vector(s: SparkSession, d: str) -> list[float]:
    return table(s, d, "embeddings").filter("vec_id = 0").first()["embedding"]


_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _nearest(name: str, kind: str, sql: str) -> None:
    @query(name, f"SELECT vec_id, round({sql}, 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) CROSS JOIN {_Q} ORDER BY score DESC, vec_id LIMIT 10", cte=False)
    def _(s: SparkSession, d: str) -> DataFrame:
        rows = table(s, d, "embeddings").select("vec_id", "embedding")
        score = F.round(vectors.similarity(F.col("embedding"), _first_vector(s, d), kind), 6)
        return rows.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


_nearest("v01_nearest_cosine", "cosine", "(1 + list_cosine_similarity(e, q)) / 2")
_nearest("v02_nearest_euclidean", "euclidean", "1 / (1 + power(list_distance(e, q), 2))")
_nearest("v02_nearest_dot", "dot", "greatest((1 + list_inner_product(e, q)) / 2, 0)")
_nearest("v02_nearest_inner_product", "inner_product", "CASE WHEN list_inner_product(e, q) < 0 THEN 1 / (1 - list_inner_product(e, q)) ELSE 1 + list_inner_product(e, q) END")


@query("g02_completions", "SELECT substr(term, 3) AS suffix, ttf AS weight FROM df WHERE starts_with(term, 'th') ORDER BY ttf DESC, suffix LIMIT 10")
def _(s: SparkSession, d: str) -> DataFrame:
    return suggest.completions(snapshot(s, d).terms.select("term", F.col("ttf").alias("weight")), "th", 10)


@query("g01_suggester", "SELECT p_brand AS term, arg_min(p_size, p_partkey) AS weight FROM part GROUP BY 1", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    return suggest.suggester(table(s, d, "part").select(F.col("p_brand").alias("term"), F.col("p_size").alias("weight"), F.col("p_partkey").alias("o")), "o")


# dictionary and stored fields
@query("src09_seek_ceil", "SELECT term, df FROM df WHERE term >= 'shore' ORDER BY term LIMIT 5")
def _(s: SparkSession, d: str) -> DataFrame:
    return snapshot(s, d).seek_ceil("body", "shore", 5).select("term", "df")


@query("src18_term_vector", "SELECT term, freq::INTEGER AS freq, array_to_string(ps, ',') AS positions FROM p WHERE doc_id = 3")
def _(s: SparkSession, d: str) -> DataFrame:
    return snapshot(s, d).term_vector(3).select("term", "freq", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("src07_stored_fields", f"SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, round(s, 6) AS score FROM sc WHERE term = 'the' {TOP10}))")
def _(s: SparkSession, d: str) -> DataFrame:
    return snapshot(s, d).fetch(term_top10(s, d)).select("doc_id", "lang", "source", "n_chars")


# the life of an index, on parts by name
def _parts(s: SparkSession, d: str) -> Index:
    index = Index.open(s, f"{scratch(s)}/parts-{uuid.uuid4().hex}", IndexSchema((FieldSpec("p_name", analyzer=Analyzer.simple()),), soft_deletes="gone"))
    rows = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", F.col("p_size").cast("long").alias("p_size"), F.lit(None).cast("long").alias("gone"))
    index.add(rows.filter("doc_id % 2 = 0"))
    index.commit()
    index.add(rows.filter("doc_id % 2 = 1"))
    index.commit()
    return index


def _state(index: Index) -> DataFrame:
    return index.snapshot().documents.select("doc_id", "p_name", "p_size")


_LOW = "p_size BETWEEN 1 AND 10"


@query("w08_delete", f"SELECT p_partkey AS doc_id, p_name, p_size::BIGINT AS p_size FROM part WHERE NOT {_LOW}", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    index = _parts(s, d)
    index.delete(Range.of("p_size", 1, 10))
    return _state(index)


@query("w09_update", f"SELECT p_partkey AS doc_id, p_name, p_size::BIGINT AS p_size FROM part WHERE NOT {_LOW} UNION ALL SELECT 0, 'all new', 77", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    index = _parts(s, d)
    index.update(Range.of("p_size", 1, 10), s.createDataFrame([(0, "all new", 77, None)], "doc_id long, p_name string, p_size long, gone long"))
    return _state(index)


@query("w12_soft_delete", f"SELECT p_partkey AS doc_id, p_name, p_size::BIGINT AS p_size FROM part WHERE NOT {_LOW}", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    index = _parts(s, d)
    index.soft_delete(Range.of("p_size", 1, 10))
    return _state(index)


@query("w14_value_updates", "SELECT p_partkey AS doc_id, p_name, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 1000 ELSE p_size END::BIGINT AS p_size FROM part", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    index = _parts(s, d)
    ids = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"))
    index.update_values("p_size", ids.filter("doc_id % 2 = 0").withColumn("value", F.lit(1000).cast("long")))
    index.update_values("p_size", ids.filter("doc_id % 3 = 0").withColumn("value", F.lit(None).cast("long")))
    return _state(index)


@query("w15_merge", r"SELECT term, count(*) AS df, sum(f)::BIGINT AS ttf FROM (SELECT p_partkey, term, count(*) AS f FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+')) AS term FROM part WHERE NOT p_size BETWEEN 1 AND 10) GROUP BY ALL) GROUP BY term", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    index = _parts(s, d)
    index.delete(Range.of("p_size", 1, 10))
    index.force_merge(1)
    return index.snapshot().terms.select("term", "df", "ttf")


@query("w23_check", "SELECT unnest(['deletes.count', 'deletes.known', 'fields.known', 'lengths', 'postings.doc_ids', 'postings.positions', 'postings.unique', 'stored.doc_count', 'terms.statistics']) AS name, true AS passed", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    index = _parts(s, d)
    index.delete(Range.of("p_size", 1, 10))
    found: dict[str, bool] = {}
    for _, name, ok in index.check():
        found[name] = found.get(name, True) and ok
    return s.createDataFrame(sorted(found.items()), "name string, passed boolean")


#: The parts as _parts indexes them: p (doc_id, seg: segment, term, freq), n (doc_id, seg, dl).
PARTS = r"""WITH tok AS (SELECT p_partkey AS doc_id, p_partkey % 2 AS seg, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+')) AS term FROM part),
p AS (SELECT doc_id, seg, term, count(*) AS freq FROM tok GROUP BY ALL), n AS (SELECT doc_id, seg, count(*) AS dl FROM tok GROUP BY ALL),
"""
_SMALL = Term("p_name", "small")


@query("k11_segments_global", PARTS + "st AS (SELECT count(*) AS dc, avg(dl) AS mean FROM n), df AS (SELECT count(*) AS df FROM p WHERE term = 'small') SELECT doc_id, round(ln(1 + (dc - df + 0.5) / (df + 0.5)) * freq / (freq + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM p JOIN n USING (doc_id) CROSS JOIN st CROSS JOIN df WHERE term = 'small'", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(Searcher(_parts(s, d).snapshot()).hits(_SMALL))


@query("k14_segments_own_statistics", PARTS + "st AS (SELECT seg, count(*) AS dc, avg(dl) AS mean FROM n GROUP BY seg), df AS (SELECT seg, count(*) AS df FROM p WHERE term = 'small' GROUP BY seg) SELECT p.doc_id, round(ln(1 + (dc - df + 0.5) / (df + 0.5)) * freq / (freq + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM p JOIN n USING (doc_id) JOIN st ON st.seg = p.seg JOIN df ON df.seg = p.seg WHERE term = 'small'", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(Searcher(_parts(s, d).snapshot(), scope="segment").hits(_SMALL))


@query("k15_segments_sorted", PARTS + "z AS (SELECT p_partkey AS doc_id, p_size::BIGINT AS value FROM part) SELECT doc_id, value FROM p JOIN z USING (doc_id) WHERE term = 'small' AND value IS NOT NULL", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    return Searcher(_parts(s, d).snapshot()).sorted_by(_SMALL, "p_size", descending=True)


@query("a05_facets_over_segments", PARTS + "z AS (SELECT p_partkey AS doc_id, p_size::BIGINT AS label FROM part WHERE p_size IS NOT NULL) SELECT label, count(h.doc_id) AS count FROM z LEFT JOIN (SELECT doc_id FROM p WHERE term = 'small') AS h USING (doc_id) GROUP BY label", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    return Searcher(_parts(s, d).snapshot()).facets(_SMALL, "p_size")


@query("w06_rollback", "SELECT p_partkey AS doc_id, p_name, p_size::BIGINT AS p_size FROM part", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    index = _parts(s, d)
    index.add(s.createDataFrame([(-1, "never seen", 1, None)], "doc_id long, p_name string, p_size long, gone long"))
    index.rollback()
    index.commit()
    return _state(index)


@query("w07_counts", f"SELECT (SELECT count(*) FROM part WHERE NOT {_LOW}) AS committed, 1::BIGINT AS pending", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    index = _parts(s, d)
    index.delete(Range.of("p_size", 1, 10))
    index.add(s.createDataFrame([(-1, "to come", 1, None)], "doc_id long, p_name string, p_size long, gone long"))
    return s.createDataFrame([(index.committed_count(), index.pending_count())], "committed long, pending long")


@query("w22_auto_merge", "SELECT 1::BIGINT AS segments, count(*) AS docs FROM part", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    index = _parts(s, d)
    merged = index.auto_merge(MergePolicy(at_once=2, per_tier=1, floor=1)).segments
    return index.snapshot().documents.agg(F.lit(len(merged)).cast("long").alias("segments"), F.count("*").alias("docs"))


@query("w24_verify", "SELECT unnest(['lengths', 'postings', 'terms']) AS name, true AS passed, 2::BIGINT AS segments", cte=False)
def _(s: SparkSession, d: str) -> DataFrame:
    found = s.createDataFrame(_parts(s, d).verify(), "segment string, name string, passed boolean")
    return found.groupBy("name").agg(F.bool_and("passed").alias("passed"), F.count("*").alias("segments"))

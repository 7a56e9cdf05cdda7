"""Host-level quality rules.

Every document is measured and tested by rules; failures are counted by host (the source column), a host's rate is
shrunk towards the corpus by a beta prior fitted to all hosts (method of moments), and the verdict on the host is joined
back: on a rejected host only documents that fail no rule stay. Only DataFrame functions run; a document is one pass
over arrays, its three-word windows are hashed (64 bits) and sorted, never compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm._common import fresh, materialize, null_safe, small, table

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules beyond the base: symbols by word, repeated lines by word, mean letters of a word.
MOST_SYMBOLS, MOST_DUP_LINES, LEAST_LETTERS, MOST_LETTERS = 0.2, 0.1, 2.0, 15.0
#: A host is rejected if its shrunk failure rate is above this.
MOST_FAILED = 0.7
#: Rows by which the prior counts at most, and where the hosts' rates don't vary beyond chance.
MOST_PRIOR = 10_000.0
NONE = 1 << 30


def _repeats(runs: Column) -> Column:
    """Words in windows that occur twice or more, from (hash, place) sorted by hash."""
    same = F.zip_with(runs, F.slice(runs, 2, NONE), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    before = F.concat(F.array(F.lit(False)), same)
    marked = F.zip_with(F.zip_with(runs, same, lambda r, s: F.struct(r["i"].alias("i"), s.alias("s"))), before, lambda r, b: F.when(r["s"] | b, r["i"]))
    places = F.filter(marked, lambda i: i.isNotNull())
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))


def measure(docs: DataFrame, into: str) -> DataFrame:
    """docs with one more column `into`, a struct of MEASURES (long) and failed, base_failed (boolean).

    A null text counts as empty: no words, and the base rule fails. Repeated rows are measured each on its own.
    """
    given = docs.columns
    t, w, h, s = (fresh(docs, f"__{x}") for x in ("text", "words", "windows", "sorted"))
    out = docs.withColumn(t, F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumn(w, F.filter(F.split(F.col(t), BLANK), lambda x: x != ""))
    pairs = F.zip_with(F.col(w), F.slice(F.col(w), 2, NONE), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn(h, F.when(F.size(w) >= 3, F.slice(F.zip_with(pairs, F.slice(F.col(w), 3, NONE), lambda p, c: F.xxhash64(p, c)), F.lit(1), F.size(w) - 2)).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    n = F.size(w).cast("long")
    values = {
        "n_words": n,
        "word_chars": F.length(F.translate(F.col(t), BLANKS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(F.col(t), SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.when(F.instr(t, "\n") > 0, F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]).otherwise(0).cast("long"),
        "n_repeat_words": F.when(F.col(s).isNull(), 0).otherwise(_repeats(F.col(s))).cast("long"),
    }
    # explode() of one struct: no filter or projection above it makes Spark evaluate the measures again
    out = out.select(*given, F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias(into))
    m = F.col(into)
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    soft = (m["n_symbols"] > MOST_SYMBOLS * m["n_words"]) | (m["n_dup_lines"] > MOST_DUP_LINES * m["n_words"]) | (m["word_chars"] < LEAST_LETTERS * m["n_words"]) | (m["word_chars"] > MOST_LETTERS * m["n_words"])
    return out.select(*given, F.struct(*[m[k].alias(k) for k in MEASURES], base.alias("base_failed"), (base | soft).alias("failed")).alias(into))


def judge_hosts(failures: DataFrame) -> DataFrame:
    """host, n, n_failed, rate, rejected from rows (host, failed). One row, the prior's moments, comes to the driver."""
    hosts = materialize(failures.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed")), "hosts")
    raw = F.col("n_failed") / F.col("n")
    k, mean, var, noise = hosts.agg(F.count("*"), F.sum("n_failed") / F.sum("n"), F.var_pop(raw), F.avg(raw * (1 - raw) / F.col("n"))).first()
    mean, spread = mean or 0.0, (var or 0.0) - (noise or 0.0)
    weight = min(MOST_PRIOR, max(1.0, mean * (1 - mean) / spread - 1)) if k and spread > 1e-12 else MOST_PRIOR
    rate = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > MOST_FAILED)


def with_host(rows: DataFrame, hosts: DataFrame, host: str, into: str, salts: int = 64) -> DataFrame:
    """rows with the verdict on their host in `into`; many hosts: a join whose hot keys are dealt over `salts` at random."""
    verdict = hosts.select(F.col("host").alias(host), F.col("rejected").alias(into))
    if small(verdict):
        return rows.join(F.broadcast(verdict), host)
    salt = fresh(rows, "__salt")
    dealt = verdict.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # the draws follow from a seed and a row's place in its file: a task that runs again draws the same
    return rows.withColumn(salt, F.floor(F.rand() * salts).cast("int")).join(dealt, [host, salt]).drop(salt)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES, base_failed, failed, kept for every row; a null source is a host of its own."""
    rows = docs.select("doc_id", "text", null_safe(F.col("source")).alias("host"))
    rows = materialize(measure(rows, "m").select("doc_id", "host", "m.*"), "quality")
    hosts = judge_hosts(rows.select("host", "failed"))
    out = with_host(rows, hosts, "host", "rejected")
    return out.select("doc_id", *MEASURES, "base_failed", "failed", (~F.col("base_failed") & ~(F.col("rejected") & F.col("failed"))).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns: measured once, written, then joined with their hosts' verdicts.

    What fails the base rule is written without its text, as it only counts for its host.
    """
    m, host, rejected = (fresh(docs, f"__{x}") for x in ("quality", "host", "rejected"))
    measured = measure(docs.withColumn(host, null_safe(F.col("source"))), m)
    base, failed = F.col(m)["base_failed"], F.col(m)["failed"]
    row = F.when(~base, F.struct(*docs.columns))
    rows = materialize(measured.select(F.col(host), base.alias(m), failed.alias(rejected), row.alias("row")), "quality")
    hosts = judge_hosts(rows.select(F.col(host).alias("host"), F.col(rejected).alias("failed")))
    good = rows.filter(~F.col(m)).select(host, F.col(rejected).alias("failed"), "row")
    out = with_host(good, hosts, host, "rejected").filter(~(F.col("rejected") & F.col("failed")))
    return out.select("row.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents."""
    return judge(table(spark, sf_dir, "documents")).drop("failed")


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS g FROM w),
u AS (SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM g),
r AS (SELECT doc_id, i FROM u QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR n_symbols > {MOST_SYMBOLS} * n_words OR n_dup_lines > {MOST_DUP_LINES} * n_words OR word_chars < {LEAST_LETTERS} * n_words OR word_chars > {MOST_LETTERS} * n_words AS failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS nf FROM f GROUP BY source),
p AS (SELECT sum(nf) / sum(n) AS mean, var_pop(nf / n) - avg((nf / n) * (1 - nf / n) / n) AS spread FROM h),
q AS (SELECT mean, CASE WHEN spread > 1e-12 THEN least({MOST_PRIOR}, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE {MOST_PRIOR} END AS weight FROM p),
v AS (SELECT source, (nf + mean * weight) / (n + weight) > {MOST_FAILED} AS rejected FROM h CROSS JOIN q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rejected AND failed) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

import re
from collections import Counter

from siftwell.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    cover = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    base = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), base


TEXTS = [None, "", " \t\n", "one", "a a a a", "a b c a b c", "x\ny\nx\n\n\nx", "# * $ é ü word\x0bword\x1cz", " ".join(f"w{i}" for i in range(60)), "la la la " * 40, " ".join(f"w{i % 37}" for i in range(20_000)), "\n".join(["same line here"] * 5 + [f"line {i}" for i in range(50)])]


def test_measures_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", None if i % 3 else "s", 0) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: tuple(r[k] for k in (*quality.MEASURES, "base_failed")) for r in quality.judge(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_host_verdict_and_clean_documents(spark):
    good = " ".join(f"word{i}" for i in range(80))
    soft = good + " #" * 60
    rows = [(i, "bad", "en", "spam", 0) for i in range(400)] + [(1000, good, "en", "spam", 0), (1001, soft, "en", "spam", 0)]
    rows += [(2000 + i, good, "en", f"host{i % 40}", 0) for i in range(400)] + [(5000, soft, "en", "host1", 0)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[0] and got[1000] and not got[1001] and got[5000] and all(got[2000 + i] for i in range(400))


def test_stage_keeps_columns_and_takes_odd_tables(spark):
    rows = [(1, TEXTS[8], "en", None, 3, "x"), (1, TEXTS[8], "en", None, 3, "x"), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", kept string")
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows[:2])
    assert quality.judge(docs).count() == 3
    assert quality.judge(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0


def test_many_hosts_are_joined_with_salt(spark, monkeypatch):
    monkeypatch.setattr(quality, "small", lambda df: False)
    docs = spark.createDataFrame([(i, TEXTS[8], "en", f"h{i % 7}", 0) for i in range(50)], SCHEMA)
    assert quality.judge(docs).filter("kept").count() == 50

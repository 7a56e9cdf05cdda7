import random

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwell.llm import chat, topk, url_filter

SF = "/root/testdata/sf0.001"


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    want = con.sql(sql)
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=key) == sorted(want.select(*order).fetchall(), key=key)


URLS = [None, "", "no scheme", "http://", "http://net", "http://NET/", "http://a.example.net/en/x?y", "http://a.example.net/de/", "http://badexample.com/de/", "http://EXAMPLE.com/de/x", "https://example.com/DE/x", "x://foo.org/fr/", "http://foo.org:80/fr/", "http://org/fr", "http://casino-win.example.com/", "http://mycasino.example.com/", "http://b.casino/", "a://b://c.net/d", "http://example.net/en/", "http://example.net/en", "http://x.org#/fr/", "http://bets.casino.com/\n", "http://é.net/é"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "html", "clash") for i, u in enumerate(URLS)] + [(1, URLS[5], None, None)] * 2, "page_id long, url string, html string, host string")
    got = url_filter.judge_urls(pages, (*url_filter.HOST_RULES, *url_filter.WORD_RULES))
    same(got, url_filter.OP2_SQL, pages=pages)
    by = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
    assert by[4] == (None, "allow") and by[6] == ("example.net/en/", "allow") and by[7] == ("net/", "block") and by[14] == (None, "block") and by[0] == (None, "allow")
    assert url_filter.judge_urls(pages.limit(0), url_filter.HOST_RULES).count() == 0


def test_the_index_equals_trying_every_rule():
    rng = random.Random(3)
    names = ["a", "bb", "ccc", "net", "org", "en", "fr"]
    rules = [url_filter.host_rule(".".join(rng.choices(names, k=rng.randint(1, 2))) + "/" + "/".join(rng.choices(names, k=rng.randint(0, 2))), rng.choice(["allow", "block"])) for _ in range(60)]
    index = url_filter.Index(rules)
    for _ in range(2000):
        url = ".".join(rng.choices(names, k=3)) + "/" + "/".join(rng.choices(names, k=3))
        fits = [(-r.weight, k) for k, r in enumerate(rules) if index.fits(k, *url.partition("/")[:1], "/" + url.partition("/")[2], None)]
        want = rules[min(fits)[1]].name if fits else None
        assert index.judge(*url.split("/", 1)[:1], "/" + url.split("/", 1)[1])[0] == want


LIST = """
! a comment
[Adblock Plus 2.0]
||ads.example.com^
@@||ads.example.com/en/
||track.example.com^$important
@@||track.example.com^
|https://only.example.org/|
/banner/*/big.
-ad-640x
Case.Sensitive$match-case
/\\/p[0-9]+\\.gif$/
||img.example.com^$image
example.com##.ad
/(/
"""


def test_filter_lists():
    rules, out = url_filter.parse_list(LIST.splitlines())
    assert len(rules) == 9 and [x for x, _ in out] == ["||img.example.com^$image", "example.com##.ad", "/(/"]
    index = url_filter.Index(rules)
    fits = {
        "http://ads.example.com/": "||ads.example.com^", "http://x.ADS.example.com:80/y": "||ads.example.com^", "http://ads.example.com": "||ads.example.com^", "http://bads.example.com/": None, "http://ads.example.community/": None,
        "http://ads.example.com/EN/x": "@@||ads.example.com/en/", "http://track.example.com/": "||track.example.com^$important", "https://only.example.org/": "|https://only.example.org/|", "https://only.example.org/x": None,
        "http://a/banner/x/y/big.png": "/banner/*/big.", "http://a/banner/big.png": None, "http://a/b-ad-640x480": "-ad-640x", "http://a/Case.Sensitive": "Case.Sensitive$match-case", "http://a/case.sensitive": None,
        "http://a/p12.gif": "/\\/p[0-9]+\\.gif$/", "http://a/p12.gif?x": None, "http://a/?u=http://ads.example.com/": None,
    }
    for url, name in fits.items():
        assert index.judge(*url_filter.parts(url), url)[2] == name, url


def test_thousands_of_rules_few_of_them_run():
    rng = random.Random(5)
    names = [f"{a}{b}{n}" for a in ("news", "shop", "ad") for b in ("x", "zone", "") for n in range(120)]
    shapes = ("||{0}.com^", "||{0}.{1}.net^", "@@||{0}.com/{1}/", "/{0}/*/{1}.", "-{0}-", "|http://{0}.", "{0}.{1}|", "^{0}^", "||{0}*{1}^", "||{0}.com^$important")
    rules, out = url_filter.parse_list([rng.choice(shapes).format(rng.choice(names), rng.choice(names)) for _ in range(4000)])
    index = url_filter.Index(rules)
    assert not out and not index.always or len(index.always) < 0.2 * len(rules)
    urls = ["http://" + ".".join(rng.choices(names, k=rng.randint(1, 2)) + [rng.choice(["com", "net"])]) + "/" + rng.choice("/-.").join(rng.choices(names, k=rng.randint(1, 3))) + rng.choice(["", "/", "/x-y.gif"]) for _ in range(300)]
    hits = 0
    for url in urls:
        fits = [(-r.weight, k) for k, r in enumerate(rules) if index.fits(k, *url_filter.parts(url), url)]
        assert index.judge(*url_filter.parts(url), url)[2] == (rules[min(fits)[1]].name if fits else None)
        hits += bool(fits)
    assert hits > 100
    index.tried = 0
    for url in urls:
        index.judge(*url_filter.parts(url), url)
    assert index.tried < (len(index.always) + 40) * len(urls) and index.tried < 0.2 * len(rules) * len(urls)


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text(LIST)
    rules = url_filter.load_list(spark, f"{tmp_path}/list.txt")[0]
    assert {r.name for r in rules} == {r.name for r in url_filter.parse_list(LIST.splitlines())[0]}
    with pytest.raises(ValueError):
        url_filter.load_list(spark, f"{tmp_path}/list.txt", most=3)
    pages = spark.createDataFrame([(1, "http://ads.example.com/x" + "y" * 2_000_000), (2, None), (3, "ads.example.com"), (4, "http://casino.org/fr/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.pattern) for r in url_filter.judge_urls(pages, (*url_filter.HOST_RULES, *url_filter.WORD_RULES, *rules)).collect()}
    assert got == {1: (None, "block", "||ads.example.com^"), 2: (None, "allow", None), 3: (None, "allow", None), 4: ("org/fr/", "allow", None)}


TURNS = "conv_id long, turn long, role string, text string"


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes <|end|>"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes <|end|>"), (4, 0, "user", None), (5, 0, "user", ""), (6, 0, None, "x"), (6, 0, "a", "x"), (6, 0, "a", "x"), (7, 1, "user", "hi"), (8, 0, "user", "hi"), (8, 1, "user", "other"), (9, None, "user", "q"), (None, 0, "user", "n"), (None, 1, "user", "m")]
    turns = spark.createDataFrame(rows, TURNS)
    got = chat.format_chats(turns)
    same(got, chat.OP6_SQL, conversations=turns)
    assert {r.conv_id for r in got.collect()} == {2, 4, 5, 6, 8, 9, None}
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chats_at_random(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice("ab"), rng.choice("xy")) for c in range(150) for t in range(rng.randint(1, 5))]
    turns = spark.createDataFrame(rows, TURNS)
    same(chat.format_chats(turns), chat.OP6_SQL, conversations=turns)


def brute(rows, k):
    import math

    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in dict((i, q) for i, q in ok if i % 50 == 0).items():
        s = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q)))[:k]
        out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [4096, 40])
def test_topk(spark, blocks):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(120)] + [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [1.0, 2.0]), (2201, [3.0, -1.0]), (2250, [1e200, 1.0, 0.0]), (2251, [1e-3, 1.0, 0.0]), (None, [0.1] * 8), (2300, []), (2301, [])]
    rows += [(1119, [0.5] * 8)] * 30
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, rows=blocks, query_rows=4).collect()))
    assert [r for r in got if r[0] != 2250] == [r for r in brute(rows, 5) if r[0] != 2250]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold():
    """Every score lies between its bounds, doubles and big integers alike."""
    import numpy as np

    rng = np.random.default_rng(3)
    for spread in (0.01, 1.0, 900.0, 1e180):
        v, q = rng.uniform(-spread, spread, (300, 6)), rng.uniform(-spread, spread, (7, 6))
        wide = bool(topk.is_wide(v).any() or topk.is_wide(q).any())
        iv, iq = (topk._big(x) if wide else np.floor(256 * x) for x in (v, q))
        lower, upper = topk.bounds(iq, *topk.approximate(iv))
        for a in range(len(q)):
            for b in range(len(v)):
                score = sum(int(x) * int(y) for x, y in zip(iq[a], iv[b], strict=True))
                assert float(lower[a, b]) <= score <= float(upper[a, b])


def test_topk_with_copies_and_repeated_queries(spark):
    """A third of all rows hold one vector; queries repeat with the same and with other vectors."""
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(600)] + [(700 + i, [3.0, 3.0, 3.0, 3.0, 3.0, 3.0]) for i in range(300)]
    df = spark.createDataFrame(rows + [rows[50], rows[50], rows[7]], "vec_id long, embedding array<double>").repartition(5)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, rows=64, query_rows=8).collect()))
    assert got == brute(rows + [rows[50], rows[50], rows[7]], 5)
    other = spark.createDataFrame([(0, [1.0]), (0, [-1.0]), (1, [2.0]), (2, [-3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(other, F.col("vec_id") == 0, k=2).orderBy("rank").collect()] == [(0, 1, 2, 196608), (0, 2, 1, 131072)]


def test_queries_against_sql(spark):
    import siftwell.llm.registry as reg

    for name in ("op2_url_filter", "op3_topk_search", "op6_chat_formatting"):
        t = {x: spark.read.parquet(f"{SF}/{x}.parquet") for x in ("pages", "embeddings", "conversations")}
        same(reg.QUERIES[name](spark, SF), reg.ORACLE_SQL[name], **t)



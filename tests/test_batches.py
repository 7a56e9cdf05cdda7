"""Analysis of arrays of texts against Analyzer.analyze, text by text."""

import random

import pyarrow as pa
import pytest

from siftwell.functions import batches
from siftwell.functions.batches import Batches, slices
from siftwell.functions.text import ENGLISH_STOP_WORDS, Analyzer

ANALYZERS = [
    Analyzer.simple(), Analyzer.standard(), Analyzer.keyword(), Analyzer(lowers=False), Analyzer.standard(ENGLISH_STOP_WORDS).with_folding(),
    Analyzer(tokenizer="simple", stops=ENGLISH_STOP_WORDS), Analyzer.simple().with_stemming("english"), Analyzer.simple().with_stemming(),
    Analyzer.simple().with_synonyms({"the": ["article", "word"], "x": ["the"]}, True), Analyzer.standard(ENGLISH_STOP_WORDS).with_synonyms({"fox": ["vixen"]}),
]
PARTS = ["the", "The", " ", "  ", "\n", "\t", "\r\n", "of", "fox", "foxes", "running", "İ", "ΟΔΟΣ", "ẞ", "é", "é", "́", "‍", "­", "ﾞ", "你好", "안녕", "カタ", "🇩🇪🇫🇷", "👨‍👩‍👧", "ℹ", "3.14", "1,000", "don't", "U.S.A.", "a:b", "_x_", ".", "'", "-", " ", "\x85", " ", "٣", "x", "𝔘", "א\"ב", "﻿", "ก็", "²"]


@pytest.mark.parametrize("k", range(len(ANALYZERS)))
def test_like_the_analyzer(k):
    a, r = ANALYZERS[k], random.Random(k)
    texts = ["", "the of", "", "fox the the", "the fox of", *("".join(r.choices(PARTS, k=r.randrange(12))) for _ in range(1500)), ""]
    texts += ["the quick fox isn't here", "", "plain ascii"]
    b = Batches(a.tokenizer, a.filtered)
    want = [(i, t.term, t.pos_inc, t.start, t.end) for i, x in enumerate(texts) for t in a.analyze(x)]
    for array in (pa.array(texts), pa.array(["cut off", *texts])[1:], pa.array(texts, pa.large_string())):
        t = b.tokens(array)
        got = list(zip(t.text.tolist(), [t.terms[j] for j in t.term], t.step.tolist(), t.start.tolist(), t.end.tolist(), strict=True))
        assert got == want
        assert t.lengths.tolist() == list(map(len, texts))
    counted: dict[str, int] = {}
    for term, n in zip(*b.counts(pa.array(texts)), strict=True):
        counted[term] = counted.get(term, 0) + n
    whole: dict[str, int] = {}
    for _, term, *_ in want:
        whole[term] = whole.get(term, 0) + 1
    assert {t: n for t, n in counted.items() if n} == whole
    assert not len(b.tokens(pa.array([], pa.string())).term) and not len(b.tokens(pa.array(["", ""])).term) - 2 * (a.tokenizer == "keyword")


def test_slices_keep_rows_and_sizes():
    rows = [{"k": i, "text": "x" * (100 if i % 50 else 30_000)} for i in range(1000)]
    cut = list(slices(pa.Table.from_pylist(rows).to_batches(max_chunksize=300), 20_000))
    assert [r for t in cut for r in t.to_pylist()] == rows
    assert max(t.nbytes for t in cut) < 100_000 and len(cut) > 10
    assert list(slices([])) == []


def test_a_word_is_analyzed_once():
    seen = []
    b = Batches("simple", lambda tokens: seen.append(tokens[0].term) or tokens)
    for _ in range(3):
        b.counts(pa.array(["a b a"] * 100))
    assert sorted(seen) == ["a", "b"] and batches.REMEMBERED > 1000

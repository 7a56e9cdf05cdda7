import pytest

from siftwell.functions.patterns import glob, osa, regexp
from siftwell.functions.similarity import Bm25, rounded_length, rounded_length_of
from siftwell.functions.stemmers import porter, porter2
from siftwell.functions.text import ENGLISH_STOP_WORDS, FRENCH_STOP_WORDS, Analyzer, SynonymRule, Token, both_ways, fold, multiword_synonyms, ngrams, tokenize


def show(tokens):
    return ";".join(f"{t.term}:{t.pos_inc}:{t.start},{t.end}" for t in tokens)


STOPPED = Analyzer.standard(ENGLISH_STOP_WORDS)
VERBATIM = Analyzer(lowers=False)
GOLDEN = [
    (STOPPED, "the quick fox", "quick:2:4,9;fox:1:10,13"), (STOPPED, "a the of fox", "fox:4:9,12"), (STOPPED, "the a of", ""), (STOPPED, "The Quick, Brown FOX!", "quick:2:4,9;brown:1:11,16;fox:1:17,20"),
    (Analyzer(folds=True, lowers=False), "café naïve Müller cœur straße", "cafe:1:0,4;naive:1:5,10;Muller:1:11,17;coeur:1:18,22;strasse:1:23,29"),
    (Analyzer.standard().with_folding(), "Café Naïve ÉCOLE", "cafe:1:0,4;naive:1:5,10;ecole:1:11,16"),
    (VERBATIM, "café today", "café:1:0,5;today:1:6,11"), (VERBATIM, "你好世界", "你:1:0,1;好:1:1,2;世:1:2,3;界:1:3,4"), (VERBATIM, "안녕하세요", "안녕하세요:1:0,5"), (VERBATIM, "hello 世界 world", "hello:1:0,5;世:1:6,7;界:1:7,8;world:1:9,14"),
    (VERBATIM, "3.14 U.S.A. don't 1,000", "3.14:1:0,4;U.S.A:1:5,10;don't:1:12,17;1,000:1:18,23"),
    (Analyzer.keyword(), "  hello world  ", "  hello world  :1:0,15"), (Analyzer.keyword(), "", ":1:0,0"),
    (Analyzer.standard(FRENCH_STOP_WORDS), "Le chat et la souris sont dans la maison", "chat:2:3,7;souris:3:14,20;maison:4:34,40"),
]


@pytest.mark.parametrize("k", range(len(GOLDEN)))
def test_tokens(k):
    analyzer, text, want = GOLDEN[k]
    assert show(analyzer.analyze(text)) == want


def test_sizes_of_lists():
    assert len(ENGLISH_STOP_WORDS) == 33 and len(FRENCH_STOP_WORDS) == 154


def test_stemmers():
    english = "caresses:caress ponies:poni ties:tie agreed:agre bled:bled sized:size hopping:hop filing:file sky:sky relational:relat valenci:valenc vietnamization:vietnam gyroscopic:gyroscop bowdlerize:bowdler generalization:general generous:generous arsenal:arsenal commune:commune emergency:emerg universal:univers proceed:proceed skis:ski dying:die gently:gentl only:onli news:news howe:howe don't:don't cats':cat 'tis:tis syzygy:syzygi toy:toy cry:cri controll:control"
    for pair in english.split():
        word, stem = pair.split(":")
        assert porter2(word) == stem, word
    plain = "caresses:caress ponies:poni ties:ti feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat vietnamization:vietnam triplicate:triplic formative:form electriciti:electr hopefulness:hope revival:reviv adoption:adopt bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll Über:Über"
    for pair in plain.split():
        word, stem = pair.split(":")
        assert porter(word) == stem, word


def test_synonyms_and_grams():
    a = Analyzer.standard().with_synonyms({"car": ["auto", "wagon"]})
    assert show(a.analyze("red car")) == "red:1:0,3;car:1:4,7;auto:0:4,7;wagon:0:4,7"
    assert both_ways({"a": ["b", "c"], "b": ["a"]}) == {"a": ["b", "c"], "b": ["a"], "c": ["a"]}
    out = multiword_synonyms(tokenize("new york city hall"), [SynonymRule(("new", "york"), (("ny",),)), SynonymRule(("new", "york", "city"), (("nyc",), ("big", "apple")))])
    assert [(t.term, t.pos_inc, t.pos_len) for t in out] == [("new", 1, 1), ("nyc", 0, 3), ("big", 0, 1), ("york", 1, 1), ("apple", 0, 2), ("city", 1, 1), ("hall", 1, 1)]
    assert [t.term for t in ngrams([Token("abcd", 0, 4)], 2, 3)] == ["ab", "abc", "bc", "bcd", "cd"]
    assert [(t.term, t.pos_inc) for t in ngrams([Token("abc", 0, 3, 2)], 1, 5, edge=True)] == [("a", 2), ("ab", 0), ("abc", 0)]
    assert ngrams([Token("a", 0, 1)], 2, 3) == []
    with pytest.raises(ValueError):
        ngrams([], 3, 2)
    assert fold([Token("Þórr œ ß", 0, 8)])[0].term == "THorr oe ss"


def test_patterns_and_distances():
    assert glob("a*b?\\*c\\") == (r"\A(?s:a.*b.\*c\\)\z", "a") and glob("do\\g")[1] == "dog"
    assert regexp("ab+c|^d$") == (r"\A(?s:a(?:b)+c|\^d\$)\z", "") and regexp("abc*")[1] == "ab" and regexp("[a-c]x{2,3}")[0] == r"\A(?s:[a-c](?:x){2,3})\z"
    assert osa("ca", "abc") == 3 and osa("cat", "cta") == 1 and osa("cat", "cta", False) == 2 and osa("", "abc") == 3


def test_lengths(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select("id", rounded_length(F.col("id")).alias("r")).collect()
    assert all(r.r == rounded_length_of(r.id) for r in rows)
    assert [rounded_length_of(n) for n in (0, 23, 24, 39, 40, 41, 1000)] == [0, 23, 24, 39, 40, 40, 984]
    assert Bm25().idf(4, 2) == pytest.approx(0.6931471805599453)

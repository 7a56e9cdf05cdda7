"""The Porter (1980) and English (Porter2) stemmers, from their published descriptions."""

from __future__ import annotations

import re



def _shape(stem: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _m(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# Suffixes and what they become.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, pairs) -> tuple[str, str] | None:
    return max((p for p in pairs if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)


def porter(w: str) -> str:
    """The stem of a word of a-z; other words, and those of one or two letters, stay."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _m(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for pairs in (_STEP2, _STEP3):
        if (p := _longest(w, pairs)) and _m(w[: -len(p[0])]) > 0:
            w = w[: -len(p[0])] + p[1]
    if p := _longest(w, [(s, "") for s in _STEP4]):
        stem = w[: -len(p[0])]
        if _m(stem) > 1 and (p[0] != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e") and (_m(w[:-1]) > 1 or (_m(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w


# Fixed values of the English stemmer: exceptions, and words that stay after step 1a.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_STAY = frozenset("sky news howe atlas cosmos bias andes".split())
_STAY_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_E2 = (("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ational", "ate"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("ogi", "og"), ("fulli", "ful"), ("lessli", "less"), ("li", ""))
_E3 = (("tional", "tion"), ("ational", "ate"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", ""))
_E4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _regions(w: str) -> tuple[int, int]:
    start = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if start is None:
        m = re.search("[aeiouy][^aeiouy]", w)
        start = m.end() if m else len(w)
    m = re.compile("[aeiouy][^aeiouy]").search(w, start)
    return start, m.end() if m else len(w)


def _short_syllable(w: str) -> bool:
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch("[aeiouy][^aeiouy]", w))


def porter2(w: str) -> str:
    """The English stem of a word of a-z and apostrophes; other words stay."""
    if not re.fullmatch("[a-z']+", w):
        return w
    if len(w) < 3:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    if w in _STAY:
        return w
    w = w.removeprefix("'")
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = next((w[: -len(s)] for s in ("'s'", "'s", "'") if w.endswith(s)), w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _STAY_1A:
        return w
    p = _longest(w, [(s, "") for s in ("eed", "eedly", "ed", "edly", "ing", "ingly")])
    if p and p[0].startswith("ee"):
        if len(w) - len(p[0]) >= r1:
            w = w[: -len(p[0])] + "ee"
    elif p and re.search("[aeiouy]", w[: -len(p[0])]):
        w = w[: -len(p[0])]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    if (p := _longest(w, _E2)) and len(w) - len(p[0]) >= r1:
        stem = w[: -len(p[0])]
        if p[0] == "ogi":
            w = stem + p[1] if stem.endswith("l") else w
        elif p[0] == "li":
            w = stem if stem[-1:] in tuple("cdeghkmnrt") else w
        else:
            w = stem + p[1]
    if (p := _longest(w, _E3)) and len(w) - len(p[0]) >= r1 and (p[0] != "ative" or len(w) - len(p[0]) >= r2):
        w = w[: -len(p[0])] + p[1]
    if (p := _longest(w, [(s, "") for s in _E4])) and len(w) - len(p[0]) >= r2 and (p[0] != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(p[0])]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()

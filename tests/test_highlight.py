from siftwell.operators.highlight import FragmentConfig, fragments, sentence_starts


def test_fragments():
    text = "The quick brown fox jumps over the lazy dog near the river bank"
    a = text.index("fox")
    assert fragments(text, [(a, a + 3, "fox")], FragmentConfig(window=5)) == [("brown <b>fox</b> jumps", ["fox"])]
    d = text.index("dog")
    two = fragments(text, [(d, d + 3, "dog"), (a, a + 3, "fox")], FragmentConfig(window=5))
    assert [t for t, _ in two] == ["brown <b>fox</b> jumps", "lazy <b>dog</b> near"]
    assert [t for t, _ in fragments(text, [(a, a + 3, "fox"), (d, d + 3, "dog")], FragmentConfig(window=40))] == ["The quick brown <b>fox</b> jumps over the lazy <b>dog</b> near the river bank"]
    assert len(fragments(text, [(a, a + 3, "fox"), (d, d + 3, "dog")], FragmentConfig(window=1, most=1))) == 1
    assert fragments("", [(0, 1, "x")]) == fragments(text, []) == fragments(text, [(-1, 2, "x"), (5, 3, "x"), (900, 901, "x")]) == []
    assert fragments("héé ça", [(4, 99, "ça")], FragmentConfig(pre="[", post="]"))[0][0] == "héé [ça]"


def test_sentences():
    text = 'Mr. Smith left. He met Dr. Who on the 21st. "Stop." Then it was e.g. over! End'
    assert [text[s:].split()[0] for s in sentence_starts(text)] == ["Mr.", "He", "Then", "End"]
    a = text.index("met")
    got = fragments(text, [(a, a + 3, "met")], FragmentConfig(window=3, sentences=True))[0][0]
    assert got.startswith("He <b>met</b> Dr. Who on the 21st.")

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftwell.llm import _pieces, bpe, packing

SCHEMA = "doc_id long, text string, ids string"
PARTS = ["'s", "'t", "'re", "'RE", "'ll", "'x", "'", "a", "B", "é", "É", "ß", "東", "١", "1", "23", " ", "  ", "\n", "\t", " ", " ", "!", "?!", "😀", "́", "İ", "Σ", "<|endoftext|>", "<|startoftext|>", "<|", "s", "re", "aaa", "ʼ", "_", "\x00", "\x85", "\x1c", "the", "ing", "é", "Å"]


def texts(n=1500):
    rng = random.Random(4)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 18))) for _ in range(n)] + ["", "a" * 3000, "x y " * 200_000, "Ünïcödé " * 50]


@pytest.fixture(scope="module")
def byte_codec():
    return bpe.Encoder(json.load(open(public_tokenizers.path("byte_bpe_50k.json"))), _pieces.character_classes())


@pytest.fixture(scope="module")
def decoder():
    return bpe.Decoder(json.load(open(public_tokenizers.path("byte_bpe_50k.json"))))


def test_byte_bpe_equals_the_library(byte_codec, decoder):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t = texts()
    got = byte_codec.encode(t)
    assert got.to_pylist() == [e.ids for e in lib.encode_batch(t, add_special_tokens=False)]
    assert decoder.decode(got).to_pylist() == [lib.decode(i, skip_special_tokens=False) for i in got.to_pylist()] == t
    assert byte_codec.encode([None, "", None]).to_pylist() == [[], [], []]


def test_decoding_what_is_no_text(decoder):
    import pyarrow as pa

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    ids = [[rng.randrange(50_257) for _ in range(rng.randint(0, 9))] for _ in range(500)] + [[]]
    assert decoder.decode(pa.array([*ids, None], pa.list_(pa.int32()))).to_pylist() == [*(lib.decode(i, skip_special_tokens=False) for i in ids), ""]


def test_trie_walk_equals_plain_merging(byte_codec):
    v, rng = byte_codec.vocabulary, random.Random(8)

    def plain(word):
        ids = [v.id[bytes([b])] for b in word]
        while ranks := [(v.rank[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in v.rank]:
            _, k = min(ranks)
            ids[k : k + 2] = [v.id[v.bytes[ids[k]] + v.bytes[ids[k + 1]]]]
        return ids

    words = [bytes(rng.choices(b"abcehinorst ", k=rng.randint(1, 14))) for _ in range(3000)] + [b"aaaaaaa", b"", b"aaaa"]
    assert v.encode_words(words) == [plain(w) for w in words]


def test_table_survives_clearing_and_collisions(byte_codec):
    t = _pieces.PieceTable(lambda ps: [[len(p)] for p in ps], most=3)
    t.hashes = lambda cp, s, e: np.full(len(s), 1 << 60, np.uint64)  # every piece collides
    for text in ("ab cd efg", "x yy zzz wwww", "ab x"):
        cp = _pieces.code_points(text + chr(_pieces.END))
        s, e = _pieces.byte_level_pieces(cp, byte_codec.classes[cp])
        assert t.ids_of(t.lookup(cp, s, e)).tolist() == (e - s).tolist()


def test_bpe_frames(spark):
    tok = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "one two", "clash"), (1, "one two", None), (2, None, ""), (None, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = bpe.decode(bpe.encode(docs, tok), tok).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, ""), (1, "one two"), (1, "one two"), (2, "")]
    assert bpe.encode(docs.limit(0), tok).count() == 0


def test_op1_against_the_library(spark):
    from siftwell.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op1_bpe"](spark, sf).collect()} == want


def test_word_bpe_equals_the_library():
    raw = open(public_tokenizers.path("word_bpe_49k.json")).read()
    codec = packing.Codec(raw, _pieces.character_classes(), packing.lower_table())
    t = texts()
    got = [x.tolist() for x in codec.encode(t)]
    assert got == [e.ids for e in Tokenizer.from_str(raw).encode_batch(t, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(6))
def test_plans(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 100, 4096])
    h = {rng.randint(1, size): rng.choice([1, 2, 5, 100, 10_000]) for _ in range(rng.randint(1, 200))}
    plans = packing.plan(dict(h), size)
    used = {}
    at = 0
    for p in plans:
        assert p.first == at and p.times > 0 and sum(a * n for a, n in p.parts) <= size
        at += p.times
        for a, n in p.parts:
            used[a] = used.get(a, 0) + n * p.times
    total = sum(a * n for a, n in h.items())
    # first-fit decreasing's bound is far above; most of these fill up
    big = sum(n for a, n in h.items() if 2 * a > size)
    assert used == h and at <= max(big, 1.15 * total / size + 2) + (h and max(h) > size // 3) * 0.25 * total / size


def test_complements_are_exact():
    # pairs, triples and quadruples that fill a sequence exactly
    assert sum(p.times for p in packing.plan({60: 10, 40: 10}, 100)) == 10
    assert sum(p.times for p in packing.plan({50: 7, 30: 7, 20: 7}, 100)) == 7
    assert sum(p.times for p in packing.plan({41: 9, 29: 9, 17: 9, 13: 9}, 100)) == 9
    assert packing.plan({}, 100) == []


def test_packing_frames(spark):
    tok = packing.production_tokenizer(spark)
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "x1", "!", "Épsilon"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 90))), "") for i in range(120)] + [(500, "word " * 900, ""), (1, None, ""), (1, None, ""), (None, "", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack(docs, tok, 128, with_ids=True).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t, _ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, at, tuple(ids[at : at + 128])) for k, at in enumerate(range(0, len(ids), 128))]
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 128
    assert len(by) <= 1.05 * sum(len(w[3]) for w in want) / 128 + 1
    seqs = {r.sequence_id: r.ids for r in packing.sequences(packing.pack(docs, tok, 128, with_ids=True)).collect()}
    assert sum(map(len, seqs.values())) == sum(len(w[3]) for w in want) and max(map(len, seqs.values())) <= 128
    assert packing.pack(docs.limit(0), tok).count() == 0

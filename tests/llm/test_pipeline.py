"""The pipeline on a small corpus against the stages' plain versions."""

import random
import re

import corpus_pipeline
from siftwell.llm import secret_scan
from siftwell.llm.ngram_join import Join
from tests.llm.test_ngram_join import brute as brute_components
from tests.llm.test_quality import brute as brute_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(13)
    words = [f"w{i}x" for i in range(400)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(55, 200)))))
    for i in range(60, 80):
        rows.append((i, rows[i - 60][1]))
    for i in range(80, 100):
        rows.append((i, rows[i - 70][1] + " tail"))
    rows += [(100, "too short"), (101, None), (102, "la la la " * 60), (103, rows[0][1] + ' token = "abcdefgh12345678" end')]
    rows += [(104, rows[30][1].replace(" ", "\n") + " " + "0f" * 20)]
    rows += [(105, " ".join(rng.choices(words, k=90)) + ' password: "abcdefgh12345678" end')]  # no near copy of another
    return [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in rows]


def test_run(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    good = [r for r in rows if not brute_quality(r[1])[5]]
    root = {i: c for i, _, c in brute_components([(r[0], r[1]) for r in good], Join())}
    kept = [r for r in good if root[r[0]] == r[0]]
    ac = secret_scan.automaton()
    clean = {r[0]: secret_scan.redacted(r[1], secret_scan.scan(r[1], ac), "[SECRET]") for r in kept}
    assert len(kept) < len(good) < len(rows) and any("[SECRET]" in t for t in clean.values())

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r.doc_id: r.text for r in docs.collect()} == clean
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(clean)
    from tokenizers import Tokenizer
    import public_tokenizers

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in got) == sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in clean.values())
    assert not re.search("[^a-z_]", "".join(n for n, _ in corpus_pipeline.STAGES))


def test_odd_tables(spark, tmp_path):
    rows = [(1, None, None, None, None, "x"), (None, "", "en", "s", 0, None)]
    for k, data in enumerate((rows, [])):
        spark.createDataFrame(data, SCHEMA + ", kept string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{k}").count() == 0


def test_secrets_gives_workers_small_batches(spark, monkeypatch):
    """Whoever writes the stage's result, its workers get 2000 rows at most."""

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["rows"])

    monkeypatch.setattr(corpus_pipeline, "redact", lambda docs: docs.mapInArrow(sizes, "rows long"))
    docs = spark.range(5000).selectExpr("id AS doc_id", "'a' AS text").coalesce(1)
    rows = [r.rows for r in corpus_pipeline.secrets(spark, docs, "").collect()]
    assert sum(rows) == 5000 and max(rows) <= 2000

"""The pipeline stage by stage on a small corpus with planted cases."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline

WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work number night point home water room mother area money story fact month".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(rng.choice(WORDS, n))
    items = [prose(30) for _ in range(3)]
    texts = {i: prose(80) for i in range(20)}
    texts[20], texts[21] = texts[3], texts[4] + " end"
    texts[22] = prose(40) + " " + items[1].upper() + ". " + prose(40)
    texts[23] = prose(50) + " write to a.b@c.org today " + prose(20)
    texts[24], texts[25], texts[26] = None, "", "1234 5678 !!"
    root = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_drop_and_change_what_they_should(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, gone = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
        gone.append((name, sorted(before - {r.doc_id for r in docs.collect()})))
    assert gone == [("language", [24, 25, 26]), ("near_dup", [20, 21]), ("decontaminate", [22]), ("pii", [])]
    assert "<email>" in docs.filter("doc_id = 23").first().text
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    assert all(last[r.doc_id].piece_ids == library.encode(r.text) and last[r.doc_id].round_trip for r in docs.collect())


def test_whole_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == 21 and out.filter(F.col("n_pieces") != F.size("piece_ids")).isEmpty()


def test_empty_corpus(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

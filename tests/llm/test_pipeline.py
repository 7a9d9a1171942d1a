"""The pipeline's stages on small and odd tables."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from updraft.llm import mixing, near, rules, secrets
from updraft.llm.common import written

SF = "/root/testdata/sf0.001"
LINE = "word one two three four five six seven eight nine ten eleven twelve"


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r.doc_id for r in rules.judge_documents(docs).where("kept").collect()}
    now = written(corpus_pipeline.quality_rules(spark, docs, SF), "a")
    assert {r.doc_id for r in now.collect()} == judged
    kept = {r.doc_id for r in near.classify(now).where("kept").collect()}
    now = written(corpus_pipeline.near_dedup(spark, now, SF), "b")
    assert sorted(r.doc_id for r in now.collect()) == sorted(kept)
    before = now
    now = written(corpus_pipeline.secret_scans(spark, now, SF), "c")
    blobs, _, findings = secrets.scan_history(secrets.history_of(now))
    assert now.count() == before.count() and findings.count() == 0
    levels = mixing.features(now)
    drawn = {r.doc_id for r in mixing.draw(levels, mixing.calibrated(levels)).where("kept").collect()}
    now = written(corpus_pipeline.mixing_weights(spark, now, SF), "d")
    assert {r.doc_id for r in now.collect()} == drawn and now.columns == docs.columns
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(now.select("doc_id", "text").collect())
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == drawn
    for r in out:
        ids = sp.encode(texts[r.doc_id]) + [2]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUDGET", 1.0)
    other = LINE.replace("word", "other") + " and quite another ending of this text here now"
    rows = [(1, LINE, "en", "s", 9), (1, LINE, "en", "s", 9), (1, other, None, None, None), (None, LINE, "en", None, 1),
            (None, None, None, None, None), (7, "", None, "s", 0), (9, LINE + " token=abcdefghijklmnopqrst zz", None, "s", 3),
            (11, "some words of a text with token=abcdefghijklmnopqrst that nobody else has said before", "de", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {"kept": F.lit(1), "salt": F.lit("x"), "node": F.lit(3), "text_key": F.lit(3), "spans": F.lit(3), "row": F.lit(1)})
    for table, want in ((docs, {(1, LINE), (1, other), (11, rows[-1][1].replace("token=abcdefghijklmnopqrst", "[REDACTED]"))}),
                        (docs.where("false"), set())):
        for name, stage in corpus_pipeline.STAGES[:4]:
            table = written(stage(spark, table, SF), name)
            assert table.columns == list(corpus_pipeline.COLUMNS)
        out = table.collect()
        assert len(out) == len(want) and {(r.doc_id, r.text) for r in out} <= want
        assert all(r.n_chars == len(r.text) for r in out if r.doc_id == 11)
        assert corpus_pipeline.sentencepiece(spark, table, SF).count() == len(out)


@pytest.mark.parametrize("limit", [0])
def test_shuffled_joins_give_the_same(spark, monkeypatch, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    monkeypatch.setattr(near, "BROADCAST_IDS", limit)
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", limit)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == want

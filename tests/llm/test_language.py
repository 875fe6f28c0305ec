from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from alertloom.llm import language
from alertloom.llm.queries import op8_language


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = op8_language(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").collect()
    assert {r.held_out for r in got} == {True, False} and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_vectors_bind_permuted_letters():
    encoder = language.Encoder(64, 3)
    bundle = encoder.text_vector("Ab!")
    a, b, gap = (language.letter_vector(c, 64).astype(int) for c in (ord("a"), ord("b"), 0))
    want = gap * np.roll(a, 1) * np.roll(b, 2) + a * np.roll(b, 1) * np.roll(gap, 2)
    assert (bundle == want).all()
    assert (encoder.text_vector("a1b") == encoder.text_vector("A  B")).all()


def test_odd_rows(docs_of, odd_texts):
    got = language.identify(docs_of([*enumerate(odd_texts), (None, "hello"), (1, "hello")])).collect()
    none = {r.doc_id for r in got if r.lang_pred == "und"}
    assert len(got) == len(odd_texts) + 2 and none == {0, 1, 2, 11, 13} and {r.lang_pred for r in got} == {"und", "en"}
    assert language.identify(docs_of([])).count() == 0
    unlabelled = docs_of([(1, "a")]).withColumn("lang", F.lit(None).cast("string"))
    assert [tuple(r) for r in language.identify(unlabelled).collect()] == [(1, False, "und", 0.0)]


def test_sample_is_bounded(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert 800 < language.sampled(rows, 1000).count() < 1200 and language.sampled(rows, 20_000).count() == 20_000

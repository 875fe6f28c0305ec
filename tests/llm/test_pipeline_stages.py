from __future__ import annotations

import importlib.util
from pathlib import Path

from alertloom.llm.queries import QUERIES
from alertloom.session import written
from tests.llm.conftest import SF

spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).parents[2] / "corpus_pipeline.py")
corpus_pipeline = importlib.util.module_from_spec(spec)
spec.loader.exec_module(corpus_pipeline)


def test_stages_take_effect(spark, documents):
    """Every stage keeps the columns and what it should, and the last one packs all that is left."""
    docs, counts = documents, [documents.count()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = written(stage(spark, docs, SF), "test_stage")
        if number < 4:
            assert after.columns == documents.columns
            counts.append(after.count())
            before = {r.doc_id: r.text for r in docs.collect()}
            texts = {r.doc_id: r.text for r in after.collect()}
            assert texts.keys() <= before.keys()
            if number == 1:
                assert texts.keys() == before.keys() and texts != before
            else:
                assert all(before[k] == v for k, v in texts.items())
            docs = after
        else:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect()}
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    assert QUERIES["pipeline"].__name__ == "pipeline"

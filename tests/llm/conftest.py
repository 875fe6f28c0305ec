from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """A documents frame of (doc_id, text) rows with further columns whose names clash with those of operators."""

    def make(rows):
        full = [(i, t, "en", "src", len(t) if t is not None else None, "x", 7) for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, length string, node long")

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and white texts, ties, repeats, long ones and odd characters."""
    return [None, "", " \t\n ", "a", "a", "A", "a b", "word " * 5000, "x" * 30000, "ümläut ÀÉ ß İ ı", "日本語 テスト", "🙂🙂",
            "a\x00b\x1cc", "1 2 3 4", "it's THEY'LL <|endoftext|> x", "é é", "   x"]

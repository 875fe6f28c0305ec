from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from alertloom.llm import bpe
from alertloom.llm.queries import op12_bpe
from tests.llm.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["it's we'll I'M x'sy", "  two   blanks \n\n\nlines\t\tx ", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b!<|endo", "<|", "é² ¾½3 ǀǁ \xa0  x",
       "a\x1c\x1d b\x85c ​", "’s ‘it’s’ … — ½٣४", "\U0001f469‍\U0001f467 ok", "� ﻿x", "word" * 3000, "日本語 テキスト。" * 50]


def expected(rows):
    tokenizer = bpe.load(PATH)
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, documents):
    got = op12_bpe(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected([(r.doc_id, r.text) for r in documents.collect()])


@pytest.mark.parametrize("block_words", [1, 7, 10_000])
def test_odd_rows(docs_of, odd_texts, block_words):
    """Nulls, empty and long texts, repeats, special tokens and rare characters, in blocks of any size."""
    rows = [*enumerate([*odd_texts, *ODD]), (None, "null id"), (None, None), (3, "a"), (3, "a")]
    encoded = bpe.encode(docs_of(rows), PATH, block_words)
    got = [(r.doc_id, len(r.ids) // 4, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
           for r in bpe.decode(encoded, PATH).collect()]
    assert sorted(got, key=str) == expected(rows)
    assert bpe.round_trip(docs_of([]), PATH).count() == 0


def test_parts_between_blanks(docs_of):
    """Random white space around words: parts that are cut once give what whole texts give."""
    draw = random.Random(6)
    pieces = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\x1c", "\x85", "the", "it's", "'s", "x.", "...", "9²", "é", "漢", "<|endoftext|>", "<|"]
    rows = [(i, "".join(draw.choices(pieces, k=draw.randint(0, 14)))) for i in range(1500)]
    assert sorted(map(tuple, bpe.round_trip(docs_of(rows), PATH).collect()), key=str) == expected(rows)


def test_a_word_goes_out_once_per_block(docs_of):
    rows = [(i, " the" * 200 + f" rare{i}") for i in range(40)]
    packs = [r for r in bpe.words_by_block(docs_of(rows), PATH, 300).collect() if r.block is not None]
    assert sum(r.data.count(b" the") for r in packs) == len({r.block for r in packs}) < 30
    assert sorted(map(tuple, bpe.round_trip(docs_of(rows), PATH).collect()), key=str) == expected(rows)


def test_documents_are_cut_once(spark):
    """Both sides of the co-grouping read one exchange."""
    from pyspark.sql import functions as F

    out = bpe.encode(spark.read.parquet(f"{SF}/documents.parquet"), PATH)
    out.agg(F.count(F.lit(1))).collect()
    out = bpe.encode(spark.read.parquet(f"{SF}/documents.parquet"), PATH)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


def test_blocks_that_do_not_belong_together(docs_of):
    import pyarrow as pa

    sent = bpe.words_by_block(docs_of([(1, "one two")]), PATH, 100).toArrow()
    docs, words = sent.filter(sent["block"].is_null()), sent.filter(sent["block"].is_valid())
    ids = bpe.numbers_as_bytes([5])
    wrong = pa.table({"numbers": words["numbers"], "sizes": pa.array([b"\x01"] * len(words), pa.binary()),
                      "data": pa.array([ids] * len(words), pa.binary())})
    with pytest.raises(ValueError, match="belong|not those"):
        bpe.fill(bpe.byte_pieces(bpe.load(PATH)), docs, wrong)


def test_words_join_to_the_tokenizer(spark):
    """Random strings: a text's ids are those of its words, and pieces give the bytes back."""
    tokenizer, draw = bpe.load(PATH), random.Random(3)
    words, pieces = bpe.word_splitter(tokenizer), bpe.byte_pieces(tokenizer)
    letters = "ab'sltrevdm  \t\n\r.,!?<|>09²é\xa0　\x1cß漢🙂́\x00"
    for _ in range(3000):
        text = "".join(draw.choices(letters, k=draw.randint(0, 40)))
        parts = words(text)
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert "".join(parts) == text
        assert [i for w in parts for i in tokenizer.encode(w, add_special_tokens=False).ids] == ids
        assert b"".join(pieces[i] for i in ids).decode() == text


def test_numbers_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 2**31 - 1])
    data, size = bpe.to_bytes(values)
    back, last = bpe.from_bytes(data)
    assert back.tolist() == values.tolist() and (np.cumsum(size) - 1).tolist() == last.tolist()


def test_decode_of_broken_bytes(spark):
    tokenizer = bpe.load(PATH)
    ids = tokenizer.encode("é🙂", add_special_tokens=False).ids[:-1]
    frame = spark.createDataFrame([(1, bytearray(np.array(ids, "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in bpe.decode(frame, PATH).collect()}
    assert got == {1: tokenizer.decode(ids, skip_special_tokens=False), 2: ""}


def test_bytes_are_made_for_many_rows_at_once(monkeypatch):
    """Neither packs nor documents cost a call each."""
    calls, plain = [], bpe.to_bytes
    monkeypatch.setattr(bpe, "to_bytes", lambda values: calls.append(len(values)) or plain(values))
    words = [f" w{i}" for i in range(3000)]
    codes = bpe.array("i", [i % 3000 for i in range(40_000)])
    rows = pa.Table.from_batches(bpe.block_rows(7, [(d, 40) for d in range(1000)], words, codes))
    assert len(calls) < 10
    docs, packs = rows.filter(pc.is_null(rows["block"])), rows.filter(pc.is_valid(rows["block"]))
    assert docs.num_rows == 1000 and packs["route"].to_pylist() == sorted(set(packs["route"].to_pylist()))
    pieces = [w.encode() for w in words]
    ids = {w: i for i, w in enumerate(pieces)}
    back = []
    for sizes, data in zip(packs["sizes"].to_pylist(), packs["data"].to_pylist()):
        ends = np.cumsum(bpe.from_bytes(np.frombuffer(sizes, np.uint8))[0]).tolist()
        own = np.array([ids[data[a:b]] for a, b in zip([0, *ends], ends)])
        back.append((plain(np.ones(len(own), np.int64))[0].tobytes(), plain(own)[0].tobytes()))
    packs = packs.set_column(5, "sizes", pa.array([b[0] for b in back])).set_column(6, "data", pa.array([b[1] for b in back]))
    got = bpe.fill(pieces, docs, packs)
    assert b"".join(got["ids"].to_pylist()) == np.array(codes, "<u4").tobytes() and got["doc_id"].to_pylist() == list(range(1000))

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from alertloom.llm import alignment
from alertloom.llm.queries import op11_alignment
from tests.llm.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|> x <s> </s> <unk>", "a▁b", "  two  blanks ", "\n\n", "é² ¾ \xa0x", "日本語 テキスト。", "🙂🙂 ok", "x" * 3000, " " * 700 + "y", "ﬁ ½ Å"]


def byte_letters():
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


def expected(rows):
    """All links by comparing byte ranges one by one."""
    letters, a_model = byte_letters(), Tokenizer.from_file(A)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=B)

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    linked, out = [], []
    for _, text in rows:
        if not text:
            linked.append(None)
            continue
        a = a_model.encode(" " + text, add_special_tokens=False).ids
        b = b_model.encode(text)
        a_parts = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        b_parts = [b_bytes(i) for i in b]
        said = (" " + text).encode()
        if b"".join(a_parts) != said or b"".join(b_parts) != said:
            linked.append(None)
            continue
        spans = [[(sum(map(len, parts[:0])), 0)] for parts in (a_parts, b_parts)]
        for held, parts in zip(spans, (a_parts, b_parts)):
            held.clear()
            at = 0
            for p in parts:
                held.append((at, at + len(p)))
                at += len(p)
        links, j = [], 0
        for i, (low, high) in enumerate(spans[0]):
            while spans[1][j][1] <= low:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < high:
                links.append((a[i], b[k]))
                k += 1
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for end in common:
            groups.append("|".join(",".join(str(ids[n]) for n, (s, e) in enumerate(span) if low <= s and e <= end)
                                   for ids, span in ((a, spans[0]), (b, spans[1]))))
            low = end
        linked.append((len(a), len(b), len(common), links, ";".join(groups)))
    counts = Counter(pair for found in linked if found for pair in found[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for (doc_id, _), found in zip(rows, linked):
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, groups = found
            out.append((doc_id, n_a, n_b, n_groups, len(links), sum(counts[p] == most[p[1]] for p in links),
                        sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, documents):
    docs = documents.select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in docs if len(r.text or "") < 1500][:60]
    frame = spark.createDataFrame(short, "doc_id long, text string")
    got = alignment.alignment_digest(frame, A, B)
    assert sorted(map(tuple, got.collect()), key=str) == expected(short)
    every = op11_alignment(spark, SF)
    assert every.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = every.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links <= r.count_sum for r in rows)


def test_odd_rows_in_small_blocks(docs_of, odd_texts):
    """Nulls, empty and long texts, repeats, ties and characters that a tokenizer changes; blocks of any size."""
    rows = [*enumerate([*odd_texts, *ODD, "the cat the cat the cat"]), (None, "null id"), (None, None), (3, "a b"), (3, "a b")]
    want = expected(rows)
    for block_postings in (1, 50, 10_000):
        got = alignment.align_documents(docs_of(rows), A, B, block_postings).collect()
        got = [(*tuple(r)[:7], hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else r.groups) for r in got]
        assert sorted(got, key=str) == want
    assert alignment.alignment_digest(docs_of([]), A, B).count() == 0


def test_pair_counts(docs_of):
    rows = [(i, "the cat" if i % 3 else "the cat the cat the cat the") for i in range(9)]
    index = alignment.align(docs_of(rows), A, B, 5).cache()
    want = expected(rows)
    counts = alignment.pair_counts(index).collect()
    assert sum(r.links for r in counts) == sum(r[4] for r in want)
    assert max(r.documents for r in counts) == 9 and max(r.links for r in counts) == 6 + 3 * 4
    index.unpersist()


def test_planes_hold_the_multiplicities():
    draw = np.random.default_rng(5)
    held = Counter()
    for _ in range(3000):
        held[int(draw.integers(7)), int(draw.integers(40))] += int(draw.integers(1, 9))
    keys = sorted(held)
    pairs, places = (np.array([k[i] for k in keys]) for i in (0, 1))
    back, docs = Counter(), Counter()
    for pair, plane, popcount, documents, data, size in alignment.planes(pairs, places, np.array([held[k] for k in keys])):
        at = np.cumsum(size) - size
        parts = [data[a:a + n].tobytes() for a, n in zip(at, size)]
        found, (own, bits) = alignment.spread(parts, [pair, plane])
        assert np.bincount(own, minlength=7)[pair].tolist() == popcount.tolist()
        for p, place, k in zip(own.tolist(), found.tolist(), bits.tolist()):
            back[p, place] += 1 << k
        for p, n in zip(pair.tolist(), documents.tolist()):
            docs[p] += n
    assert back == held and docs == Counter(k[0] for k in keys)


def test_rank_encoder_equals_the_tokenizer():
    tokenizer, draw = Tokenizer.from_file(A), random.Random(9)
    tokenizer.encode_special_tokens = True
    encode, _ = alignment.a_encoder(A)
    letters = "ab'sltrevdm  \t\n\r.,!?<|endoftext|>09²é\xa0　\x1cß漢🙂́\x00"
    for _ in range(3000):
        text = "".join(draw.choices(letters, k=draw.randint(0, 40)))
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids

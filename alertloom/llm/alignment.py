"""Alignment of two tokenizers' tokens over the bytes of the same texts.

1. One scan encodes every text with both tokenizers, cuts the tokens into groups where
   both end at the same byte, and finds the links: pairs of tokens whose bytes overlap.
2. Documents are gathered in blocks.  A block turns its links into an inverted index:
   for every id pair the bitmap of the documents where it is linked, as one plane for each
   bit of its multiplicity there (plane k holds the documents whose count has bit k), each
   compressed to the gaps between its documents.  The index is written once.
3. The popcounts of the planes, weighted by 2 ** k, are summed for a pair's links, and those
   of the planes' union for its documents; the best pairs of a B id have its highest count.
4. The postings take their pair's score back to their block, where sums by document arise
   in arrays of a block's documents, however many pairs there are.

A pair that is in a third of all links is one row per plane and block.  No text is moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.bpe import RARE, byte_pieces, from_bytes, load, to_bytes
from alertloom.llm.common import narrow, whole
from alertloom.session import written

BLOCK_POSTINGS = 4_000_000
BLOCK_DOCS = 1 << 16
ROWS = 50_000
DOC_ROWS = 500
DOC_FIELDS = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
PAIR_FIELDS = "a int, b int, plane int, popcount long, documents long, bitmap binary"
NAMES = [field.split()[0] for field in f"{DOC_FIELDS}, {PAIR_FIELDS}".split(", ")]

# Fixed: the pattern that cuts a text into words before the merges of tokenizer A.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Long runs are left to the slower of two encoders, whose time grows in proportion.
LONG = re.compile(r"\s{500}|\S{2000}")


def a_encoder(path: str):
    """A function from text to A's ids, with strings of special tokens as plain text, and the bytes of every id.

    Ordinary texts go through the rank encoder, which is faster and gives the same ids.
    """
    import tiktoken

    tokenizer = load(path)
    pieces = byte_pieces(tokenizer)
    tokenizer.encode_special_tokens = True
    special = tokenizer.get_added_tokens_decoder()
    ranks = tiktoken.Encoding("a", pat_str=WORDS, special_tokens={},
                              mergeable_ranks={p: i for i, p in enumerate(pieces) if i not in special})

    def encode(text: str) -> list[int]:
        if RARE.search(text) or LONG.search(text):
            return tokenizer.encode(text, add_special_tokens=False).ids
        return ranks.encode_ordinary(text)

    return encode, pieces


def b_encoder(path: str):
    """A function from text to B's ids, and the bytes of every id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
              else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    return lambda text: model.encode(text), pieces


def aligner(a_path: str, b_path: str):
    """A function from text to (n_a, n_b, n_groups, groups, pair code of every link), None without tokens.

    A pair's code is its A id times the size of B's vocabulary, plus its B id.
    """
    (a_encode, a_pieces), (b_encode, b_pieces) = a_encoder(a_path), b_encoder(b_path)
    a_size, b_size = (np.array(list(map(len, pieces)), np.int64) for pieces in (a_pieces, b_pieces))
    spelled = [f"{i}{mark}" for n, marks in ((len(a_pieces), ",|"), (len(b_pieces), ",;")) for i in range(n) for mark in marks]

    def align(text: str):
        if not text:
            return None
        a, b, said = a_encode(" " + text), b_encode(text), (" " + text).encode()
        if b"".join(map(a_pieces.__getitem__, a)) != said or b"".join(map(b_pieces.__getitem__, b)) != said:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        a_met = b_end[np.searchsorted(b_end, a_end)] == a_end
        b_met = a_end[np.searchsorted(a_end, b_end)] == b_end
        ends = np.sort(np.concatenate([a_end, b_end[~b_met]]))
        codes = a[np.searchsorted(a_end, ends)] * len(b_pieces) + b[np.searchsorted(b_end, ends)]
        a_last, b_last = np.flatnonzero(a_met), np.flatnonzero(b_met)
        a_group, b_group = np.cumsum(a_met) - a_met, np.cumsum(b_met) - b_met
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], b_last[:-1] + 1])[a_group]] = 2 * a + a_met
        order[np.arange(len(b)) + (a_last + 1)[b_group]] = 2 * (len(a_pieces) + b) + b_met
        return len(a), len(b), len(a_last), "".join(map(spelled.__getitem__, order.tolist()))[:-1], codes

    return align, len(b_pieces)


def planes(pairs: np.ndarray, places: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(pair, plane, popcount, documents, bitmap bytes, size of each bitmap) of postings sorted by pair and place.

    ``documents``, the popcount of the union of a pair's planes, stands with its lowest plane.
    """
    known, of = np.unique(pairs, return_inverse=True)
    documents = np.bincount(of, minlength=len(known))
    for plane in range(int(times.max(initial=0)).bit_length()):
        here = np.flatnonzero(times >> plane & 1)
        if not len(here):
            continue
        first = np.flatnonzero(np.diff(of[here], prepend=-1))
        gaps = np.diff(places[here], prepend=0)
        gaps[first] = places[here][first]
        data, size = to_bytes(gaps)
        own = of[here][first]
        yield (known[own], np.full(len(own), plane), np.diff(np.append(first, len(here))), documents[own], data,
               np.add.reduceat(size, first))
        documents[own] = 0


def spread(data: list[bytes], weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The document places of some bitmaps, and each bitmap's weights once for every one of its documents."""
    gaps, last = from_bytes(np.frombuffer(b"".join(data), np.uint8))
    count = np.diff(np.searchsorted(last, np.concatenate([[0], np.cumsum(list(map(len, data)))])))
    ended = np.cumsum(gaps)
    places = ended - np.repeat(np.concatenate([[0], ended])[np.cumsum(count) - count], count)
    return places, [np.repeat(w, count) for w in weights]


def doc_batch(docs: list[tuple]) -> pa.RecordBatch:
    n = len(docs)
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string()]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, k) for c, k in zip(zip(*docs), kinds)), *[pa.nulls(n, pa.int32())] * 3, *[pa.nulls(n, pa.int64())] * 2,
         pa.nulls(n, pa.binary())], NAMES)


def pair_batches(block: int, held: list[tuple[np.ndarray, np.ndarray]], b_ids: int) -> Iterator[pa.RecordBatch]:
    """The index of a block; ``held`` has pairs and multiplicities of its documents, by place."""
    pairs = np.concatenate([p for p, _ in held])
    places = np.repeat(np.arange(len(held)), [len(p) for p, _ in held])
    order = np.argsort(pairs, kind="stable")
    for pair, plane, popcount, documents, data, size in planes(pairs[order], places[order], np.concatenate([t for _, t in held])[order]):
        end = np.cumsum(size)
        for low in range(0, len(pair), ROWS):
            part = slice(low, low + ROWS)
            n, top = len(pair[part]), min(low + ROWS, len(pair))
            at = np.concatenate([[0], end[part] - (end[low] - size[low])]).astype(np.int32)
            bitmap = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(data[end[low] - size[low]:end[top - 1]].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.int64())] * 5, pa.nulls(n, pa.string()),
                 pa.array((pair[part] // b_ids).astype(np.int32)), pa.array((pair[part] % b_ids).astype(np.int32)),
                 pa.array(plane[part].astype(np.int32)), pa.array(popcount[part]), pa.array(documents[part]), bitmap], NAMES)


def align(documents: DataFrame, a_path: str, b_path: str, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Rows of two kinds: documents with their groups (``a`` is null), and the index of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align_text, b_ids = aligner(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        docs, held, postings = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = align_text(text.as_py())
                if found:
                    n_a, n_b, n_groups, groups, codes = found
                    docs.append((block, len(held), doc_id, n_a, n_b, n_groups, len(codes), groups))
                    held.append(np.unique(codes, return_counts=True))
                    postings += len(held[-1][0])
                else:
                    docs.append((block, len(held), doc_id, 0, 0, 0, 0, ""))
                    held.append((np.empty(0, np.int64), np.empty(0, np.int64)))
                if len(docs) >= DOC_ROWS:
                    yield doc_batch(docs)
                    docs = []
                if postings >= block_postings or len(held) >= BLOCK_DOCS:
                    yield from pair_batches(block, held, b_ids)
                    block, held, postings = block + 1, [], 0
                    if docs:
                        yield doc_batch(docs)
                        docs = []
        if docs:
            yield doc_batch(docs)
        if held:
            yield from pair_batches(block, held, b_ids)

    return narrow(documents).select("doc_id", whole().alias("text")).mapInArrow(run, f"{DOC_FIELDS}, {PAIR_FIELDS}")


def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, documents and links of every id pair, and whether its links are the most of its B id (``best``).

    A B id has at most as many pairs as A has ids, so its window is bounded.
    """
    counts = index.filter("a IS NOT NULL").groupBy("a", "b").agg(
        F.sum("documents").alias("documents"), F.sum(F.expr("shiftleft(popcount, plane)")).alias("links"))
    return counts.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def returned(index: DataFrame, counts: DataFrame) -> DataFrame:
    """block, place, n_best and count_sum of the documents with links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, total = None, None, None

        def out() -> pa.RecordBatch:
            places = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(places), block)), pa.array(places.astype(np.int32)), pa.array(best[places]), pa.array(total[places])],
                ["block", "place", "n_best", "count_sum"])

        for batch in batches:
            marks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if marks[low] != block:
                    if block is not None:
                        yield out()
                    block, best, total = marks[low], np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
                part = batch.slice(low, high - low)
                plane = part.column("plane").to_numpy().astype(np.int64)
                score = part.column("links").to_numpy() << plane
                is_best = part.column("best").to_numpy(zero_copy_only=False).astype(np.int64) << plane
                places, (score, is_best) = spread(part.column("bitmap").to_pylist(), [score, is_best])
                np.add.at(total, places, score)
                np.add.at(best, places, is_best)
        if block is not None:
            yield out()

    postings = index.filter("a IS NOT NULL").select("block", "a", "b", "plane", "bitmap").join(
        counts.select("a", "b", "links", "best"), ["a", "b"]).select("block", "plane", "bitmap", "links", "best")
    return postings.repartition("block").sortWithinPartitions("block").mapInArrow(
        run, "block long, place int, n_best long, count_sum long")


def align_documents(documents: DataFrame, a_path: str, b_path: str, block_postings: int = BLOCK_POSTINGS,
                    groups: Column | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row of documents.

    ``groups`` spells the groups as ``a1,a2|b1;a3|b2,b3`` by ids; an expression over them may
    be given in its place, so that only its value is kept.  n_best counts the links whose
    pair has the most links of its B id (ties included), count_sum sums their pairs' links.

    A text that is null or empty, or that a tokenizer does not give back byte for byte, has
    no tokens: zeros and an empty string.  Repeated rows come out as often as they come in and
    all count; a null doc_id is carried along; further columns are ignored; an empty table
    gives an empty result.  Texts are read whole; one with very many links is a block of its own.
    """
    rows = align(documents, a_path, b_path, block_postings)
    index = written(rows if groups is None else rows.withColumn("groups", groups), "alignment")
    scores = returned(index, pair_counts(index))
    return index.filter("a IS NULL").join(scores, ["block", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups")


def alignment_digest(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``align_documents`` with groups_sha256 in place of the groups; empty without tokens."""
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return align_documents(documents, a_path, b_path, groups=digest).withColumnRenamed("groups", "groups_sha256")

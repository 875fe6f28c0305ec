"""Byte-level BPE through distinct words, and back through the pieces of the ids.

A text is cut into the words that the tokenizer never merges across, so its ids follow
from those of its words:

1. Tasks cut documents into words and gather blocks of about ``block_words`` words.  A block
   numbers its distinct words, the most frequent first.  It sends the words in packs, one for
   each of ``ROUTES`` shares of all words, and every document as the numbers of its words.
   One exchange deals out both: packs by their share, documents by the block.
2. A share's packs of all blocks lie together after a sort inside the partition, and each
   distinct word of the share is encoded once.  A word that fills a third of all texts
   is there once per block.
3. Numbers and ids of the words go back to their block; there the documents take the ids in
   by position (a co-grouping, one block at a time).
4. Decoding looks every id's piece up in the vocabulary, whose size is fixed.

The texts themselves are never moved, nothing is broadcast, and a task holds one block, or the
distinct words of one share, at most.  Blocks are made in the order of the rows, so a task
that runs again must read documents in the same order, as it does from files; a block whose
parts do not belong together raises an error.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from alertloom.llm.common import narrow, whole

BLOCK_WORDS = 5_000_000
ROUTES = 1 << 14
ROWS = 5_000
AT_ONCE = 500_000
PACKS_AT_ONCE = 1_000
SENT = "route long, block long, place long, doc_id long, numbers binary, sizes binary, data binary"
NAMES = ["route", "block", "place", "doc_id", "numbers", "sizes", "data"]

# Fixed: how the tokenizer cuts a text into words, for the characters that COMMON lets through.
WORDS = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+"
                   r"| ?[0-9²³¹¼-¾]+|\s+(?!\S)|\s+")
RARE = re.compile("[^\t\n\r -~¡-ɏ]")


def load(tokenizer_path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def word_splitter(tokenizer):
    """A function from text to its words; a special token of the vocabulary is a word of its own."""
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def plain(text: str) -> list[str]:
        if RARE.search(text):
            return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return WORDS.findall(text)

    def words(text: str) -> list[str]:
        if not any(s in text for s in specials):
            return plain(text)
        return [w for i, part in enumerate(special.split(text)) if part for w in ([part] if i % 2 else plain(part))]

    return words


def byte_pieces(tokenizer) -> list[bytes]:
    """The bytes of every id; a byte's letter is itself if printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    spelled = {i: w for w, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return [added[i].encode() if i in added else bytes(map(byte_of.__getitem__, spelled.get(i, "")))
            for i in range(max(spelled) + 1)]


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in groups of seven bits, the lowest first and all but the last marked: bytes, and each number's size."""
    size = 1 + sum((values >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[start[has] + k] = values[has] >> 7 * k & 127 | (size[has] > k + 1) * 128
    return out, size


def from_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and the place of each one's last byte."""
    last = np.flatnonzero(data < 128)
    if not len(last):
        return last, last
    start = np.concatenate([[0], last[:-1] + 1])
    shift = 7 * (np.arange(len(data)) - np.repeat(start, last - start + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, start), last


def parts_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the size of every value."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8), np.array(list(map(len, values)), np.int64)


def numbers_as_bytes(values) -> bytes:
    return to_bytes(np.fromiter(values, np.int64))[0].tobytes()


def counts_of(last: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many numbers every value holds, from the places of their last bytes and the sizes of the values."""
    return np.diff(np.searchsorted(last, np.concatenate([[0], np.cumsum(sizes)])))


def binary_column(data, ends: np.ndarray) -> pa.Array:
    """A binary column whose values lie one after another."""
    starts = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(starts), pa.py_buffer(data)])


def runs_as_bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column with the numbers of every run as bytes; ``ends`` says where runs end."""
    data, size = to_bytes(values)
    return binary_column(data, np.concatenate([[0], np.cumsum(size)])[ends])


def parts_up_to(ends: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """First and last row (excluded) of parts of at most ``rows`` rows whose items, ended by ``ends``, are at most ``most`` or one row's."""
    first = 0
    while first < len(ends):
        low = ends[first - 1] if first else 0
        last = min(first + rows, max(first + 1, int(np.searchsorted(ends, low + most, "right"))))
        yield first, last
        first = last


def block_rows(block: int, docs: list[tuple[int | None, int]], words: list[str], codes: array) -> Iterator[pa.RecordBatch]:
    """The rows of a block: its distinct words in packs, and its documents, which have no ``block``.

    A document's data is a checksum of the block's words in their order.
    """
    code = np.frombuffer(codes, np.int32)
    order = np.argsort(-np.bincount(code, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words), dtype=np.int32)
    held = [words[i].encode() for i in order.tolist()]
    mark = struct.pack("<I", zlib.crc32(b"".join(held)))
    route = np.fromiter(map(zlib.crc32, held), np.int64, len(held)) % ROUTES
    by_route = np.argsort(route, kind="stable")
    starts = np.flatnonzero(np.diff(route[by_route], prepend=-1))
    gaps = np.diff(by_route, prepend=0)
    gaps[starts] = by_route[starts]
    ends = np.append(starts[1:], len(held)) if len(held) else starts
    for first in range(0, len(starts), ROWS):
        low, own_ends = starts[first], ends[first:first + ROWS]
        part = [held[i] for i in by_route[low:own_ends[-1]].tolist()]
        sizes, n = np.fromiter(map(len, part), np.int64, len(part)), len(own_ends)
        yield pa.RecordBatch.from_arrays([
            pa.array(route[by_route[starts[first:first + ROWS]]]), pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
            runs_as_bytes(gaps[low:own_ends[-1]], own_ends - low), runs_as_bytes(sizes, own_ends - low),
            binary_column(b"".join(part), np.cumsum(sizes)[own_ends - low - 1])], NAMES)
    ends = np.cumsum(np.array([n for _, n in docs], np.int64))
    for first, last in parts_up_to(ends, AT_ONCE, ROWS):
        low, n = ends[first - 1] if first else 0, last - first
        yield pa.RecordBatch.from_arrays([
            pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(range(first, last), pa.int64()),
            pa.array([d for d, _ in docs[first:last]], pa.int64()), runs_as_bytes(rank[code[low:ends[last - 1]]], ends[first:last] - low),
            pa.nulls(n, pa.binary()), pa.array([mark] * n, pa.binary())], NAMES)


def words_by_block(documents: DataFrame, tokenizer_path: str, block_words: int) -> DataFrame:
    """``SENT``: a row per document and one per distinct word, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut = word_splitter(load(tokenizer_path))
        block = TaskContext.get().partitionId() << 32
        docs, codes, known = [], array("i"), defaultdict()
        known.default_factory = known.__len__
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                before = len(codes)
                codes.extend(map(known.__getitem__, cut(text.as_py())))
                docs.append((doc_id, len(codes) - before))
                if len(codes) >= block_words:
                    yield from block_rows(block, docs, list(known), codes)
                    block, docs, codes = block + 1, [], array("i")
                    known.clear()
        yield from block_rows(block, docs, list(known), codes)

    return narrow(documents).select("doc_id", whole().alias("text")).mapInArrow(run, SENT)


def encoded_words(packs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The packs with ids in place of words, on the way back to their blocks.

    All packs of a share come one after another, so each of its words is encoded once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        share, known = None, {}
        for batch in batches:
            for first in range(0, batch.num_rows, PACKS_AT_ONCE):
                part = batch.slice(first, PACKS_AT_ONCE)
                route, block, gaps, sizes, data = (part.column(NAMES.index(c)) for c in ("route", "block", "numbers", "sizes", "data"))
                route = route.to_numpy()
                lengths, last = from_bytes((joined := parts_of(sizes))[0])
                ends = np.cumsum(counts_of(last, joined[1]))
                data, cuts = b"".join(data.to_pylist()), np.cumsum(lengths).tolist()
                words = [data[a:b] for a, b in zip([0, *cuts], cuts)]
                if route[0] != share:
                    known = {}
                new = [w for w in dict.fromkeys(words) if w not in known]
                for word, found in zip(new, tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
                    known[word] = found.ids
                ids = list(map(known.__getitem__, words))
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
                share, none = route[-1], pa.nulls(part.num_rows, pa.int64())
                if route[0] != share:  # words of other shares do not come again
                    known = {w: known[w] for w in words[ends[np.searchsorted(route, share) - 1]:]}
                yield pa.RecordBatch.from_arrays([block, block, none, none, gaps, runs_as_bytes(counts, ends), runs_as_bytes(
                    flat, np.concatenate([[0], np.cumsum(counts)])[ends])], NAMES)

    return packs.sortWithinPartitions("route").mapInArrow(run, SENT)


def fill(pieces: list[bytes], docs: pa.Table, packs: pa.Table) -> pa.Table:
    """doc_id and ids of the documents of a block."""
    gaps, held = parts_of(packs["numbers"])
    gaps, last = from_bytes(gaps)
    in_pack = counts_of(last, held)
    ended = np.cumsum(gaps)
    number = ended - np.repeat(np.concatenate([[0], ended])[np.cumsum(in_pack) - in_pack], in_pack)
    flat, sizes = from_bytes(parts_of(packs["data"])[0])[0], from_bytes(parts_of(packs["sizes"])[0])[0]
    lengths, start = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    lengths[number], start[number] = sizes, np.cumsum(sizes) - sizes
    flat, start = flat[places(start, lengths)], np.cumsum(lengths) - lengths  # in the order of the numbers
    mark = struct.pack("<I", zlib.crc32(b"".join(map(pieces.__getitem__, flat.tolist()))))
    if any(own != mark for own in docs["data"].to_pylist()):
        raise ValueError("a block's words are not those of its documents; write documents to files first")
    texts, out = docs["numbers"].to_pylist(), []
    for first, last in parts_up_to(np.cumsum(np.array(list(map(len, texts)), np.int64)), AT_ONCE, ROWS):
        part = texts[first:last]
        numbers, ends = from_bytes(np.frombuffer(b"".join(part), np.uint8))
        own = lengths[numbers]
        ends = np.cumsum(counts_of(ends, np.array(list(map(len, part)))))
        out.append(binary_column(flat[places(start[numbers], own)].astype("<u4"), 4 * np.concatenate([[0], np.cumsum(own)])[ends]))
    return pa.table({"doc_id": docs["doc_id"], "ids": pa.chunked_array(out, pa.binary())})


def places(start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``start``, one run after another."""
    return np.repeat(start - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def encode(documents: DataFrame, tokenizer_path: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit numbers, one after another) of every row.

    Equal to the tokenizer on the whole text without added special tokens; a special
    token's string in a text is that token, as the tokenizer reads it.  Null and empty
    texts have no ids.  Repeated rows come out as often as they come in, a null doc_id is
    carried along, further columns are ignored, and an empty table gives an empty result.
    A text of any length is encoded whole, in a block of its own if it has more words.
    """
    dealt = words_by_block(documents, tokenizer_path, block_words).repartition("route")
    # documents have no block; the task's number keeps the filter above the exchange, so that both sides share it
    docs = dealt.filter(F.coalesce("block", -1 - F.spark_partition_id()) < 0)
    words = encoded_words(dealt.filter(F.coalesce("block", -1 - F.spark_partition_id()) >= 0), tokenizer_path)
    known: list[bytes] = []

    def put_together(docs: pa.Table, packs: pa.Table) -> pa.Table:
        if not known:
            known.extend(byte_pieces(load(tokenizer_path)))
        return fill(known, docs, packs)

    return docs.groupBy("route").cogroup(words.groupBy("route")).applyInArrow(put_together, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Add ``text``: the joined pieces of ``ids`` as UTF-8, with U+FFFD for what is none; special tokens are kept.

    Null ids are as none.  Ids that the vocabulary does not have give nothing.
    """
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = byte_pieces(load(tokenizer_path))
        for batch in batches:
            texts = []
            for ids in batch.column(names.index("ids")):
                numbers = np.frombuffer(ids.as_py() or b"", "<u4")
                texts.append(b"".join(map(pieces.__getitem__, numbers[numbers < len(pieces)].tolist())).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "text"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("text", StringType())]))


def round_trip(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    back = decode(encode(documents, tokenizer_path), tokenizer_path)
    return back.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))

"""Best-fit packing of token pieces into sequences.

The work that grows with the corpus runs in Spark: tokens, the histogram of piece
lengths, and the place of every piece.  The histogram has at most ``capacity`` entries,
whatever the corpus holds, so the plan of the sequences is made from it on the driver:

1. The configuration linear program (cover every length's count with as few patterns
   of total length ``capacity`` as possible) is solved by multiplicative weights.  A
   round prices all patterns at once by an unbounded knapsack over the current weights,
   adds the best pattern, and lowers the weights of the lengths that it covers.
2. Pattern amounts are rounded down.  What is not covered then is put, longest first,
   into the fullest sequence that still has room, whole classes of equal sequences at a
   time, so this too takes steps by lengths and patterns and not by pieces.
3. A piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.common import batches, narrow, whole
from alertloom.session import written

CAPACITY = 2048
ROUNDS = 300
STEP = 0.5
BUCKETS = 256
CACHED_WORDS = 500_000
CACHED_PARTS = 250_000
CACHED_CHARS = 48
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# Texts of these characters are the same after NFC, and lower case changes them one by one.
PLAIN = re.compile("[!-~À-ÖØ-öø-įıĲ-ɏ]+")
# A sign that is a word of its own, since it stands behind a letter or digit.
STOP = re.compile("[a-z0-9ß-öø-ɏ][,.]")
# Fixed: how the tokenizer cuts a lower-cased text into words, for such characters.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^a-z0-9ß-öø-ɏ]+")


def pack_ids(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def word_ids(tokenizer_path: str):
    """A function from text to its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so the ids of a text are
    those of its blank-separated parts.  Parts of plain letters are cut into words here
    and only the merges are left to the tokenizer; all others it encodes itself.  Two
    bounded tables keep the ids of parts and of words.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    merges = tokenizer.model
    letters = byte_letters()
    parts_known: dict[str, bytes] = {}
    parts_older: dict[str, bytes] = {}
    words_known: dict[str, bytes] = {}
    id_of = attrgetter("id")

    def word(text: str) -> bytes:
        ids = words_known.get(text)
        if ids is None:
            spelled = text if text.isascii() else "".join(map(letters.__getitem__, text.encode()))
            ids = pack_ids(map(id_of, merges.tokenize(spelled)))
            if len(words_known) >= CACHED_WORDS:
                words_known.clear()
            if len(text) <= CACHED_CHARS:
                words_known[text] = ids
        return ids

    def part(text: str) -> bytes:
        if not text:
            return b""
        low = text.lower()
        ids = parts_older.get(text) or words_known.get(low)
        if ids is None and STOP.fullmatch(low[-2:]) and (ids := words_known.get(low[:-1])) is not None:
            ids += word(low[-1])
        if ids is None:
            if PLAIN.fullmatch(text) and "<|" not in text:
                ids = b"".join(map(word, WORDS.findall(low)))
            else:
                ids = pack_ids(tokenizer.encode(text, add_special_tokens=False).ids)
        if len(text) <= CACHED_CHARS:
            parts_known[text] = ids
        return ids

    def encode(text: str) -> bytes:
        nonlocal parts_known, parts_older
        if len(parts_known) >= CACHED_PARTS:
            parts_known, parts_older = {}, parts_known
        parts = text.replace("\n", " ").split(" ")
        found = list(map(parts_known.get, parts))
        if None in found:
            found = [part(p) if ids is None else ids for p, ids in zip(parts, found)]
        return b"".join(found)

    return encode


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids and a closing 0, cut only where longer than ``capacity``."""

    def setup():
        encode = word_ids(tokenizer_path)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + b"\0\0\0\0"
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start:start + 4 * capacity]
                    rows.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

        return work

    return batches(narrow(documents).select("doc_id", whole().alias("text")), None, PIECES, setup)


def best_pattern(sizes: np.ndarray, weights: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each size in the pattern of most weight: unbounded knapsack by capacity."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(int(sizes[0]), capacity + 1):
        fits = upto[room]
        gains = value[room - sizes[:fits]] + weights[:fits]
        best = int(gains.argmax())
        if gains[best] > value[room - 1]:
            value[room], last[room] = gains[best], best
        else:
            value[room], last[room] = value[room - 1], -1
    copies, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            copies[last[room]] += 1
            room -= int(sizes[last[room]])
    return copies


def fractional_cover(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS,
                     step: float = STEP) -> list[tuple[np.ndarray, float]]:
    """Patterns and amounts that cover the counts, by multiplicative weights.

    A size's weight is its length share at first and falls as the size is covered; a
    round adds so much of the pattern that the size nearest to its count gets ``step`` of
    what it lacks.  Ends when all is covered or after ``rounds``.
    """
    lacking = counts.astype(float)
    weights = sizes / capacity
    amounts: dict[bytes, list] = {}
    for _ in range(rounds):
        open_ = lacking >= 1
        if not open_.any():
            break
        live = np.flatnonzero(open_)
        copies = np.zeros(len(sizes), np.int64)
        copies[live] = best_pattern(sizes[live], weights[live], capacity)
        used = np.flatnonzero(copies)
        if not len(used):
            break
        reach = float((lacking[used] / copies[used]).min())
        amount = max(reach * step, min(1.0, reach))
        amounts.setdefault(copies.tobytes(), [copies, 0.0])[1] += amount
        lacking[used] -= copies[used] * amount
        weights[used] *= np.exp(-copies[used] * amount / counts[used])
    return [(copies, amount) for copies, amount in amounts.values()]


def sequence_plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS
                  ) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how many sequences of each; they hold all pieces exactly."""
    sizes = np.array(sorted(s for s in histogram if histogram[s] > 0), np.int64)
    if not len(sizes):
        return []
    counts = np.array([histogram[int(s)] for s in sizes], np.int64)
    rest = counts.copy()
    rooms: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for copies, amount in fractional_cover(sizes, counts, capacity, rounds):
        used = np.flatnonzero(copies)
        times = int(min(np.floor(amount + 1e-9), (rest[used] // copies[used]).min()))
        if times > 0:
            rest[used] -= copies[used] * times
            lengths = tuple(int(s) for i in used[::-1] for s in [sizes[i]] * copies[i])
            rooms[capacity - sum(lengths)][lengths] += times
    for size, n in zip(sizes[::-1].tolist(), rest[::-1].tolist()):
        while n > 0:
            room = min((r for r, held in rooms.items() if r >= size and held), default=None)
            if room is None:
                fits = capacity // size
                times, n_in = (n // fits, fits) if n >= fits else (1, n)
                rooms[capacity - size * n_in][(size,) * n_in] += times
                n -= times * n_in
                continue
            lengths, times = next(iter(rooms[room].items()))
            put = min(times, n)
            if put == times:
                del rooms[room][lengths]
            else:
                rooms[room][lengths] -= put
            rooms[room - size][(*lengths, size)] += put
            n -= put
    plan: dict[tuple[int, ...], int] = defaultdict(int)
    for held in rooms.values():
        for lengths, times in held.items():
            if times:
                plan[tuple(sorted(lengths, reverse=True))] += times
    return sorted(plan.items(), reverse=True)


RANK_BITS = 44


def place_table(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length and first rank as one key, first rank, copies, first sequence, offset), by key."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for lengths, times in plan:
        offset = 0
        for size in sorted(set(lengths), reverse=True):
            copies = lengths.count(size)
            rows.append((size << RANK_BITS | used[size], used[size], copies, base, offset))
            used[size] += copies * times
            offset += copies * size
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add ``rank``: the place of a piece among those of its length, from 0.

    A length may be that of a third of all pieces, so pieces are ranked inside buckets
    of their ids, and the buckets' counts give where each begins.
    """
    cut = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    return (
        cut.withColumn("row", F.row_number().over(within)).join(starts, ["length", "bucket"])
        .withColumn("rank", F.col("first") + F.col("row") - 1).drop("bucket", "row", "first")
    )


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.  Null and empty texts give one piece that holds the closing 0 only.  Repeated
    rows are packed as often as they occur; a null doc_id is carried along.  Other
    columns are ignored; an empty table gives an empty result.
    """
    pieces = written(token_pieces(documents, tokenizer_path, capacity), "pieces")
    # at most ``capacity`` rows
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = place_table(sequence_plan(histogram, capacity, rounds))

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        row = table[np.searchsorted(table[:, 0], (length << RANK_BITS) | rank, side="right") - 1]
        copy, at = np.divmod(rank - row[:, 1], row[:, 2])
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        own = [batch.column(batch.schema.get_field_index(c)) for c in names]
        yield pa.RecordBatch.from_arrays([*own, pa.array(row[:, 3] + copy), pa.array(row[:, 4] + at * length)],
                                         [*names, "sequence_id", "offset"])

    return batches(ranked(pieces), place, f"{PIECES}, sequence_id long, offset long")

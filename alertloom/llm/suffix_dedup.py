"""Repeated byte strings by a suffix sort, as Spark jobs over sampled suffixes.

A byte goes if a string of ``span`` bytes that covers it starts anywhere else as well.
Such strings are the windows of the texts; their suffixes are sampled by content: of
the ``seed``-byte strings in a window the one with the least hash is its anchor, so
equal windows have equal anchors, and neighbouring windows share theirs.

1. Anchors are counted by hash; those that occur once have no repeated window.
2. All windows of an anchor lie in one block of bytes around it.  Blocks that are equal
   byte for byte (BLAKE2b digests) are repeated as a whole, however many there are.
3. Blocks that differ but share an anchor are sorted as suffixes from their anchors
   forward, and as reversed prefixes backward, by mergesort.  Two suffixes are compared
   through their longest common extension, found by binary search over prefix
   polynomial hashes; the extensions of neighbours are then verified byte by byte.  A
   window reaching ``o`` bytes before its anchor is repeated where two blocks lie in one
   class at ``span - o`` bytes forward and in one class at ``o`` bytes backward.
4. Anchors with very many different blocks are not put in one task: their windows are
   counted by digest instead, with sums inside tasks first, many neighbouring windows at
   once and fewer only where blocks share the bytes of all of them but differ beside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import batches, keyed
from alertloom.session import written

SPAN = 400
SEED = 48
PART = 1 << 20
POS_BITS = 21
MOST_BLOCKS = 1000
AT_ONCE = (64, 16, 4, 1)
TASK_BYTES = 1_000_000
ROWS_AT_ONCE = 64
FACTOR = 0x9E3779B97F4A7C15 | 1
PRIME = (1 << 31) - 1
BASES = (1_000_003, 777_767_777)


KNOWN_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """FACTOR ** i and its inverse modulo 2 ** 64, made once in a process.

    They are kept in a list, since a cached function would be looked up in the package, which
    executors need not have.
    """
    if KNOWN_POWERS:
        return KNOWN_POWERS[0]
    n = PART + 2 * SPAN + 8
    factor, inverse = np.full(n, FACTOR, np.uint64), np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64)
    factor[0] = inverse[0] = 1
    KNOWN_POWERS.append((np.cumprod(factor), np.cumprod(inverse)))
    return KNOWN_POWERS[0]


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """Hash of every ``seed`` bytes: differences of prefix polynomial sums, brought to one power, and mixed."""
    up, down = powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    values = (sums[seed:] - sums[:-seed]) * down[:len(data) - seed + 1]
    values ^= values >> np.uint64(31)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width``: minima of blocks from their left and right ends."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def anchors_of(text: bytes, span: int = SPAN, seed: int = SEED) -> Iterator[tuple[int, int, int, int]]:
    """(hash, anchor, first window, last window) of every anchor of a text, in parts of bounded size."""
    for start in range(0, len(text) - span + 1, PART):
        data = np.frombuffer(text, np.uint8, min(len(text) - start, PART + span - 1), start)
        hashes = seed_hashes(data, seed)
        low = np.uint64((1 << POS_BITS) - 1)
        ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        chosen = (sliding_least(ranked, span - seed + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.append(first[1:], len(chosen)) - 1
        at = chosen[first]
        yield from zip(hashes[at].view(np.int64).tolist(), (at + start).tolist(), (first + start).tolist(), (last + start).tolist())


def as_bytes(value: pa.Scalar) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


ANCHORS = "anchor long, digest binary, doc_id long, text_key long, at long, first long, last long"


def anchors(documents: DataFrame, span: int, seed: int) -> DataFrame:
    """Every anchor: its hash, the digest of its block, its document, place, first and last window."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        rows: list[tuple] = []
        for doc_id, key, value in zip(ids, keys, batch.column(1)):
            text = as_bytes(value)
            for anchor, at, first, last in anchors_of(text, span, seed):
                block = hashlib.blake2b(text[first:last + span], digest_size=16, salt=(at - first).to_bytes(8, "little"),
                                        person=(last - first).to_bytes(8, "little"))
                rows.append((anchor, block.digest(), doc_id, key, at, first, last))
            if len(rows) > 10_000:
                yield anchor_batch(rows)
                rows = []
        if rows:
            yield anchor_batch(rows)

    return batches(keyed(documents), work, ANCHORS)


def anchor_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary()] + [pa.int64()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["anchor", "digest", "doc_id", "text_key", "at", "first", "last"])


class Suffixes:
    """Suffixes of one byte buffer, compared through prefix polynomial hashes.

    A suffix has a start and its own end, so it never runs into the next block.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.lengths = data, starts, ends - starts
        # sums modulo a 31-bit prime, so that they are kept in 32 bits and products fit 64 bits
        longest = int(self.lengths.max(initial=0))
        self.first, self.second = (prefix_sums(data, base, longest) for base in BASES)

    def hashes(self, of: np.ndarray, lengths: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Hashes of the first ``lengths`` bytes of some suffixes."""
        sums, up = by
        start = self.starts[of]
        return (sums[start + lengths] + (PRIME * PRIME - sums[start].astype(np.int64) * up[lengths])) % PRIME

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of pairs of suffixes, by binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.lengths[a], self.lengths[b])
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.hashes(a[open_], middle, self.first) == self.hashes(b[open_], middle, self.first)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
        # a collision gives too long an extension; a second hash tells, and bytes decide
        for k in np.flatnonzero(self.hashes(a, low, self.second) != self.hashes(b, low, self.second)):
            left, right = (self.data[self.starts[x[k]]:self.starts[x[k]] + low[k]] for x in (a, b))
            low[k] = int(np.argmax(left != right))
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a sorts before b (a prefix before what it begins; equal ones: no)."""
        common = self.extension(a, b)
        ended_a, ended_b = common == self.lengths[a], common == self.lengths[b]
        at_a = self.data[np.minimum(self.starts[a] + common, len(self.data) - 1)]
        at_b = self.data[np.minimum(self.starts[b] + common, len(self.data) - 1)]
        return np.where(ended_a | ended_b, ended_a & ~ended_b, at_a < at_b)

    def order(self) -> np.ndarray:
        """Mergesort from runs of one: all merges of a level at once, each item ranked in the other run by binary search."""
        items = np.arange(len(self.starts))
        width = 1
        while width < len(items):
            place = np.arange(len(items))
            run = place // width
            own = place - run * width
            other = (run ^ 1) * width
            size = np.clip(len(items) - other, 0, width)
            low, high = np.zeros(len(items), np.int64), size.copy()
            is_left = run % 2 == 0
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                mine, theirs = items[open_], items[other[open_] + middle]
                # items of the left run go before equal ones of the right run
                goes = np.where(is_left[open_], self.before(theirs, mine), ~self.before(mine, theirs))
                low[open_[goes]] = middle[goes] + 1
                high[open_[~goes]] = middle[~goes]
            merged = np.empty_like(items)
            merged[(run // 2) * 2 * width + own + low] = items
            items, width = merged, 2 * width
        return items

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common prefix of each suffix with the one before it in the order, verified byte by byte."""
        common = np.zeros(len(order), np.int64)
        if len(order) > 1:
            a, b = order[:-1], order[1:]
            common[1:] = self.extension(a, b)
            longest = int(common.max())
            for offset in range(longest):
                live = np.flatnonzero(common > offset)
                wrong = live[self.data[self.starts[order[live - 1]] + offset] != self.data[self.starts[order[live]] + offset]]
                common[wrong] = offset
        return common


def prefix_sums(data: np.ndarray, base: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial hashes modulo PRIME, and the powers of the base up to the ``longest``.

    The powers are built by doubling: that of a longer prefix joins two shorter pieces.  Sums take
    four bytes for each byte of the data, and no step holds more than a few rows in eight.
    """
    n = len(data)
    up = np.ones(longest + 1, np.int64)
    filled = 1
    while filled <= longest:
        more = min(filled, longest + 1 - filled)
        step = up[filled - 1] * base % PRIME
        up[filled:filled + more] = up[:more] * step % PRIME
        filled += more
    width = 1 << 10
    padded = np.zeros(-(-max(n, 1) // width) * width, np.uint8)
    padded[:n] = data
    rows = padded.reshape(-1, width)
    sums = np.zeros(rows.size + 1, np.int32)
    inside = sums[1:].reshape(rows.shape)
    running = np.zeros(len(rows), np.int64)
    for column in range(width):
        running = (running * base + rows[:, column] + 1) % PRIME
        inside[:, column] = running
    heads = np.zeros(len(rows), np.int64)
    total, jump = 0, pow(base, width, PRIME)
    for row in range(len(rows)):
        heads[row] = total
        total = (total * jump + int(inside[row, -1])) % PRIME
    own = np.array([pow(base, k + 1, PRIME) for k in range(width)], np.int64)
    for row in range(0, len(rows), ROWS_AT_ONCE):
        part = slice(row, row + ROWS_AT_ONCE)
        inside[part] = (heads[part, None] * own[None, :] + inside[part]) % PRIME
    return sums[:n + 1], up


def repeated_windows(blocks: list[bytes], at: np.ndarray, count: np.ndarray, groups: np.ndarray, span: int) -> list[np.ndarray]:
    """For every block the flags of its windows that another block of its group holds too.

    ``at`` is the anchor's place in the block and ``count`` the number of its windows.
    """
    lengths = np.array([len(b) for b in blocks])
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    data = np.frombuffer(b"".join(blocks), np.uint8)
    forward = Suffixes(data, starts + at, starts + lengths)
    backward = Suffixes(data[::-1], len(data) - starts - at, len(data) - starts)
    sides = []
    for suffixes in (forward, backward):
        order = suffixes.order()
        sides.append((order, suffixes.neighbours(order)))
    offsets = np.concatenate([[0], np.cumsum(count)])
    flags = np.zeros(offsets[-1], bool)
    reach_low = at - (count - 1)  # bytes before the anchor of the last window
    for o in range(int(max(0, reach_low.min())), int(at.max()) + 1):
        live = np.flatnonzero((o <= at) & (o >= reach_low))
        if len(live) < 2:
            continue
        classes = [groups[live]]
        for (order, common), need in zip(sides, (span - o, o)):
            label = np.empty(len(blocks), np.int64)
            label[order] = np.cumsum(common < need)
            classes.append(label[live])
        # pairs of class numbers; a class forward fixes the group unless it needs no byte
        sort = np.lexsort(classes)
        ordered = [c[sort] for c in classes]
        same = np.ones(len(live) - 1, bool)
        for c in ordered:
            same &= c[1:] == c[:-1]
        hit = np.zeros(len(live), bool)
        hit[1:] |= same
        hit[:-1] |= same
        found = live[sort[hit]]
        flags[offsets[found] + at[found] - o] = True
    return np.split(flags, offsets[1:-1])


def runs_of(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last index of every run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    return zip(edges[::2].tolist(), (edges[1::2] - 1).tolist())


def cut_spans(documents: DataFrame, span: int = SPAN, seed: int = SEED, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """doc_id, text_key, and the first and last start of repeated windows, in runs."""
    every = anchors(documents, span, seed)
    often = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    kept = written(every.join(often, "anchor"), "anchors")
    blocks = written(kept.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "at", "first", "last")).alias("one")), "blocks")
    kinds = blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    differing = written(blocks.join(kinds, "anchor").select("anchor", "digest", "kinds", "n", "one.*"), "differing")
    whole_blocks = blocks.filter("n > 1").select("anchor", "digest", F.lit(0).alias("low"), (F.col("one.last") - F.col("one.first")).alias("high"))

    # the bytes of one block of each kind
    wanted = differing.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "digest", "kinds", "at", "first", "last")).alias("wanted"))
    texts = keyed(documents)
    source = texts.join(wanted.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_key"] == wanted["text_key"])).select(
        "text", "wanted")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for value, wishes in zip(batch.column(0), batch.column(1)):
            text = as_bytes(value)
            rows = [(w["anchor"], w["digest"], w["kinds"], w["at"] - w["first"], w["last"] - w["first"] + 1,
                     text[w["first"]:w["last"] + span]) for w in wishes.as_py()]
            kinds_ = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds_)],
                                             ["anchor", "digest", "kinds", "at", "count", "block"])

    pieces = batches(source, cut, "anchor long, digest binary, kinds long, at long, count long, block binary")
    pieces = written(pieces, "block_bytes")
    found = sorted_blocks(pieces.filter(F.col("kinds") <= most_blocks), span).union(
        counted_windows(pieces.filter(F.col("kinds") > most_blocks), span)).union(whole_blocks)
    return kept.join(found, ["anchor", "digest"]).select(
        "doc_id", "text_key", (F.col("first") + F.col("low")).alias("first"), (F.col("first") + F.col("high")).alias("last"))


def sorted_blocks(pieces: DataFrame, span: int) -> DataFrame:
    """anchor, digest, low and high: runs of repeated windows, by suffix sorts inside tasks.

    All blocks of an anchor are in one task and are few; a task sorts the blocks of many anchors together.
    """

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in incoming:
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                if size > TASK_BYTES and held and row[0] != held[-1][0]:
                    yield from settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from settle(held)

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, groups = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        flags = repeated_windows([r[4] for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), groups, span)
        out = [(r[0], r[1], low, high) for r, f in zip(rows, flags) for low, high in runs_of(f)]
        if out:
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["anchor", "digest", "low", "high"])

    return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        work, "anchor long, digest binary, low long, high long")


def counted_windows(pieces: DataFrame, span: int) -> DataFrame:
    """The same for anchors with very many blocks: neighbouring windows are counted together by digest.

    Windows that begin at about the same distance before their anchor have a core of bytes in common.
    Those of two blocks are repeated as a whole if all their bytes are equal, none of them is if their
    cores differ, and otherwise they are counted again in smaller groups, down to single windows.
    """
    parts = pieces.select("anchor", "digest", F.lit(0).cast("long").alias("low"), F.col("count").alias("size"), "at", F.col("block").alias("bytes"))
    found = None
    for width in [w for w in AT_ONCE if 2 * w <= span or w == 1]:
        groups = written(batches(parts, grouped_by(width, span), GROUPS), "windows")
        kinds = written(groups.groupBy("core", "whole").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("anchor", "digest", "low", "size", "at", "bytes")).alias("one")), "kinds")
        same = groups.join(kinds.filter("n > 1").select("core", "whole"), ["core", "whole"], "left_semi").select(
            "anchor", "digest", "low", (F.col("low") + F.col("size") - 1).alias("high"))
        found = same if found is None else found.union(same)
        shared = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("core")
        parts = kinds.join(shared, "core", "left_semi").select("one.*")  # one of equal ones is enough, as all windows of those are found
    return found


GROUPS = "core binary, whole binary, anchor long, digest binary, low long, size long, at long, bytes binary"
GROUP_NAMES = [column.split()[0] for column in GROUPS.split(", ")]
GROUP_KINDS = [pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def grouped_by(width: int, span: int):
    """Cuts windows into those that begin the same number of times ``width`` bytes before the anchor."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for anchor, digest, low, size, at, data in zip(*(column.to_pylist() for column in batch.columns)):
            first = 0
            while first < size:
                group = (at - first) // width
                last = min(at - group * width, size - 1)
                own, begin = data[first:last + span], at - group * width
                place = anchor.to_bytes(8, "little", signed=True)
                core = hashlib.blake2b(data[begin:begin + span - width + 1], digest_size=16, salt=place, person=group.to_bytes(8, "little"))
                whole = hashlib.blake2b(own, digest_size=16, salt=(at - first).to_bytes(8, "little"), person=(last - first).to_bytes(8, "little"))
                rows.append((core.digest(), whole.digest(), anchor, digest, low + first, last - first + 1, at - first, own if width > 1 else b""))
                first = last + 1
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), GROUP_KINDS)], GROUP_NAMES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), GROUP_KINDS)], GROUP_NAMES)

    return work


def kept_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def without_repeats(documents: DataFrame, span: int = SPAN, seed: int = SEED, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """A row per row of ``documents``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    Texts are UTF-8 bytes, null counts as empty.  Every byte goes that lies in a string of
    ``span`` bytes that also starts elsewhere, in the same document or another; strings
    are judged on the input.  ``kept_text`` reads what is left as UTF-8 and drops
    characters that were cut apart.  Repeated rows are separate documents, so long ones are removed from
    each other; a null doc_id is carried along; other columns are ignored.
    """
    spans = cut_spans(documents, span, seed, most_blocks).groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("first", "last")).alias("cuts")).withColumnsRenamed({"doc_id": "cut_id", "text_key": "cut_key"})
    texts = keyed(documents)
    both = texts.join(spans.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(spans["cut_id"]) & (texts["text_key"] == spans["cut_key"]), "left")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for doc_id, value, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            text = as_bytes(value)
            done, left, removed, spans_ = 0, [], 0, 0
            end = -1
            for first, last in sorted((c["first"], c["last"] + span) for c in cuts.as_py() or ()):
                if first > end:
                    left.append(text[done:first])
                    spans_ += 1
                    removed += last - first
                else:
                    removed += max(0, last - end)
                end = done = max(end, last)
            left.append(text[done:])
            kept = b"".join(left)
            rows.append((doc_id, len(text), removed, spans_, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            size += len(kept)
            if size > TASK_BYTES:  # the texts of a whole batch are not held a second time
                yield kept_batch(rows)
                rows, size = [], 0
        if rows:
            yield kept_batch(rows)

    return batches(both.select("doc_id", "text", "cuts"), work,
                   "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")

"""Benchmark passages in documents, found by the q-gram lemma in diagonal bands.

A passage of m characters that occurs with at most e edits shares at least
``m + 1 - q * (e + 1)`` of its q-grams with the place where it occurs, on diagonals (place in the
document less place in the passage) that differ by at most e.  Shared q-grams are
counted in diagonal bands of width 2 * e, each overlapping the next by e; bands that reach the bound are
kept and verified by banded alignment.

Passages are cut into overlapping windows, so that a document that holds a good part of
one is found too.  White space is one blank and A-Z count as a-z on both sides.

With q = 10 and edits of 5 % the bound is at least one for all passages of 20 characters or
more, so none of them gets fewer edits than the others.  Shorter ones are not looked for: two or
three everyday words would make clean documents count as contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import narrow, text_function, whole
from alertloom.session import written

Q = 10
ERROR = 0.05
WINDOW = 120
LEAST_CHARS = 20
TABLE_BITS = 22
PART_CHARS = 5_000_000
CHUNK = 1 << 20
FACTOR = 0x9E3779B97F4A7C15 | 1


def plain(text: str) -> str:
    """Lower case with single blanks."""
    return " ".join(text.lower().split())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every run of q code points, put together from runs of half the length."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    total = polynomial(codes.astype(np.uint64), q)
    total ^= total >> np.uint64(31)
    total *= np.uint64(FACTOR)
    return total ^ (total >> np.uint64(29))


def polynomial(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial of every run of q values, modulo 2 ** 64."""
    if q == 1:
        return codes
    half = polynomial(codes, q // 2)
    total = half[:len(half) - q // 2] * np.uint64(pow(FACTOR, q // 2, 1 << 64))
    total += half[q // 2:]
    if q % 2:
        total = total[:-1] * np.uint64(FACTOR)
        total += codes[q - 1:]
    return total


class Passages:
    """Windows of passages and a table of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, error: float = ERROR, window: int = WINDOW,
                 least: int = LEAST_CHARS):
        self.q, self.windows = q, []
        for item, text in items:
            passage = plain(text)
            if len(passage) < max(least, q):
                continue
            starts = [0] if len(passage) <= window + window // 2 else [
                *range(0, len(passage) - window, window // 2), len(passage) - window]
            size = len(passage) if len(starts) == 1 else window
            for start in dict.fromkeys(starts):
                part = passage[start:start + size]
                edits = min(int(error * len(part)), len(part) // q - 1)  # the bound is one at least
                self.windows.append((item, codes_of(part), edits))
        hashes = [gram_hashes(codes, q) for _, codes, _ in self.windows]
        flat = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.keys = flat[order]
        self.of = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.at = np.concatenate([np.arange(len(h)) for h in hashes] or [np.zeros(0, np.int64)])[order]
        self.edits = np.array([e for _, _, e in self.windows], np.int64)
        self.bounds = np.array([len(c) + 1 - q * (e + 1) for _, c, e in self.windows], np.int64)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, diagonal) of every q-gram that a text shares with a window, repeats counted once."""
        windows, diagonals = [], []
        for start in range(0, len(codes), CHUNK):
            hashes = gram_hashes(codes[start:start + CHUNK + self.q - 1], self.q)
            places = np.flatnonzero(self.table[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            low = np.searchsorted(self.keys, hashes[places], side="left")
            number = np.searchsorted(self.keys, hashes[places], side="right") - low
            hit = number > 0
            low, number, places = low[hit], number[hit], places[hit] + start
            entry = np.repeat(low - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum()) \
                if len(number) else np.zeros(0, np.int64)
            windows.append(self.of[entry])
            diagonals.append(np.repeat(places, number) - self.at[entry])
        return np.concatenate(windows or [np.zeros(0, np.int64)]), np.concatenate(diagonals or [np.zeros(0, np.int64)])

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, first diagonal, last diagonal) of the bands that reach the bound."""
        windows, diagonals = self.shared(codes)
        if not len(windows):
            return []
        band = diagonals // (self.edits[windows] + 1)
        both = np.stack([np.concatenate([windows, windows]), np.concatenate([band, band - 1])])  # a hit lies in two bands
        pairs, counts = np.unique(both, axis=1, return_counts=True)
        full = counts >= self.bounds[pairs[0]]
        return [(int(w), int(b * (self.edits[w] + 1)), int((b + 2) * (self.edits[w] + 1)) - 1) for w, b in pairs[:, full].T]

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of verified places in the plain text."""
        codes = codes_of(plain(text))
        found, verified = [], {}
        for window, first, last in self.regions(codes):
            item, passage, edits = self.windows[window]
            if last < -edits:  # more than that of the passage would stand before the text
                continue
            if any(first <= at <= last for at in verified.get(window, ())):
                continue  # the overlapping band has it
            start = max(0, first - edits)
            got = aligned(passage, codes[start:last + len(passage) + edits], edits, last - start + edits)
            if got is not None:
                found.append((item, start + got[0], start + got[1], got[2]))
                verified.setdefault(window, []).append(start + got[0])
        return sorted(set(found))


def aligned(passage: np.ndarray, region: np.ndarray, edits: int, reach: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best place of a passage in a region, if within ``edits``.

    Only diagonals 0 to ``reach`` + ``edits`` are filled, one row of the passage at a time.  A
    place without any edit is found at once.
    """
    at = region.tobytes().find(passage.tobytes())
    if at >= 0 and at % 4 == 0:
        return at // 4, at // 4 + len(passage), 0
    far = edits + 1
    width = reach + edits + 1
    lane = np.arange(width)
    cost = np.where(lane <= len(region), 0, far)
    origin = lane.copy()
    for row, letter in enumerate(passage):
        column = lane + row  # of the region's letter that lane compares
        inside = column < len(region)
        same = np.zeros(width, bool)
        same[inside] = region[column[inside]] == letter
        slide = np.where(inside, cost + ~same, far)  # letter against letter
        drop = np.append(cost[1:] + 1, far)  # a letter of the passage is missing here
        best = np.where(drop < slide, drop, slide)
        start = np.where(drop < slide, np.append(origin[1:], 0), origin)
        key = best - lane  # letters too many here: a running minimum along the row
        lowest = np.minimum.accumulate(key)
        at = np.maximum.accumulate(np.where(key == lowest, lane, 0))
        cost, origin = np.minimum(best[at] + lane - at, far), start[at]
        if cost.min() > edits:
            return None
    end = int(cost.argmin())
    return (int(origin[end]), end + len(passage), int(cost[end])) if cost[end] <= edits else None


def find_passages(documents: DataFrame, benchmark: DataFrame, q: int = Q, error: float = ERROR, window: int = WINDOW,
                  least: int = LEAST_CHARS) -> DataFrame:
    """A row per row of ``documents``: doc_id, contaminated, n_places, item_ids, places.

    ``places`` has item_id, start, end (in the lower-cased text with single blanks) and
    edits of every verified window.  Passages of fewer than ``least`` characters, null or
    empty ones are not looked for; null and empty documents hold none; repeated rows are
    searched each; null ids are carried along; other columns are ignored.

    Every task gets the passages, so their size is checked: they are searched for in parts
    of about ``PART_CHARS`` characters, one after another.
    """
    none = F.array().cast("array<struct<item_id: long, start: long, end: long, edits: long>>")
    found = narrow(documents).select("doc_id", whole().alias("text"), none.alias("places"))
    parts = PassageParts(benchmark, (q, error, window, least))
    for passages in parts:
        places = F.concat("places", passages_in(passages)("text"))
        found = parts.cut(found.select("doc_id", "text", places.alias("places")))
    return found.select(
        "doc_id", (F.size("places") > 0).alias("contaminated"), F.size("places").cast("long").alias("n_places"),
        F.array_sort(F.array_distinct(F.transform("places", lambda p: p["item_id"]))).alias("item_ids"), "places")


class PassageParts:
    """The passages of a benchmark in parts of a checked size; one part unless it is very large.

    A part is collected when its turn comes, and what was found with it is written before
    the next one, so that the driver and a plan hold one part at a time.
    """

    def __init__(self, benchmark: DataFrame, options: tuple = (Q, ERROR, WINDOW, LEAST_CHARS)):
        self.options = options
        self.items = benchmark.select(
            benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).filter(
            "text IS NOT NULL").dropDuplicates()
        size = self.items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
        self.number = max(1, -(-size // PART_CHARS))

    def __iter__(self) -> Iterator[Passages]:
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.number))
        for part in range(self.number):
            rows = self.items.filter(mine == part).orderBy("item_id", "text").collect()
            yield Passages([(r.item_id, r.text) for r in rows], *self.options)

    def cut(self, rows: DataFrame) -> DataFrame:
        """``rows``, written if there is more than one part."""
        return rows if self.number == 1 else written(rows, "decontamination")


def passages_in(passages: Passages):
    """Column function: the verified places of some passages in a text."""

    def setup():
        names = ("item_id", "start", "end", "edits")
        return lambda text: [dict(zip(names, hit)) for hit in passages.hits(text)]

    return text_function(setup, "array<struct<item_id: long, start: long, end: long, edits: long>>")


def holds_passage(passages: Passages):
    """Column function: whether a text holds one of some passages."""
    return text_function(lambda: lambda text: bool(passages.hits(text)), "boolean")


def without_passages(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark passage, with all their columns."""
    parts = PassageParts(benchmark)
    for passages in parts:
        documents = parts.cut(documents.filter(~holds_passage(passages)(whole(documents["text"]))))
    return documents

"""Near duplicates by an inverted join over signature coordinates.

A document is the set of its shingles (runs of words).  Equal sets form a class at once;
from there on only classes are compared.  A class has a signature of ``coordinates``
minima, and is posted under each (coordinate, value) pair.

* Counting: two sets that are similar enough agree in at least ``matches`` coordinates
  with a chance that ``missed`` puts below one in a million.  A class with fewer than
  ``matches`` coordinates that anyone else shares can be skipped at once.
* Prefix: such pairs meet in one of the first ``coordinates - matches + 1``
  coordinates, so only those are joined; the others are counted by looking at both
  signatures.
* Skipping: pairs whose classes are already linked through others need no look, see
  ``linking``.  No candidate between different components is left out.

* Rare shingles: a large group of copies that are near, but not near enough, would leave all its pairs
  to be looked at.  Pairs that are left at the end and share a shingle that few of the classes left have meet
  under it; of all others each class can share no more than its other shingles, and pairs for which
  that is too little are not linked.  This loses no link.

Links are confirmed on the full sets of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import batches, keyed
from alertloom.llm.linking import linked
from alertloom.session import written

COORDINATES = 24
MATCHES = 11
SEED = 9
KEPT_SETS = 2000
RARE = 64
BASE = 0x9E3779B97F4A7C15 | 1
MIX = 0xD6E8FEB86659FD93


def missed(percent: int, coordinates: int = COORDINATES, matches: int = MATCHES) -> float:
    """Chance that sets of just this similarity agree in too few coordinates."""
    p = percent / 100
    return sum(comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k) for k in range(matches))


# BASE ** i modulo 2 ** 64 for offsets inside a word, and which bytes are white; small arrays, which
# travel with the functions that use them (a cached function would be looked up in the package)
POWERS = np.concatenate([[1], np.cumprod(np.full(255, BASE, np.uint64))]).astype(np.uint64)
IS_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order; A-Z count as a-z."""
    data = np.frombuffer(text.lower(), np.uint8)
    blank = IS_WHITE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(begin)
    terms = (data.astype(np.uint64) + np.uint64(1)) * POWERS[place & 255]
    if lengths.max() > 256:
        terms *= np.uint64(1) + np.uint64(MIX) * (place >> 8).astype(np.uint64)
    terms[blank] = 0
    hashes = np.add.reduceat(terms, starts) + lengths.astype(np.uint64) * np.uint64(MIX)
    return mixed(hashes)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(MIX)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(MIX)
    return values ^ (values >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text is one shingle."""
    hashes = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(hashes):
        return hashes
    n = min(words, len(hashes))
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        total = mixed(total * np.uint64(BASE) + hashes[k:k + len(total)])
    return np.unique(total)


def signature(shingles: np.ndarray, coordinates: int, seeds: np.ndarray) -> np.ndarray:
    """The minima of ``coordinates`` hash functions over a set, 32 bits each."""
    best = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1 << 14):
        part = shingles[start:start + (1 << 14), None]
        values = (part ^ seeds[None, :, 0]) * seeds[None, :, 1]
        best = np.minimum(best, (values ^ (values >> np.uint64(29))).min(0))
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signed(documents: DataFrame, words: int, coordinates: int) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set (null if empty), signature."""
    seeds = np.random.default_rng(SEED).integers(0, 2**64, (coordinates, 2), np.uint64)
    seeds[:, 1] |= 1

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, digests, signatures = [], [], []
        for value in batch.column(1):
            shingles = shingle_set(value.as_py(), words)
            counts.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            signatures.append(signature(shingles, coordinates, seeds) if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(signatures, pa.list_(pa.int32()))], ["doc_id", "text_key", "n_shingles", "digest", "sig"])

    return batches(keyed(documents), work,
                   "doc_id long, text_key long, n_shingles long, digest binary, sig array<int>")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def setup():
        shingles = lru_cache(KEPT_SETS)(lambda text: shingle_set(text, words))

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keep = []
            for text_a, text_b in zip(batch.column(2), batch.column(3)):
                left, right = shingles(text_a.as_py()), shingles(text_b.as_py())
                both = 0
                if 100 * min(len(left), len(right)) >= percent * max(len(left), len(right)):
                    both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return work

    of = {n: texts.select(F.col("rep").alias(n), F.col("text").alias(f"text_{n}")) for n in ("a", "b")}
    return batches(pairs.join(of["b"], "b").join(of["a"], "a").select("a", "b", "text_a", "text_b"), None, "a long, b long", setup)


def agreeing(a: Column, b: Column, matches: int) -> Column:
    """Whether two signatures agree in at least ``matches`` coordinates."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) >= matches


def shingle_rows(texts: DataFrame, words: int) -> DataFrame:
    """node and the shingles of its text, as long numbers."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(value.as_py(), words).view(np.int64) for value in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return batches(texts.select("node", "text"), work, "node long, shingles array<long>")


def with_rare_shingles(still: DataFrame, texts: DataFrame, words: int, rare: int = RARE) -> DataFrame:
    """The posts with marks (sig, size, shared, common), and under rare shingles, at place -1, the nodes that have them.

    A shingle that only nodes of one component have makes no key, as they need no look; the wide marks are joined after that.
    ``shared`` counts the shingles of a node that another one of ``still`` has, ``common`` those that more than ``rare`` have.
    """
    nodes = still.select("node", "component", "mark").dropDuplicates(["node"])
    texts = texts.withColumnRenamed("rep", "node")
    sets = written(shingle_rows(texts.join(nodes.select("node"), "node", "left_semi"), words).join(nodes.select("node", "component"), "node"), "open_sets")
    each = sets.select("node", "component", F.explode("shingles").alias("shingle"))
    few = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter(
        F.col("n") <= rare).select("shingle", (F.col("n") == 1).alias("alone"), (F.col("low") < F.col("high")).alias("open"))
    held = written(each.select("node", "shingle").join(few, "shingle").select(
        "node", "alone", F.when(F.col("open"), F.xxhash64(F.lit(-1), "shingle")).alias("key")), "rare_shingles")
    counts = held.groupBy("node").agg(F.count(F.lit(1)).alias("rare"), F.count(F.when(F.col("alone"), 1)).alias("alone"))
    size = F.size("shingles").cast("long")
    facts = sets.join(counts, "node", "left").select(
        "node", size.alias("size"), (size - F.coalesce("alone", F.lit(0))).alias("shared"), (size - F.coalesce("rare", F.lit(0))).alias("common"))
    nodes = nodes.join(facts, "node").select("node", "component", F.struct(F.col("mark").alias("sig"), "size", "shared", "common").alias("mark"))
    posts = still.select("node", "key", "place").union(held.filter("key IS NOT NULL").select("node", "key", F.lit(-1)))
    return posts.join(nodes, "node").select("node", "key", "component", "mark", "place")


def can_reach(a: Column, b: Column, shingles: str, percent: int) -> Column:
    """Whether sets that have no more than ``shingles`` in common can be similar enough."""
    return (100 + percent) * F.least(a[shingles], b[shingles]) >= percent * (a["size"] + b["size"])


def near_groups(documents: DataFrame, words: int = 5, percent: int = 80, coordinates: int = COORDINATES,
                matches: int | None = None) -> DataFrame:
    """A row per row of ``documents``: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    distinct ``words``-word shingles (ASCII white space parts words, A-Z count as a-z); a
    text with fewer words is one shingle.  ``component_id`` is the smallest doc_id that
    can be reached by links, and the row of that id is kept.  Texts that are null, empty
    or white are linked with nothing, and so are rows with a null doc_id, whose
    component is null and which are kept.  Rows that share a doc_id are one node.
    Other columns are ignored; an empty table gives an empty result.
    """
    if matches is None:
        matches = max(m for m in range(1, coordinates) if m == 1 or missed(percent, coordinates, m) < 2e-6)
    rows = written(signed(documents, words, coordinates), "signatures")
    classes = (
        rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
        .agg(F.min(F.struct("doc_id", "text_key", "sig")).alias("first"))
        .select("digest", F.col("first.doc_id").alias("rep"), "first.text_key", "first.sig")
    )
    classes = written(classes, "classes")
    posts = classes.select("rep", F.posexplode("sig").alias("place", "value"))
    shared = posts.groupBy("place", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("place", "value")
    partners = posts.join(shared, ["place", "value"]).groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= matches)
    suspects = written(classes.join(partners.select("rep"), "rep", "left_semi"), "suspects")
    wanted = suspects.select(F.col("rep").alias("doc_id"), "text_key")
    texts = written(
        keyed(documents).join(wanted.hint("shuffle_hash"), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
        .select(F.col("doc_id").alias("rep"), "text"), "suspect_texts")
    sigs = {n: suspects.select(F.col("rep").alias(n), F.col("sig").alias(f"sig_{n}")) for n in ("a", "b")}

    def look(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sigs["b"], "b").join(sigs["a"], "a").filter(agreeing(F.col("sig_a"), F.col("sig_b"), matches)).select(
            "a", "b").distinct()
        return confirmed(near, texts, words, percent)

    prefix = coordinates - matches + 1
    posts = suspects.select(F.col("rep").alias("node"), F.col("sig").alias("mark"), F.posexplode(F.slice("sig", 1, prefix)).alias("place", "value"))

    def first_met(a: Column, b: Column, place: Column) -> Column:
        """Enough coordinates agree, and this is the first of them, so that a pair is met once; or a rare shingle is shared."""
        same = F.zip_with(a["sig"], b["sig"], lambda x, y: x == y)
        here = F.when(place < 0, can_reach(a, b, "shared", percent)).otherwise(
            can_reach(a, b, "common", percent) & (F.array_position(same, True) == place + 1))
        return here & agreeing(a["sig"], b["sig"], matches)

    found = linked(written(posts.select("node", F.xxhash64("place", "value").alias("key"), "mark", "place"), "posts"), look,
                   alike=first_met, sharpen=lambda still: with_rare_shingles(still, texts, words))
    named = classes.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component"))
    result = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that are kept, with all their columns."""
    dropped = near_groups(documents, words, percent).filter("NOT kept").select(F.col("doc_id").alias("_dropped_id")).distinct()
    return documents.join(dropped, documents["doc_id"].cast("long") == dropped["_dropped_id"], "left_anti")

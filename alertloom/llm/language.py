"""Language of texts by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point, so all tasks
agree without sharing a table.  An n-gram is bound from its letters' vectors, each
permuted by its place; a text bundles (adds up) its n-grams; a language's prototype
bundles its texts.  A text has the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import batches, fold_of, narrow
from alertloom.session import written

DIMENSIONS = 512
GRAM = 3
SEED = 20
KEPT_GRAMS = 60_000
LANGUAGES = 1000
UNKNOWN = "und"


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, dimensions, np.int8) * 2 - 1


PLAIN_LETTERS = bytes(code if 97 <= code <= 122 else code + 32 if 65 <= code <= 90 else 32 for code in range(256))


ALPHABETS: list[np.ndarray] = []


def alphabet() -> np.ndarray:
    """Whether a code point is a letter, made once in a process."""
    if not ALPHABETS:
        ALPHABETS.append(np.fromiter((chr(code).isalpha() for code in range(0x110000)), bool, 0x110000))
    return ALPHABETS[0]


def letter_codes(text: str) -> np.ndarray:
    """Code points of the text in lower case; every run of other characters is one 0, at both ends too."""
    if text.isascii():
        words = text.encode().translate(PLAIN_LETTERS).split()
        codes = np.frombuffer(b" ".join([b"", *words, b""] if words else []), np.uint8).astype(np.int64)
        codes[codes == 32] = 0
        return codes
    found = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = np.zeros(len(found) + 2, bool)
    letters[1:-1] = alphabet()[found]
    kept = letters.copy()
    kept[0] = True
    kept[1:] |= letters[:-1]
    codes = np.zeros(len(letters), np.int64)
    codes[1:-1] = found
    codes[~letters] = 0
    return codes[kept] if letters.any() else codes[:0]


class Encoder:
    """Vectors of n-grams and texts; keeps a bounded number of n-gram vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        self.letters: dict[int, np.ndarray] = {0: letter_vector(0, dimensions)}
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.known = np.zeros((1024, self.dimensions), np.float32)

    def gram_vector(self, code: int) -> np.ndarray:
        bound = np.ones(self.dimensions, np.int8)
        for place in range(self.gram):
            letter = code >> 21 * place & 0x1FFFFF
            if letter not in self.letters:
                self.letters[letter] = letter_vector(letter, self.dimensions)
            bound = bound * np.roll(self.letters[letter], place)
        return bound.astype(np.float32)

    def rows_of(self, grams: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(grams) > KEPT_GRAMS:
            self.forget()
        places = []
        for code in grams.tolist():
            row = self.rows.get(code)
            if row is None:
                row = self.rows[code] = len(self.rows)
                if row >= len(self.known):
                    self.known = np.concatenate([self.known, np.zeros_like(self.known)])
                self.known[row] = self.gram_vector(code)
            places.append(row)
        return np.array(places, np.int64)

    def text_vector(self, text: str | None) -> np.ndarray | None:
        """The bundle of a text's n-grams; None without a letter."""
        codes = letter_codes(text or "")
        if not len(codes):
            return None
        grams = np.zeros(max(1, len(codes) - self.gram + 1), np.int64)
        for place in range(self.gram):
            part = codes[place:place + len(grams)]
            grams[:len(part)] |= part << 21 * place
        grams, counts = np.unique(grams, return_counts=True)
        bundle = np.zeros(self.dimensions, np.float32)
        for start in range(0, len(grams), KEPT_GRAMS // 2):
            rows = self.rows_of(grams[start:start + KEPT_GRAMS // 2])
            bundle += counts[start:start + KEPT_GRAMS // 2].astype(np.float32) @ self.known[rows]
        return bundle


def prototypes(documents: DataFrame, dimensions: int = DIMENSIONS, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The bundle of each language over all rows of ``documents`` with a language and a letter.

    Texts are bundled by language inside tasks, so what is shuffled has one row per task,
    language and dimension, and what reaches the driver one vector per language.  The
    number of languages is checked against ``LANGUAGES``.
    """

    def setup():
        encoder = Encoder(dimensions, gram)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                vector = encoder.text_vector(value.as_py())
                if vector is not None and (norm := np.linalg.norm(vector)) > 0:
                    sums[lang] = sums.get(lang, 0) + vector / norm
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                ["lang", "bundle"])

        return work

    parts = batches(documents.filter("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text"),
                    None, "lang string, bundle array<double>", setup)
    sums = (
        parts.select("lang", F.posexplode("bundle").alias("place", "value"))
        .groupBy("lang", "place").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("bundle"))
    )
    rows = sums.limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    return {r.lang: np.array([b.value for b in r.bundle]) for r in rows}


def predict(documents: DataFrame, learnt: dict[str, np.ndarray], gram: int = GRAM) -> DataFrame:
    """doc_id, lang_pred and score of every row; the score is the cosine's share of 0 to 1."""
    names = sorted(learnt)
    dimensions = len(next(iter(learnt.values()))) if learnt else DIMENSIONS
    centre = np.mean([learnt[n] / np.linalg.norm(learnt[n]) for n in names], axis=0) if names else np.zeros(dimensions)
    matrix = np.array([learnt[n] / np.linalg.norm(learnt[n]) for n in names]).reshape(len(names), dimensions)
    if len(names) > 1:  # what all languages share tells nothing
        matrix = matrix - centre
        matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    def setup():
        encoder = Encoder(dimensions, gram)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            langs, scores = [], []
            for value in batch.column(1):
                vector = encoder.text_vector(value.as_py())
                if vector is None or not names or not (norm := np.linalg.norm(vector)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                point = vector / norm - (centre if len(names) > 1 else 0)
                cosines = matrix @ point / max(np.linalg.norm(point), 1e-9)
                best = int(cosines.argmax())
                langs.append(names[best])
                scores.append(float(np.clip((1 + cosines[best]) / 2, 0, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)],
                                             ["doc_id", "lang_pred", "score"])

        return work

    return batches(narrow(documents), None, "doc_id long, lang_pred string, score double", setup)


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows, the same ones for the same ids: those whose id's hash lies below a bar."""
    n = rows.count()
    if n <= most:
        return rows
    bar = int(most / n * 2**62)
    return rows.filter(F.xxhash64("doc_id").bitwiseAND(F.lit(2**62 - 1)) < bar)


def identify(documents: DataFrame, most: int = 40_000, dimensions: int = DIMENSIONS, gram: int = GRAM) -> DataFrame:
    """Learn from the rows outside fold 2 and predict all rows.

    Returns doc_id, held_out, lang_pred and score.  Prototypes are fitted on at most
    about ``most`` rows that have a language.  A text that is null or has no letter is
    ``und`` with score 0, as are all texts if there is nothing to learn from.  Ties go to
    the first language by name; repeated rows are predicted each; a null doc_id counts to
    fold 0; other columns are ignored.
    """
    known = documents.select(documents["doc_id"], documents["text"], documents["lang"])
    learnt = prototypes(sampled(known.filter((fold_of() != 2) & F.col("lang").isNotNull()), most), dimensions, gram)
    return predict(documents, learnt, gram).select("doc_id", (fold_of() == 2).alias("held_out"), "lang_pred", "score")

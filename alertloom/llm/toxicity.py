"""Toxicity of texts: undo disguised spelling by a noisy channel, then score the restored words.

A suspicious stretch (digits or signs beside letters, a letter twice or more, letters set
apart) is a lattice: a sign may stand for a letter, for nothing or for a gap, and one of
a run of equal letters may be left out.  Viterbi finds the likeliest reading under a
trigram model of characters that is counted over all documents; of its counts the tasks
get those that some lattice can ask for.  Other words are read
as they stand, and so are tokens without any letter: they are numbers and marks.

The score is learnt from labelled documents: words and beginnings of words that occur
far more often in toxic documents, each with the share of toxic ones.  A document's
score is the calibrated chance that it is toxic, given how many such words it has, how
strong they are and how long it is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from alertloom.llm.common import batches, fold_of, narrow, text_function, whole
from alertloom.llm.language import letter_codes, sampled
from alertloom.session import written

# Letters that a digit or sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
# Channel costs, in nats: a sign read as a letter, a sign left out, a separator left out, a repeat left out, a gap kept.
AS_LETTER, SIGN_OUT, APART_OUT, REPEAT_OUT, GAP = 1.0, 12.0, 0.2, 0.7, 12.0
COUNTED_AT_ONCE = 2_000_000
SMOOTH = 0.01
LAST_TWO = (1 << 42) - 1

# letters, digits and signs, each set apart by blanks or by one separator; a mark at the end belongs to the sentence
SPACED = re.compile(r"(?<![^\s\"'\u2018\u201c\u00ab(\[{<])(?:[^\W_]|[@$!|+€])(?:(?:[ \t]+|[.*_-])(?:[^\W_]|[@$!|+(€]))+"
                    r"(?:[ \t]+|[.*_-])(?:[^\W_]|[@$€])(?![^\W_])")
# what every such stretch begins with, after a blank in front of the text, in classes that are fast to look for
MAYBE_SPACED = re.compile(r"[\x00-\x20\"'(\[{<\x80-\U0010ffff][A-Za-z0-9@$!|+\x80-\U0010ffff][ \t.*_-]+"
                          r"[A-Za-z0-9@$!|+(\x80-\U0010ffff][ \t.*_-]")
SEPARATORS = " \t.*_-"
TWICE = re.compile(r"([^\W\d_])\1")
REPEATS = re.compile(r"([^\W\d_])\1+")
DISGUISED = re.compile(r"[0-9@$!|+(€]|[^\W\d_][*._-]+[^\W\d_]|([^\W\d_])\1")
APOSTROPHE = re.compile(r"(['\u2019])")
READ = "\ue001"  # around a word that has been read already
EDGES = ".,;:?\"'*#%&)[]{}<>~^/\\=_-"
MARKS = "!|+("
SIGNS = "$@€"
LETTER = re.compile(r"[^\W\d_]")

STARTS = (4, 5, 6)
LEAST_EVIDENCE = 30.0
LEAST_SHARE = 0.6
MOST_LABELLED = 40_000
THRESHOLD = 0.3
KEPT_WORDS = 150_000
FLOOR = 0.02


def trigram_counts(documents: DataFrame) -> DataFrame:
    """gram, n and asked: character trigrams of all texts, and those that a lattice of a text can ask for.

    Each is counted inside tasks first; the frame is written, as it grows with the texts.
    """

    def setup():
        asker = Asker()
        lattices = Told(asker, lambda word: None)

        def flushed(parts: list[np.ndarray]) -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(parts), return_counts=True)
            asked = np.fromiter(asker.asked, np.int64, len(asker.asked))
            asker.asked.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([grams, asked])), pa.array(np.concatenate([counts, np.zeros(len(asked), np.int64)])),
                 pa.array(np.arange(len(grams) + len(asked)) >= len(grams))], ["gram", "n", "asked"])

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            parts, held = [np.zeros(0, np.int64)], 0
            for value in batch.column(0):
                text = value.as_py()
                codes = letter_codes(text)
                if len(codes) > 2:
                    parts.append(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])
                    held += len(codes)
                lattices.among(set(asker.tokens(text)))
                if held + len(asker.asked) > COUNTED_AT_ONCE:
                    yield flushed(parts)
                    parts, held = [np.zeros(0, np.int64)], 0
            yield flushed(parts)

        return work

    counted = batches(narrow(documents).select(whole().alias("text")), None, "gram long, n long, asked boolean", setup)
    return written(counted.groupBy("gram").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")), "trigrams")


def character_model(documents: DataFrame) -> Restorer:
    """The reader of these documents: what their lattices can ask for, with totals over all trigrams."""
    grams = trigram_counts(documents)
    two = F.shiftright("gram", 21)
    asked = grams.filter("asked").select("gram", "n", two.alias("two"))
    seen = grams.filter("n > 0")
    totals = seen.groupBy(two.alias("two")).agg(F.sum("n").alias("total"))
    rows = asked.join(totals, "two", "left").select("gram", "n", F.coalesce("total", F.lit(0)).alias("total")).filter("total > 0")
    found = rows.toPandas()
    letters = seen.agg(F.count_distinct(F.col("gram").bitwiseAND(0x1FFFFF)).alias("n")).first().n
    counts = {gram: n for gram, n in zip(found["gram"].tolist(), found["n"].tolist()) if n}
    before = {gram >> 21: total for gram, total in zip(found["gram"].tolist(), found["total"].tolist())}
    return Restorer(counts, before, letters)


class Restorer:
    """Reads disguised words under a character model.

    ``before`` (counts by the two letters before) and ``letters`` (the size of the
    alphabet) come from ``counts`` if they are not given.
    """

    def __init__(self, counts: dict[int, int], before: dict[int, int] | None = None, letters: int | None = None):
        self.counts = counts
        self.before = {} if before is None else before
        if before is None:
            for gram, n in counts.items():
                self.before[gram >> 21] = self.before.get(gram >> 21, 0) + n
        self.letters = max(2, len({gram & 0x1FFFFF for gram in counts}) if letters is None else letters)
        self.costs: dict[int, float] = {}
        self.runs: dict[str, str] = {}

    def cost_of(self, gram: int) -> float:
        """The cost of a trigram, kept for the next time."""
        if len(self.costs) >= COUNTED_AT_ONCE:
            self.costs.clear()
        self.costs[gram] = cost = self.cost(gram >> 21, gram & 0x1FFFFF)
        return cost

    def cost(self, two: int, letter: int) -> float:
        n = self.counts.get(two << 21 | letter, 0)
        return -math.log((n + SMOOTH) / (self.before.get(two, 0) + SMOOTH * self.letters))

    @staticmethod
    def choices(char: str, before: str) -> list[tuple[str, float]]:
        """What a character may stand for (a letter, nothing, a gap) and the channel's cost."""
        if char.isalpha():
            return [(char, 0.0), ("", REPEAT_OUT)] if char == before else [(char, 0.0)]
        choices = [(letter, AS_LETTER) for letter in STANDS_FOR.get(char, "")]
        return [*choices, ("", SIGN_OUT if choices else APART_OUT), (" ", GAP)]

    @staticmethod
    def options(text: str) -> list[list[tuple[str, float]]]:
        """For every character what it may stand for."""
        lattice, before = [], ""
        for char in text:
            lattice.append(Restorer.choices(char, before))
            if char not in SEPARATORS:
                before = char
        return lattice

    def read(self, text: str) -> str:
        """The likeliest reading of a stretch of lower-case text, by Viterbi over the last two letters."""
        costs = self.costs
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        before, at = "", 0
        while at < len(text):
            char = text[at]
            if len(states) == 1 and char != before and char.isalpha():  # a run without a choice, so its cost does not matter
                [(two, (_, said))] = states.items()
                start = at
                while char and char != before and char.isalpha():
                    two, before, at = (two << 21 | ord(char)) & LAST_TWO, char, at + 1
                    char = text[at:at + 1]
                states = {two: (0.0, (said, text[start:at]))}
                continue
            following: dict[int, tuple[float, tuple]] = {}
            choices = self.choices(char, before)
            for two, (total, said) in states.items():
                for out, price in choices:
                    if not out or (out == " " and not two & 0x1FFFFF):
                        state, cost, told = two, total + price, said
                    else:
                        gram = two << 21 | (0 if out == " " else ord(out))
                        cost = costs.get(gram)
                        cost = total + price + (self.cost_of(gram) if cost is None else cost)
                        state, told = gram & LAST_TWO, (said, out)
                    if state not in following or cost < following[state][0]:
                        following[state] = (cost, told)
            states = following
            at += 1
            if char not in SEPARATORS:
                before = char
            if len(states) == 1 and (rest := text[at:]).isalpha() and rest[0] != before and not TWICE.search(rest):
                [(two, (total, said))] = states.items()  # one reading is left, so what it costs does not matter
                states = {two: (total, (said, rest))}
                break
        if len(states) == 1:
            [(_, best)] = states.values()
        else:
            best = min(((total + self.cost(two, 0), said) for two, (total, said) in states.items()), key=lambda s: s[0])[1]
        out = []
        while best:
            best, letter = best
            out.append(letter)
        return "".join(reversed(out)).strip()

    def read_letters(self, text: str) -> str:
        """What ``read`` gives for letters alone: a run of equal letters is read by the letters beside it only.

        The letter after a run is the same in every reading and so are the last two from there on.
        """
        return REPEATS.sub(self.run, text)

    def run(self, found: re.Match) -> str:
        start, end = found.span()
        key = found.string[max(start - 1, 0):end + 1] if start else " " + found.string[:end + 1]
        said = self.runs.get(key)
        if said is None:
            if len(self.runs) >= KEPT_WORDS:
                self.runs.clear()
            letter = found.string[start]
            said = self.runs[key] = letter * self.repeats(
                ord(found.string[start - 1]) if start else 0, ord(letter), end - start, ord(found.string[end]) if end < len(found.string) else 0)
        return said

    def repeats(self, before: int, letter: int, n: int, after: int) -> int:
        """How many of ``n`` equal letters are meant, between two others: one, two or all, as each after the second costs the same."""
        once, twice = before << 21 | letter, letter << 21 | letter
        second, end = self.cost(once, letter), self.cost(twice, after)
        prices = [((n - 2) * REPEAT_OUT + second + end, 2), ((n - 1) * REPEAT_OUT + self.cost(once, after), 1)]
        if n > 2:
            prices.insert(0, (second + (n - 2) * self.cost(twice, letter) + end, n))
        return min(prices, key=lambda p: p[0])[1]

    def word(self, token: str) -> str:
        """What a blank-separated token says: stripped of signs at its edges, read if it is disguised."""
        return token.split(READ)[1] if READ in token else self.core_word(self.core(token))

    @staticmethod
    def core(token: str) -> str:
        """A token in lower case without the signs at its edges."""
        return token.lower().lstrip(EDGES).rstrip(EDGES + MARKS)

    def core_word(self, core: str) -> str:
        """What a core says: read if it is disguised."""
        if core.isalpha():
            return self.read_letters(core)
        shape = core.rstrip(SIGNS)
        if len(core) - len(shape) <= 2:
            shape = core
        return "".join(map(self.part, APOSTROPHE.split(shape))) if DISGUISED.search(shape) else shape

    def part(self, shape: str) -> str:
        """A token's part beside an apostrophe, read if it has letters and may be disguised."""
        return self.read(shape) if DISGUISED.search(shape) and LETTER.search(shape) else shape

    def restore(self, text: str) -> str:
        """The whole text as it is meant."""
        return " ".join(filter(None, map(self.word, self.tokens(text))))

    def tokens(self, text: str) -> list[str]:
        """What blanks set apart, in lower case, with letters that were set apart put together again."""
        return self.joined(text).lower().split()

    def joined(self, text: str) -> str:
        """The text with letters that were set apart put together again."""
        text = text.replace(READ, "")
        return SPACED.sub(self.together, text) if MAYBE_SPACED.search(f" {text}") else text

    def together(self, found: re.Match) -> str:
        """The word that letters set apart make; sums, tables and numbers stay."""
        said = found.group().lower()
        letters = len(LETTER.findall(said))
        bars = said.count("+") + said.count("|")
        if not letters or bars and 2 * bars >= letters:
            return found.group()
        return " ".join(READ + word + READ for word in self.read(said).split())


class Asker(Restorer):
    """Goes through the lattices without a model and notes every trigram whose cost they need."""

    def __init__(self):
        super().__init__({})
        self.asked: set[int] = set()

    def cost(self, two: int, letter: int) -> float:
        self.asked.add(two << 21 | letter)
        return 0.0


class Told:
    """Which tokens tell something, worked out once by ``find`` from their word while they are in use.

    Tokens and cores are kept in two generations of about ``KEPT_WORDS``: what does not come again
    while the younger one fills up is forgotten.  ``values`` has the tokens for which ``find`` gave anything.
    """

    def __init__(self, restorer: Restorer, find: Callable[[str], Any]):
        self.restorer, self.find = restorer, find
        self.young: set[str] = set()
        self.old: set[str] = set()
        self.cores: dict[str, Any] = {}
        self.old_cores: dict[str, Any] = {}
        self.values: dict[str, Any] = {}
        self.told: set[str] = set()

    def among(self, tokens: set[str]) -> set[str]:
        """The tokens that tell something; their values are in ``values`` until the next call."""
        new = tokens - self.young
        if new:
            cores = self.cores
            for token in new - self.old:
                if value := cores[token] if token in cores else self.value(token):
                    self.values[token] = value
                    self.told.add(token)
            self.young |= new
            if len(self.young) >= KEPT_WORDS:
                self.old, self.young = self.young, set()
                self.old_cores, self.cores = self.cores, {}
                self.told &= self.old
                self.values = {token: self.values[token] for token in self.told}
        return tokens & self.told

    def value(self, token: str) -> Any:
        if READ in token:
            return self.find(self.restorer.word(token))
        core = token if token.isalpha() else self.restorer.core(token)
        if core not in self.cores:
            self.cores[core] = self.old_cores[core] if core in self.old_cores else self.find(self.restorer.core_word(core))
        return self.cores[core]


def whole_feature(part: str) -> int:
    return xxh3_64_intdigest(part.encode("utf-8", "surrogatepass")) >> 1


def start_feature(part: str, n: int) -> int:
    return xxh3_64_intdigest(part[:n].encode("utf-8", "surrogatepass"), n) >> 1


def part_features(part: str) -> list[int]:
    """64-bit hashes of a word and its beginnings."""
    return [whole_feature(part), *[start_feature(part, n) for n in STARTS if len(part) > n]]


def word_features(word: str) -> tuple[int, ...]:
    """The features of what a token says, which may be several words."""
    return tuple(f for part in word.split() for f in part_features(part))


def feature_counts(labelled: DataFrame, restorer: Restorer, among: frozenset[int] | None = None) -> DataFrame:
    """Documents by feature, counted inside tasks first; all features, or those of ``among``."""

    def setup():
        known = Told(restorer, word_features if among is None else lambda word: tuple(f for f in word_features(word) if f in among))

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            counts: Counter[int] = Counter()
            for value in batch.column(0):
                ids: set[int] = set()
                for token in known.among(set(restorer.tokens(value.as_py()))):
                    ids.update(known.values[token])
                counts.update(ids)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
                                             ["feature", "n"])

        return work

    return batches(labelled.select("text"), None, "feature long, n long", setup).groupBy("feature").agg(
        F.sum("n").alias("n"))


def learn(labelled: DataFrame, restorer: Restorer) -> dict[int, float]:
    """Features that tell, with the share of toxic documents among those that hold them.

    ``labelled`` has text and toxic and is bounded, and so are its features.  A feature
    tells if its log-likelihood ratio against the overall share reaches
    ``LEAST_EVIDENCE`` and its share ``LEAST_SHARE``.  Features of toxic documents that
    are too rare to reach that are left out before clean documents are counted.
    """
    sizes = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    prior = n_toxic / (n_toxic + n_clean)
    least = LEAST_EVIDENCE / (-2 * math.log(prior))
    in_toxic = {r.feature: r.n for r in feature_counts(labelled.filter("toxic = 1"), restorer)
                .filter(F.col("n") >= least).collect()}
    in_clean = {r.feature: r.n for r in feature_counts(labelled.filter("toxic = 0"), restorer, frozenset(in_toxic)).collect()}
    telling = {}
    for feature, toxic in in_toxic.items():
        clean = in_clean.get(feature, 0)
        n = toxic + clean
        share = (toxic + 0.5) / (n + 1)
        if share >= max(LEAST_SHARE, prior):
            evidence = 2 * toxic * math.log(toxic / n / prior)
            if clean:
                evidence += 2 * clean * math.log(clean / n / (1 - prior))
            if evidence >= LEAST_EVIDENCE:
                telling[feature] = share
    return telling


class Judge:
    """What a text's words tell: summed weight, telling words, strongest one, all words."""

    def __init__(self, restorer: Restorer, telling: dict[int, float]):
        self.restorer, self.telling = restorer, telling
        self.known = Told(restorer, self.weight)
        self.beginnings: dict[str, float] = {}

    def part_share(self, part: str) -> float:
        """The largest share of a word and its beginnings; those of longer words are worked out once for all with the same."""
        if len(part) <= STARTS[-1]:
            return max(self.telling.get(f, 0.0) for f in part_features(part))
        begin = part[:STARTS[-1]]
        share = self.beginnings.get(begin)
        if share is None:
            if len(self.beginnings) >= KEPT_WORDS:
                self.beginnings.clear()
            share = self.beginnings[begin] = max(self.telling.get(start_feature(begin, n), 0.0) for n in STARTS)
        return max(share, self.telling.get(whole_feature(part), 0.0))

    def weight(self, word: str) -> float:
        share = max(map(self.part_share, word.split()), default=0.0)
        return -math.log1p(-min(share, 0.9999)) if share else 0.0

    def facts(self, text: str) -> tuple[float, float, float, float]:
        tokens = self.restorer.tokens(text)
        weights = []
        if self.known.among(set(tokens)):
            values = self.known.values
            weights = [values[t] for t in tokens if t in values]
        return sum(weights), len(weights), max(weights, default=0.0), len(tokens)


def design(facts: np.ndarray) -> np.ndarray:
    """Columns of the calibration: weight, telling words, strongest, length, weight by length."""
    total, count, strongest, words = facts.T
    length = np.log1p(words)
    return np.stack([np.ones(len(facts)), np.log1p(total), np.log1p(count), strongest, length,
                     np.log1p(total) / np.maximum(length, 1)], axis=1)


def calibrate(facts: np.ndarray, toxic: np.ndarray, rounds: int = 50, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps; its rows are the bounded labelled ones."""
    x = design(facts)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (toxic - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """All that scoring needs: character model, telling features, calibration."""

    def __init__(self, restorer: Restorer, telling: dict[int, float], weights: np.ndarray | None):
        self.restorer, self.telling, self.weights = restorer, telling, weights

    def scores(self, facts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(facts), FLOOR)
        chance = 1 / (1 + np.exp(-np.clip(design(facts) @ self.weights, -30, 30)))
        return np.where(facts[:, 1] > 0, np.maximum(chance, FLOOR), FLOOR)


def facts_of(rows: DataFrame, model: Model, carried: str, schema: str) -> DataFrame:
    """The facts of every text beside one carried column."""

    def setup():
        judge = Judge(model.restorer, model.telling)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [judge.facts(value.as_py()) for value in batch.column(1)]
            columns = [pa.array(c, pa.float64()) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [carried, "total", "count", "strongest", "words"])

        return work

    return batches(rows.select(carried, "text"), None,
                   f"{carried} {schema}, total double, count double, strongest double, words double", setup)


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row; texts without a telling word get the lowest score."""

    def setup():
        judge = Judge(model.restorer, model.telling)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            values = model.scores(np.array([judge.facts(value.as_py()) for value in batch.column(1)], float))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values), pa.array((values >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])

        return work

    return batches(narrow(documents).select("doc_id", whole().alias("text")), None,
                   "doc_id long, score double, predicted int", setup)


def labelled_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic (0 or 1) of the labelled rows outside fold 2; ``labels`` is a bounded sample."""
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    marks = marks.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold_of() != 2)
    return narrow(documents).select("doc_id", whole().alias("text")).join(F.broadcast(marks), "doc_id")


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """The character model of all documents, and what at most about ``most`` labelled rows tell."""
    restorer = character_model(documents)
    marks = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].alias("toxic"))
    chosen = sampled(marks.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold_of() != 2), most)
    labelled = written(labelled_rows(documents, chosen), "labelled")
    model = Model(restorer, learn(labelled, restorer), None)
    if model.telling:
        rows = facts_of(labelled, model, "toxic", "int").toPandas().to_numpy(float)  # about ``most`` rows
        model.weights = calibrate(rows[:, 1:], rows[:, 0])
    return model


def score_documents(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED,
                    threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of ``documents``.

    Learns from labels whose id is outside fold 2.  Null and empty texts get the lowest
    score, as do all texts if the labels hold only one class.  Repeated rows are scored
    each, repeated labels count as often; a null doc_id counts to fold 0 and is never
    labelled; labels other than 0 and 1 and other columns are ignored.
    """
    return score(documents, fit(documents, labels, most), threshold).select(
        "doc_id", (fold_of() == 2).alias("held_out"), "score", "predicted")


def without_toxic(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` whose score stays below ``threshold``, with all their columns."""
    model = fit(documents, labels, most)

    def setup():
        judge = Judge(model.restorer, model.telling)
        return lambda text: bool(model.scores(np.array([judge.facts(text)], float))[0] < threshold)

    return documents.filter(text_function(setup, "boolean")(whole(documents["text"])))

"""Licences of pages: sparse TF-IDF cosine to templates, then inheritance from directories.

Statements are the sentences of a page that speak of rights at all; they end with the
element they stand in.  A statement is compared by TF-IDF cosine with each template: with
the best window of one to two times the template's words, so that what stands beside a
notice does not weigh it down.  Words are weighted over the templates, so a statement
means the same in every table.  A licence file, or the index page of a
directory, speaks for all that lies below its directory; a page without a statement of
its own takes the licence of the nearest directory above that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.text import strip_html
from alertloom.llm.common import text_function
from alertloom.session import written

# Licence names, and sentences by which they are stated.
TEMPLATES = {
    "MIT": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy"),
    "Apache-2.0": ("licensed under the apache license version 2.0",),
    "GPL-3.0": ("this work is licensed under the gnu general public license version 3",
                "licensed under the gnu general public license version 3"),
    "GPL-2.0": ("this program is licensed under the gnu general public license version 2",
                "licensed under the gnu general public license version 2"),
    "LGPL-3.0": ("licensed under the gnu lesser general public license version 3",),
    "AGPL-3.0": ("licensed under the gnu affero general public license version 3",),
    "BSD-3-Clause": ("redistribution and use in source and binary forms with or without modification are permitted",
                     "licensed under the bsd 3 clause license"),
    "MPL-2.0": ("subject to the terms of the mozilla public license version 2.0",),
    "CC-BY-4.0": ("licensed under cc by 4.0", "creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("licensed under cc by sa 4.0", "creative commons attribution sharealike 4.0 license"),
    "CC-BY-NC-4.0": ("licensed under cc by nc 4.0", "creative commons attribution noncommercial 4.0 license"),
    "CC0-1.0": ("dedicated to the public domain cc0 1.0 universal",),
    "Proprietary": ("all rights reserved no part may be reproduced without permission", "all rights reserved"),
}
# Words of which a statement holds at least one.
TRIGGER = r"(?i)licen[sc]e|copyright|all rights reserved|creative commons|public domain|permission is hereby|redistribution and use"
LICENCE_FILE = r"(?i)^(un)?licen[sc]e|^copying|^notice|^index\.[a-z]+$|^$"
LEAST_COSINE = 0.6
WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
# Elements that stand inside a sentence; all others end it.
INLINE = "a|abbr|acronym|b|bdi|bdo|big|cite|code|data|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strong|sub|sup|time|tt|u|var|wbr"
HIDDEN = r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>|<![^>]*>|<\?[^>]*>"
END = "\ue000"
SENTENCE_END = rf"{END}|\n\s*\n|(?<=[.!?])\s+(?=[^\sa-z0-9])"
KEPT_STATEMENTS = 50_000
FEW_WORDS = 4  # a template of fewer counts only where all its words occur: "some rights reserved" is none


class Matcher:
    """The templates, weighted, and the closest of them to a statement."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        texts = [(name, text.split()) for name, several in templates.items() for text in several]
        spread = Counter(word for _, words in texts for word in set(words))
        self.rare = math.log(len(texts) + 1) + 1  # the weight of a word of no template
        self.idf = {word: math.log((len(texts) + 1) / (n + 1)) + 1 for word, n in spread.items()}
        self.templates = []
        for name, words in texts:
            weights = {w: (1 + math.log(n)) * self.idf[w] for w, n in Counter(words).items()}
            self.templates.append((name, len(words), weights, math.sqrt(sum(w * w for w in weights.values()))))

    @staticmethod
    def bound(words: list[str], weights: dict[str, float], norm: float) -> float:
        """What the cosine of any window of the words can be at most."""
        return math.sqrt(sum(weights[w] ** 2 for w in weights.keys() & set(words))) / norm

    def cosine(self, words: list[str], size: int, weights: dict[str, float], norm: float, least: float) -> float:
        """The best cosine of a window of ``size`` to ``2 * size`` words, or of all if there are fewer; 0 if under ``least``."""
        best, fewest = 0.0, min(size, len(words))
        for start in range(len(words) - fewest + 1):
            window = words[start:start + 2 * size]
            if self.bound(window, weights, norm) < max(least, best):
                continue
            dot = squares = 0.0
            counts: dict[str, int] = {}
            for n, word in enumerate(window, 1):
                before = counts.get(word, 0)
                counts[word] = before + 1
                idf = self.idf.get(word, self.rare)
                now, then = (1 + math.log(before + 1)) * idf, (1 + math.log(before)) * idf if before else 0.0
                squares += now * now - then * then
                dot += (now - then) * weights.get(word, 0.0)
                if n >= fewest:
                    best = max(best, dot / (norm * math.sqrt(squares)))
        return best

    def best(self, statement: str, least: float) -> tuple[str, float] | None:
        """The closest template's licence and cosine, if at least ``least``; ties go to the first by name."""
        words = WORD.findall(statement.lower())
        found = []
        for name, size, weights, norm in self.templates:
            missing = size < FEW_WORDS and not weights.keys() <= set(words)
            if not missing and self.bound(words, weights, norm) >= least:
                found.append((-round(self.cosine(words, size, weights, norm, least), 9), name))
        less, name = min(found, default=(0.0, ""))
        return (name, -less) if found and -less >= least else None


def statements(pages: DataFrame) -> DataFrame:
    """row_key and statement: what each page says of rights, cut at elements and sentence ends."""
    bare = F.regexp_replace(F.regexp_replace("html", HIDDEN, "<wbr>"), rf"(?i)<(?!/?(?:{INLINE})(?![a-z0-9-]))[a-z/][^<>]*>", END)
    said = F.split(strip_html(bare), SENTENCE_END)
    return pages.filter(F.col("html").rlike(TRIGGER)).select("row_key", F.explode(said).alias("statement")).filter(
        F.col("statement").rlike(TRIGGER))


def keyed_pages(pages: DataFrame) -> DataFrame:
    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html")).withColumn(
        "row_key", F.struct("page_id", "url", F.xxhash64("html").alias("html_key")))


def own_licences(pages: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """row_key, licence and score of the pages whose best statement is close enough to a template."""

    def setup():
        matcher = Matcher()

        @lru_cache(KEPT_STATEMENTS)
        def closest(statement: str) -> list[dict]:
            found = matcher.best(statement, least)
            return [{"less": -found[1], "licence": found[0]}] if found else []

        return closest

    found = text_function(setup, "array<struct<less: double, licence: string>>")("statement")
    said = statements(pages).select("row_key", F.explode(found).alias("best"))
    return said.groupBy("row_key").agg(F.min("best").alias("best")).select(
        "row_key", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("score"))


def located(pages: DataFrame) -> DataFrame:
    """Add host, folders (names from the top) and file of the page's address."""
    address = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    names = F.split(address, "/")
    return pages.withColumn("host", F.lower(F.get(names, F.lit(0)))).withColumn(
        "folders", F.when(F.size(names) > 2, F.slice(names, 2, F.size(names) - 2)).otherwise(F.array().cast("array<string>"))
    ).withColumn("file", F.when(F.size(names) > 1, F.element_at(names, -1)).otherwise(""))


def scan_licences(pages: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """A row per row of ``pages``: page_id, url, licence, score, basis, folder.

    ``basis`` is ``own`` for a statement on the page, ``inherited`` for that of the nearest
    ``folder`` above, and null without any.  Of several statements the closest counts, and of
    several that speak for one folder too; ties go to the first licence by name.  Null
    or empty pages state nothing but may inherit; pages with a null address lie on a host
    without a name; rows that are equal in all three columns are alike; other columns
    are ignored.
    """
    rows = keyed_pages(pages)
    own = written(own_licences(rows, least), "licences")
    places = located(rows.drop("html"))
    stated = places.join(own, "row_key", "left")
    path = F.array_join("folders", "/")
    speaking = stated.filter(F.col("licence").isNotNull() & F.col("file").rlike(LICENCE_FILE)).groupBy(
        "host", path.alias("folder")).agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("licence"))).alias("stated"))
    above = places.select("row_key", "host", F.explode(F.sequence(F.lit(0), F.size("folders"))).alias("depth"), "folders").select(
        "row_key", "host", "depth", F.array_join(F.slice("folders", F.lit(1), F.col("depth")), "/").alias("folder"))
    nearest = above.join(speaking, ["host", "folder"]).groupBy("row_key").agg(
        F.max(F.struct("depth", "folder", "stated")).alias("near"))
    result = stated.join(nearest, "row_key", "left")
    has, near = F.col("licence").isNotNull(), F.col("near").isNotNull()
    return result.select(
        "page_id", "url", F.coalesce("licence", "near.stated.licence").alias("licence"),
        F.coalesce(F.col("score"), -F.col("near.stated.less")).alias("score"),
        F.when(has, "own").when(near, "inherited").alias("basis"), F.when(~has & near, F.col("near.folder")).alias("folder"))

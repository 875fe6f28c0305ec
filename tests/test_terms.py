from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from alertloom.config import Rules
from pyspark.sql import functions as F

from alertloom.functions.terms import any_sql, let_sql, low_sql, matched

PROBES = [
    ("ox", "an oxbow lake", False), ("ox", "boxing", False), ("ox", "the ox, of course", True), ("ox", "OX", True),
    ("sea salt", "sea  salt", False), ("sea  salt", "Sea Salt cellar", True), ("sea salt", "sea salts", False),
    ("f#", "written in F#.", True), ("f#", "f# minor", True), ("f#", "ff#", False), (".md", "readme.md", True), (".md", "md", False),
    ("a+b", "ka+b", False), ("a+b", "a+b=c", True), ("x/y", "max/yes", False), ("x/y", "(X/Y)", True),
    ("IT", "the IT crowd", True), ("IT", "leave it", False), ("", "anything", False), ("é", "É!", True), ("été", "un été", True),
    ("été", "répété", False), ("stage", "ſtage", True), ("intern", "İntern", True), ("intern", "ıntern", True), ("ox", "ox_2", False),
    ("mi-temps", "Poste à MI-TEMPS.", True),
]


def model(term, text):
    word = re.sub(r"\s+", " ", term).strip()
    if not word:
        return False
    pattern = (r"\b" if word[0].isalnum() else "") + re.escape(word) + (r"\b" if word[-1].isalnum() else "")
    return bool(re.search(pattern, text, 0 if word.lower() == "it" else re.I))


def test_probes(spark):
    terms = list(dict.fromkeys(term for term, _, _ in PROBES))
    df = spark.createDataFrame([(i, text) for i, (_, text, _) in enumerate(PROBES)], "i int, v string")
    got = df.select("i", matched("v", terms, Rules()).alias("hits")).orderBy("i").collect()
    for (term, text, expected), row in zip(PROBES, got):
        label = " ".join(term.split()).lower()
        assert (label in row.hits) == expected == model(term, text), (term, text)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="stageSTAGEéÉ itIT+.c_-1ıſİœŒ", max_size=20), min_size=1, max_size=40))
def test_matched_random(evaluate, texts):
    rules = Rules()
    terms = ["stage", "IT", "c++", ".c", "é", "ta ge", "a", "1", "_a", "t_", "+", "œ", "é-s", "it", "a a"]
    got = evaluate(lambda _: matched("v", terms, rules), texts)
    each = ", ".join(any_sql([t], rules, "v", "l") for t in terms)
    alone = evaluate(lambda _: F.expr(let_sql("l", low_sql("v"), f"array({each})")), texts)
    for text, hit, singly in zip(texts, got, alone):
        assert hit == [t.lower() for t in terms if model(t, text)], text
        assert singly == [model(t, text) for t in terms], text


def test_matched_order_is_configured(evaluate):
    got = evaluate(lambda _: matched("v", ["web", "java", "Data"], Rules()), ["data JAVA web"])
    assert got == [["web", "java", "data"]]

from __future__ import annotations

import hashlib
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from alertloom.llm import line_dedup
from alertloom.llm.queries import op3_line_dedup
from tests.llm.conftest import SF


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, edits=2, least=20):
    """Kept text of each row, the rows being in order of doc_id."""
    lines = []
    for _, text in rows:
        for line in (text or "").split("\n"):
            plain = line.replace("\r", " ").replace("\t", " ").strip(" ")
            lines.append(plain or None)
    distinct = list(dict.fromkeys(x for x in lines if x is not None))
    # pairs by the edit distance of another engine, which counts bytes: one byte per character
    byte = {ord(c): k + 1 for k, c in enumerate(sorted(set("".join(distinct))))}
    assert len(byte) < 128
    bare = pd.DataFrame([(i, x.translate(byte)) for i, x in enumerate(distinct) if len(x) >= least], columns=["i", "x"])
    pairs = duckdb.sql(f"""SELECT a.i, b.i FROM bare a JOIN bare b ON abs(length(a.x) - length(b.x)) <= {edits} AND a.i < b.i
                           WHERE levenshtein(a.x, b.x) <= {edits}""").fetchall() if len(bare) else []
    top = {x: x for x in distinct}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        top[find(distinct[a])] = find(distinct[b])
    of = {x: find(x) for x in distinct}
    seen, out = set(), []
    for doc_id, text in rows:
        kept, dropped = [], 0
        for line in (text or "").split("\n"):
            plain = line.replace("\r", " ").replace("\t", " ").strip(" ")
            if plain:
                if of[plain] in seen:
                    dropped += 1
                    continue
                seen.add(of[plain])
            kept.append(line)
        out.append((doc_id, "\n".join(kept), dropped))
    return out


def report(df):
    return sorted((r.doc_id, r.n_dropped, r.kept_sha256) for r in df.collect())


def want_report(rows, **options):
    return [(i, n, hashlib.sha256(t.encode()).hexdigest()) for i, t, n in brute(rows, **options)]


def test_query_equals_brute_force(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    want = want_report(rows)
    assert report(op3_line_dedup(spark, SF)) == want
    assert any(r[1] for r in want)


def test_edits_at_every_place(docs_of):
    rng = random.Random(2)
    rows = []
    for k in range(12):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(22, 60))).strip().ljust(22, "q")
        for _ in range(5):
            line = list(base)
            for _ in range(rng.randrange(4)):
                place = rng.randrange(len(line))
                line[place:place + rng.randrange(2)] = rng.choice(["", "x", "é"])
            rows.append((len(rows), f"{''.join(line)}\nshort\n{base if rng.random() < .3 else ''}"))
    assert report(line_dedup.line_report(docs_of(rows))) == want_report(rows)
    texts = {r.doc_id: r for r in line_dedup.without_repeats(docs_of(rows)).collect()}
    for doc_id, text, _ in brute(rows):
        assert texts[doc_id].text == text and texts[doc_id].n_chars == len(text) and texts[doc_id].length == "x"


def test_bit_parallel_distance(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(4, 25)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            place = rng.randrange(len(b) + 1)
            b[place:place + rng.randrange(2)] = rng.choice(["", "a", "b"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        for r in df.select("a", "b", line_dedup.within("a", "b", edits).alias("near")).collect():
            assert r.near == (distance(r.a, r.b) <= edits), (r.a, r.b, edits)


def test_odd_rows(docs_of, odd_texts):
    rows = list(enumerate(odd_texts))
    assert report(line_dedup.line_report(docs_of(rows))) == want_report(rows)
    assert line_dedup.line_report(docs_of([])).count() == 0
    line = "the same line of some length"
    kept = line_dedup.without_repeats(docs_of([(None, line), (5, f"{line}\nx"), (5, f"{line}\nx"), (4, f"{line} \nx\n{line}"), (6, None)])).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("4", f"{line} \nx"), ("5", ""), ("5", ""), ("6", None), ("None", "")]


def test_triples_tell_lines_apart(spark):
    """Two edits never change too many triples; three letters put in at different places almost always do."""
    draw = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzé "

    def edited(line, kinds):
        for kind in kinds:
            at = draw.randrange(len(line))
            line = line[:at] + (draw.choice(letters) if kind != "out" else "") + line[at + (kind != "in"):]
        return line

    rows = []
    for _ in range(300):
        line = "".join(draw.choices(letters, k=draw.randint(20, 120)))
        rows.append((0, line, edited(line, draw.choices(["in", "out", "other"], k=2))))
    line = "".join(draw.choices(letters, k=150))
    far = [edited(line, ["in"]) for _ in range(30)], [edited(line, ["in", "in", "in"])[::1] for _ in range(30)]
    rows += [(1, a, b) for a, b in zip(*far)]
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1, *r) for i, r in enumerate(rows)], "a long, b long, kind int, x string, y string")
    marks = line_dedup.triple_marks(pairs.select(F.col("a").alias("node"), F.col("x").alias("line")).union(pairs.select("b", "y")))
    both = pairs.join(marks.toDF("a", "left"), "a").join(marks.toDF("b", "right"), "b")
    near = both.select("kind", line_dedup.sharp_near(F.col("left"), F.col("right"), 2).alias("near")).groupBy("kind").agg(
        F.count_if("near").alias("near")).collect()
    found = {r.kind: r.near for r in near}
    assert found[0] == 300 and found[1] <= 3


def test_many_repeats_without_broadcast(docs_of, monkeypatch):
    """A class of very many lines is not dealt to one task, and gives what small tables give."""
    rows = [(i, "\n".join(["a line that all documents have", f"line {i % 7} of some documents, as long", f"{i} own line {i * i * 7919}"]))
            for i in range(60)]
    want = sorted(map(tuple, line_dedup.line_report(docs_of(rows)).collect()))
    monkeypatch.setattr(line_dedup, "SMALL_BYTES", 0)
    monkeypatch.setattr(line_dedup, "is_small", lambda df, width=None, most=0: False)
    monkeypatch.setattr(line_dedup, "OFTEN", 20)
    dropped = line_dedup.dropped_lines(docs_of(rows))
    assert sorted(map(tuple, line_dedup.line_report(docs_of(rows)).collect())) == want
    assert "sequence" not in dropped._jdf.queryExecution().toString()  # the classes are not copied for every salt


def test_no_copy_of_all_lines_is_written(docs_of, monkeypatch):
    """Only lines that meet another one are written with their characters."""
    rng = random.Random(12)
    rows = [(i, "\n".join("".join(rng.choice("abcdefghij") for _ in range(60)) for _ in range(5))) for i in range(40)]
    rows.append((50, rows[0][1].split("\n")[0][:-1] + "k"))
    held, plain = [], line_dedup.written

    def counted(df, name):
        out = plain(df, name)
        if "line" in out.columns:
            held.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    out = line_dedup.line_report(docs_of(rows))
    assert sorted((r.doc_id, r.n_dropped, r.kept_sha256) for r in out.collect()) == [
        (i, n, hashlib.sha256(t.encode()).hexdigest()) for i, t, n in brute(rows)]
    assert held and max(held) < 20


def test_a_text_is_split_once_however_many_runs_are_kept(spark):
    rows = [("a\nb\n\nc\nd", [1, 3]), ("a", [0]), ("a\nb", []), ("\na\n", [0, 2]), (None, [0])]
    cut = line_dedup.kept_lines("text", "places")
    got = spark.createDataFrame(rows, "text string, places array<int>").select(cut.alias("k")).collect()
    assert [r.k for r in got] == [["a", "", "d"], [], ["a", "b"], ["a"], None]
    assert str(cut).count("split(") == 1

from __future__ import annotations

import random

import numpy as np

from alertloom.llm import toxicity
from alertloom.llm.queries import op10_toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = op10_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = ([r for r in got if r.toxic == k] for k in (1, 0))
    assert np.mean([r.predicted for r in toxic]) > 0.8 and np.mean([r.predicted for r in clean]) < 0.03
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def model(texts):
    counts = {}
    for text in texts:
        codes = toxicity.letter_codes(text)
        for gram in codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]:
            counts[int(gram)] = counts.get(int(gram), 0) + 1
    return toxicity.Restorer(counts)


def test_disguises_are_undone():
    restorer = model(["you are an idiot and a loser, what stupid trash and scum is this", "the worthless moron reads on"] * 3)
    for said, meant in {
        "1d10t": "idiot", "i d i o t": "idiot", "stuuuupid": "stupid", "tr@sh!!": "trash", "$cum": "scum", "m.o.r.o.n": "moron",
        "w0rthle$$": "worthless", "l-o-s-e-r": "loser", "THE!!": "the", "a$$$": "a", "Reads,": "reads", "2024": "2024", "": "",
    }.items():
        assert restorer.restore(said) == meant, said
    assert restorer.restore("an 1d10t reads") == "an idiot reads"


def test_viterbi_is_the_cheapest_reading():
    restorer = model(["aba bab abba", "baab"])

    def every(text):
        readings = [("", 0.0)]
        for choices in restorer.options(text):
            readings = [(said + out, price + more) for said, price in readings for out, more in choices]
        best = []
        for said, price in readings:
            two = 0
            kept = ""
            for out in said:
                if out == " " and not two & 0x1FFFFF:
                    continue
                letter = 0 if out == " " else ord(out)
                price += restorer.cost(two, letter)
                two = (two << 21 | letter) & (1 << 42) - 1
                kept += out
            best.append((price + restorer.cost(two, 0), kept.strip()))
        return min(best)[1]

    for text in ("ab@b", "aabb", "8a8", "a.b.a", "b44b"):
        assert restorer.read(text) == every(text), text


def test_odd_rows(spark, docs_of, odd_texts):
    rows = [*enumerate(odd_texts), *[(100 + i, f"fine words {i}" + " nasty thing" * (i % 3 == 0)) for i in range(150)], (None, "nasty")]
    labels = spark.createDataFrame([(100 + i, 5, int(i % 3 == 0)) for i in range(150)] + [(None, 1, 1), (101, None, None), (3, 0, 9)],
                                   "doc_id long, length int, toxic int")
    got = toxicity.score_documents(docs_of(rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id >= 100:
            assert r.predicted == int((r.doc_id - 100) % 3 == 0)
        elif r.doc_id is not None:
            assert r.predicted == 0 and r.score == toxicity.FLOOR
    kept = toxicity.without_toxic(docs_of(rows), labels)
    assert kept.columns == docs_of(rows).columns and kept.count() == len(rows) - sum(r.predicted for r in got)
    assert toxicity.score_documents(docs_of([]), labels).count() == 0
    assert {r.score for r in toxicity.score_documents(docs_of(rows), labels.filter("toxic = 0")).collect()} == {toxicity.FLOOR}


def test_every_disguise_of_the_lattice_is_read():
    restorer = model(["you are an idiot and a loser, what stupid trash and scum is this", "the worthless moron reads on, so dumb it is"] * 30)
    for said, meant in {
        "mooron": "moron", "looser": "loser", "scuum": "scum", "stuupid": "stupid", "iddiot": "idiot", "dum8": "dumb",
        "$ c u m": "scum", "l o $ e r": "loser", "i  d  i  o  t": "idiot", '"s c u m"': "scum", "(m o r o n)": "moron", "a n d": "and",
        "l o o s e r": "loser", "iddiot's": "idiot's", "i d i o t!": "idiot", "12 345 678": "12 345 678",
    }.items():
        assert restorer.restore(said) == meant, said
    assert restorer.restore("1d1075").startswith("idiot")
    for said in ("3 4 5", "1 2 3 4", "a + b", "a | b | c"):
        assert restorer.joined(said) == said


def test_model_has_all_that_lattices_ask_for(spark, docs_of):
    # more distinct trigrams than any fixed number that was kept before, each more frequent than those of the last rows
    letters = [chr(0x4E00 + k) for k in range(620)]
    common = [a + b + "一" for a in letters for b in letters[:340]]
    rows = [*((k, " ".join(common[k::40] * 2)) for k in range(40)), (50, "rare ködfüm 7ödfüm k0dfum ko$$er l i $ a ködd")]
    got = toxicity.character_model(docs_of(rows))
    whole = model([text for _, text in rows])
    assert len(whole.counts) > 200_000 and got.letters == whole.letters and len(got.counts) < 5000
    asker = toxicity.Asker()
    for _, text in rows[-1:]:
        asker.restore(text)
        assert got.restore(text) == whole.restore(text)
    assert asker.asked
    for gram in asker.asked:
        two, letter = gram >> 21, gram & 0x1FFFFF
        assert got.cost(two, letter) == whole.cost(two, letter)


def test_words_in_use_stay_known(monkeypatch):
    """A full cache loses no word of the text at hand, and no word that every text has is read again."""
    texts = [f"w0rthle$$ n{i}xx fo0l {'abcdefghij'[i % 10]}{i}zz 1d10t" for i in range(60)]
    restorer = model(["worthless fool idiot"])
    telling = {f: 0.9 for f in toxicity.word_features("worthless") + toxicity.word_features("idiot")}
    want = [toxicity.Judge(restorer, telling).facts(text) for text in texts]
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 8)
    judge, read = toxicity.Judge(restorer, telling), []
    monkeypatch.setattr(restorer, "read", lambda text: read.append(text) or toxicity.Restorer.read(restorer, text))
    assert [judge.facts(text) for text in texts] == want and all(w[1] == 2 for w in want)
    assert read.count("w0rthle$$") == read.count("1d10t") == 1
    assert len(judge.known.young) + len(judge.known.old) < 30


def test_letters_alone_are_read_run_by_run(monkeypatch):
    """Letters alone give what Viterbi reads, without it: a run is worked out once for the letters beside it."""
    restorer = model(["aba bab abba cabb", "baab éab caa"] * 3)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    words += ["b" + "a" * n + end for n in range(1, 30) for end in ("", "b", "cc")]
    want = [restorer.read(word) for word in words]
    monkeypatch.setattr(restorer, "read", lambda word: 1 / 0)
    assert [restorer.core_word(word) for word in words] == want
    asker, asked = toxicity.Asker(), []
    monkeypatch.setattr(asker, "cost", lambda two, letter: asked.append((two, letter)) or 0.0)
    asker.restore(" ".join(f"x{word}x" for word in words))
    first = len(asked)
    asker.restore(" ".join(f"x{one}x{other}x" for one, other in zip(words, words[7:])))
    assert first == len(asked) > 0


def test_letter_codes_are_runs_of_letters():
    for text in ("", "A", " a  b ", "1 2", "ab..CD\x00e", "É x\tÜ!", "İ ß²Ⅷ", "日本 語1", "\x1cq\ud800", "´´"):
        want = [0] if any(map(str.isalpha, text.lower())) else []
        for char in text.lower() + " " if want else "":
            if char.isalpha() or want[-1]:
                want.append(ord(char) if char.isalpha() else 0)
        assert toxicity.letter_codes(text).tolist() == want, text

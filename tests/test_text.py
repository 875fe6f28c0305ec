from __future__ import annotations

import hashlib
import re
from urllib.parse import quote_plus, urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from alertloom.functions import text as T

BASES = ["https://h.example/a/b/c?q=1#f", "http://h.example", "https://h.example/x/", "http://h:8080/a//b"]
REFS = [
    "", "x", "/x", "//o.example/p", "?z=1", "#frag", "../x", "../../../x", "./", "..", ".", "a/./b/../c",
    "mailto:me@x", "javascript:void(0)", "https://z.example", "https://z.example/a/../b", "/a/../../b",
    "x/?y=../z", " x ", "//o.example", "/x//y", "x//y", "HTTP://h.example/up", "g:h", "a\nb", "/..", "/a/.",
    "view?id=12", "categorie/309/annonce/1/Agent.html",
]


def test_normalize_text(evaluate):
    values = ["  A\t B  c ", None, "É À", "a\x1cb", "x　y"]
    expected = [re.sub(r"\s+", " ", v or "").strip().lower() for v in values]
    assert evaluate(T.normalize_text, values) == expected


def test_normalize_url(evaluate):
    values = ["https://X.com/Job/42?utm=1", "https://x.com/job/42/#a", "https://x.com///", "x y/?q",
              "mailto:a@b", "", None, "https://x.com/a/;p?q"]
    assert evaluate(T.normalize_url, values) == [
        "https://x.com/job/42", "https://x.com/job/42", "https://x.com", "x y", "mailto:a@b", "", "",
        "https://x.com/a;p"]


def test_detail_url_keeps_query_and_case(evaluate):
    assert evaluate(T.detail_url, [" https://X.com/view?id=1#top ", None]) == ["https://X.com/view?id=1", ""]


def test_dedupe_key(evaluate):
    rows = [("https://x.com/job/42?utm=1", "ACME", "Stage Java"), ("https://x.com/job/42", "acme", "stage java"),
            ("https://x.com/job/43", "ACME", "Stage Java")]
    a, b, c = evaluate(T.dedupe_key, rows, "u string, c string, t string")
    assert a == b != c
    assert a == hashlib.sha256(b"https://x.com/job/42|acme|stage java").hexdigest()


def test_url_host(evaluate):
    assert evaluate(T.url_host, ["https://A.b:80/x", "/x", "http://h?q", "mailto:x"]) == ["A.b:80", "", "h", ""]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab é*~+%&/'!() 中", max_size=12), min_size=1, max_size=20))
def test_form_encode(evaluate, values):
    assert evaluate(T.form_encode, values) == [quote_plus(v) for v in values]


def test_truncate(evaluate):
    assert evaluate(lambda c: T.truncate(c, 256), ["short", "a" * 300, None, " x "]) == [
        "short", "a" * 253 + "...", "", "x"]
    assert evaluate(lambda c: T.truncate(c, 10), ["abcdef  ghijkl"]) == ["abcdef..."]


def test_url_join_table(evaluate):
    pairs = [(b, r) for b in BASES for r in REFS]
    got = evaluate(T.url_join, pairs, "b string, r string")
    wrong = [(p, g, urljoin(*p)) for p, g in zip(pairs, got) if g != urljoin(*p)]
    assert not wrong


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", "/", "?q", "#f", "x.html"]), max_size=6)
                .map("".join), min_size=1, max_size=25))
def test_url_join_random(evaluate, refs):
    pairs = [(b, r) for b in BASES for r in refs]
    got = evaluate(T.url_join, pairs, "b string, r string")
    assert [g for g in got] == [urljoin(*p) for p in pairs]


def test_entities_and_tags(evaluate):
    cases = {"a &amp;lt; b": "a &lt; b", "&eacute;&#233;&#xE9;&nope;": "ééé&nope", "x & y": "x & y", "&#128512;": "😀",
             "a&amp": "a&", "&copyright &copy 1": "&copyright © 1", "&#150;&#x80;": "–€", "&#xD800;&#99999999;": "��",
             "R&D;": "R&D", "&#;": "&#;"}
    assert evaluate(T.decode_entities, list(cases)) == list(cases.values())
    fragments = ["<p>Java <b>Spring</b> stage</p>", "<p> a </p>\n<script>var x='<b>';</script><!-- c -->&eacute;",
                 "plain  text", "", None, "a<br/>b &lt;i&gt;"]
    assert evaluate(T.strip_html, fragments) == ["Java Spring stage", "a é", "plain  text", "", "", "a b <i>"]

from __future__ import annotations

import hashlib
import re

from alertloom.llm import pii
from alertloom.llm.queries import op6_pii
from tests.llm.conftest import SF

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def keep(kind, text):
    digits = [int(c) for c in text if "0" <= c <= "9"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if keep(k, m.group())]


TEXTS = [
    "write to a.b+c@d-e.co.uk, or x@y or @z.com or a@b..c; p@q.r.s_t@u.v!", "a@b.c@d.e", "a@b.com@c.org x%y@z.w.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.2.3.255 0000.1.2.3 9.9.9", "4539 1488 0343 6467 and 4539148803436467 4539-1488-0343-6467-",
    "4539 1488 0343 6468", "call +1 (262) 555-3752 or +12345678. or +1234567 or ++49 30 123456-", "+1" + "2" * 20,
    "ä" * 30 + "é@x.fr é 10.0.0.1", "1" * 50_000, "a" * 50_000 + "@", "1-" * 9 + "1 " * 9, "." * 1000 + "@a.b",
    "my iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not GB82WEST12345698765431",
    "ssn 078-05-1120", "part 078-05-1120 x",
]


def test_base_spans_equal_plain_patterns():
    for text in TEXTS:
        assert pii.base_spans(text) == (brute(text) if len(text) < 10_000 else pii.base_spans(text)), text


def test_checksums_and_context():
    assert [s[0] for s in pii.more_spans(TEXTS[-3])] == ["iban", "iban"]
    assert [s[0] for s in pii.more_spans(TEXTS[-2])] == ["ssn"] and pii.more_spans(TEXTS[-1]) == []
    text = "mail a@b.co now"
    span = pii.base_spans(text)[0]
    assert pii.score(text, span) > pii.score("xxxx a@b.co now", span)
    assert pii.redacted(text, [span]) == "mail [email] now"


def test_query_equals_plain_patterns(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: r for r in op6_pii(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        want = brute(text)
        row = got[doc_id]
        assert row.base_sha256 == hashlib.sha256(pii.shown(want).encode()).hexdigest()
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(s[0] == k for s in want) for k in PLAIN)
        assert row.spans.startswith(pii.shown(want))


def test_odd_rows(docs_of, odd_texts):
    rows = [*enumerate(odd_texts), (None, "a@b.c"), (1, "a@b.c")]
    got = pii.find_pii(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), r.n_email) for r in got if r.n_email) == [("1", 1), ("None", 1)] and len(got) == len(rows)
    assert pii.find_pii(docs_of([])).count() == 0


def test_iban_before_other_blocks():
    for number in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"):
        for text in (f"{number} BIC COBADEFF", f"{number} 12 EUR", f"{number} BIC COBADEFFXXX AND MORE CAPITALS", f"{number} Bank",
                     f"XY12 {number}", f"{number} {number} X", f"{number}."):
            got = [text[start:end] for kind, start, end in pii.more_spans(text) if kind == "iban"]
            assert got == [number] * text.count(number), text
    assert pii.more_spans("DE89 3704 0044 0532 0130 01 BIC") == []

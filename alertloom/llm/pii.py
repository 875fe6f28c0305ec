"""Personal data in texts: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds have one fixed meaning each (``BASE_KINDS``).  Further kinds are weaker by
form alone, so they need a checksum or words around them: an IBAN must pass mod-97, a
national number needs a word such as "ssn" nearby.  Every search is linear in the text:
a pattern is only tried where a run of its characters begins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from alertloom.llm.common import batches, narrow, whole

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn")
# The patterns of the kinds.
LOCAL_CHAR = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# Words that make a kind likelier, and words that make it less likely.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "number"),
}
AGAINST = ("version", "example", "isbn", "serial", "invoice")
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT_GAIN, CONTEXT_LOSS = 0.3, 0.2
CONTEXT_CHARS = 40
LEAST_SCORE = 0.5
WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn checksum."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    """Whether an IBAN without blanks leaves 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: each ``@`` takes the run of name characters before it."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and LOCAL_CHAR.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        done = at = found.end() if found else at + 1


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds by kind as listed, then start."""
    spans: list[Span] = []
    if "@" in text:
        spans += [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        spans += [("ip", *m.span()) for m in IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = digits_of(m.group()) if m.end() - m.start() < 64 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            spans += [("phone", *m.span()) for m in PHONE.finditer(text)
                      if 8 <= len(DIGIT.findall(m.group())) <= 15]
    return spans


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers that pass the checksum: of each run of blocks the longest that does, so that words after it do no harm."""
    at = 0
    while found := IBAN.search(text, at):
        start, at = found.start(), found.start() + 1
        ends = [found.end(), *(k for k in range(found.end() - 1, start, -1) if text[k] == " ")]
        for end in ends:
            if 15 <= len(c := text[start:end].replace(" ", "")) <= 34 and mod_97(c):
                yield start, end
                at = end
                break


def more_spans(text: str) -> list[Span]:
    """Spans of further kinds: an IBAN by its checksum, a national number by its context."""
    spans = [("iban", *s) for s in ibans(text)]
    spans += [("ssn", *m.span()) for m in SSN.finditer(text)]
    return [s for s in spans if score(text, s) >= LEAST_SCORE]


def score(text: str, span: Span) -> float:
    """How likely a span is personal data, 0 to 1, by its kind and the words around it."""
    kind, start, end = span
    near = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS]}".lower()
    words = set(WORD.findall(near))
    value = BASE_SCORE[kind] + CONTEXT_GAIN * any(w in words for w in CONTEXT[kind])
    return min(1.0, max(0.0, value - CONTEXT_LOSS * any(w in words for w in AGAINST)))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are one."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find_pii(documents: DataFrame) -> DataFrame:
    """A row per row of ``documents`` with its spans.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, scores
    (of all spans in their order), redacted_text.  Offsets are code points, ends
    exclusive.  Null and empty texts have no spans; repeated rows are searched each;
    a null doc_id is carried along; other columns are ignored.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = value.as_py()
            base = base_spans(text)
            more = more_spans(text)
            spans = base + more
            counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
            rows.append((doc_id, *counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), len(more),
                         [score(text, s) for s in spans], redacted(text, spans) if spans else text))
        names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_more", "scores", "redacted_text"]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return batches(narrow(documents).select("doc_id", whole().alias("text")), work,
                   "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
                   "n_more long, scores array<double>, redacted_text string")

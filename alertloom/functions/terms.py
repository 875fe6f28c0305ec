"""Keyword matching with Unicode word borders.

There are two exact ways to look for a term, both on the lower-cased text.

To learn whether *any* of a list occurs, terms are tried in turn: a substring search,
then, if that succeeds, a regex for the borders.  The first hit ends the search.

To learn *which* of a list occur, the text is cut into its words once, and one hash
intersection with the words of all terms tells which can occur.  A term of one word is
decided by that; only terms with blanks or symbols whose words are all there are
searched for.  The cost is that of reading the text, nearly whatever the number of terms.

Expressions are SQL text, as lists of a hundred terms are too many calls to build one by
one from Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.config import Rules

# A word character: letter, number or underscore.  Spelled out instead of ``\b`` because
# the meaning of ``\b`` next to accents changes between Java versions and regex engines.
WORD = r"[\p{L}\p{N}_]"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let_sql(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def tidy(term: str) -> str:
    return " ".join((term or "").split())


def term_label(term: str) -> str:
    return tidy(term).lower()


def is_exact(term: str, rules: Rules) -> bool:
    return term_label(term) in rules.exact_case


def term_regex(word: str) -> str:
    """Java pattern of a term; a border is asked for only beside a letter or digit.

    The literal stands first and its left border is checked by looking back over it,
    which lets the engine skip quickly to places where the literal begins.
    """
    body = "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in word)
    left = f"(?<!{WORD}{body})" if word[0].isalnum() else ""
    right = f"(?!{WORD})" if word[-1].isalnum() else ""
    return f"{body}{left}{right}"


def _plain(word: str) -> bool:
    """Letters for which comparing lower-case forms equals comparing without case."""
    return all(ord(c) < 0x100 and c != "\xb5" for c in word)


def _parts(term: str) -> list[str]:
    """Words that must be in a text, as whole words, for the term to occur in it."""
    label = term_label(term)
    parts = re.findall(r"\w+", label)
    if not _plain(label):
        return []
    if label[:1] == "_":
        parts = parts[1:]
    if label[-1:] == "_":
        parts = parts[:-1]
    return parts


def low_sql(text: str) -> str:
    """Lower case, plus the letters that equal an ASCII letter only when case is ignored."""
    low = f"lower(replace({text}, 'İ', 'i'))"
    return f"replace(replace({low}, 'ı', 'i'), 'ſ', 's')"


def present_sql(low: str, terms: Iterable[str]) -> str:
    """The words of ``terms`` that occur in ``low``."""
    parts = sorted({p for term in terms for p in _parts(term)})
    if not parts:
        return "cast(array() as array<string>)"
    words = f"split({low}, {quoted('[^' + WORD[1:-1] + ']+')})"
    return f"array_intersect(array({', '.join(map(quoted, parts))}), {words})"


def hit_sql(term: str, rules: Rules, text: str, low: str, present: str | None = None) -> str:
    """True when the term occurs in ``text``; ``low`` and ``present`` are made from it."""
    word, label = tidy(term), term_label(term)
    if not word:
        return "false"
    parts = _parts(term)
    checks = [f"array_contains({present}, {quoted(p)})" for p in dict.fromkeys(parts) if present]
    if is_exact(term, rules):
        checks += [f"contains({text}, {quoted(word)})", f"{text} RLIKE {quoted(term_regex(word))}"]
    elif not _plain(label):
        checks.append(f"{text} RLIKE {quoted('(?iu)' + term_regex(word))}")
    elif parts != [label] or not present:
        checks += [f"contains({low}, {quoted(label)})", f"{low} RLIKE {quoted(term_regex(label))}"]
    return "(" + " AND ".join(checks) + ")"


def any_sql(terms: Iterable[str], rules: Rules, text: str, low: str) -> str:
    """True when one of the terms occurs."""
    return "(" + " OR ".join(["false", *[hit_sql(t, rules, text, low) for t in terms]]) + ")"


def list_sql(terms: Iterable[str], rules: Rules, text: str, low: str, present: str) -> str:
    """The terms that occur, normalised, in configured order."""
    hits = [f"CASE WHEN {hit_sql(t, rules, text, low, present)} THEN {quoted(term_label(t))} END" for t in terms]
    return f"array_compact(array({', '.join(hits)}))" if hits else "cast(array() as array<string>)"


def matched(column: str, terms: Iterable[str], rules: Rules) -> Column:
    """Terms that occur in a text column."""
    terms = list(terms)
    body = let_sql("p", present_sql("l", terms), list_sql(terms, rules, "t", "l", "p"))
    return F.expr(let_sql("t", f"coalesce({column}, '')", let_sql("l", low_sql("t"), body)))

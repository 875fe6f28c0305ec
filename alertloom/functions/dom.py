"""Selecting inside one page: expressions over the ``els`` and ``texts`` arrays.

These play the part of CSS selectors.  An element is a struct as made by
``sources.dom``; a "card" is an element together with its own descendants and texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.functions.text import let

Test = Callable[[Column], Column]


def attr(e: Column, name: str) -> Column:
    """Attribute value, '' when absent."""
    return F.coalesce(F.try_element_at(e.attrs, F.lit(name)), F.lit(""))


def has(e: Column, name: str) -> Column:
    return F.map_contains_key(e.attrs, name)


def tag(*names: str) -> Test:
    return lambda e: e.tag.isin(*names)


def holds(name: str, part: str) -> Test:
    """``[name*=part]``"""
    return lambda e: F.contains(attr(e, name), F.lit(part))


def css_class(name: str) -> Test:
    return lambda e: F.contains(F.concat(F.lit(" "), attr(e, "class"), F.lit(" ")), F.lit(f" {name} "))


def any_of(*tests: Test) -> Test:
    def check(e: Column) -> Column:
        out = tests[0](e)
        for test in tests[1:]:
            out = out | test(e)
        return out

    return check


def link(part: str = "") -> Test:
    """``a[href]`` or ``a[href*=part]``"""
    if not part:
        return lambda e: (e.tag == "a") & has(e, "href")
    return lambda e: (e.tag == "a") & F.contains(attr(e, "href"), F.lit(part))


def first(elements: Column, test: Test) -> Column:
    """First match in document order, null when there is none."""
    return F.get(F.filter(elements, test), F.lit(0))


def inside(els: Column, e: Column) -> Column:
    """Descendants of ``e``, in document order."""
    return F.slice(els, e.pos + 2, e.span)


def text_of(texts: Column, e: Column) -> Column:
    return F.array_join(F.slice(texts, e.t0 + 1, e.tn), " ")


def enclosing(els: Column, test: Test) -> Column:
    """For every element of a page the place of its nearest ancestor that passes, -1 when none does.

    An element points to itself if it passes, else to its parent.  Following all pointers
    at once doubles what each spans, so a page of n elements takes n log n steps however
    deep it is nested and however many elements pass.  Null when no element passes.
    """
    nowhere = F.lit(-1)
    start = F.transform(els, lambda e: F.when(test(e), e.pos).otherwise(e.up))
    doublings = F.sequence(F.lit(1), F.ceil(F.log2(F.size(els) + 1)).cast("int"))
    at = F.aggregate(
        doublings, start,
        lambda at, _: F.transform(at, lambda p: F.when(p < 0, p).otherwise(F.get(at, p))),
        lambda at: F.transform(els, lambda e: F.when(e.up < 0, nowhere).otherwise(F.get(at, e.up))),
    )
    return F.when(F.exists(els, test), at)


def is_under(e: Column, around: Column) -> Column:
    """True when ``e`` has an ancestor that passes; ``around`` comes from ``enclosing``."""
    return F.coalesce(F.get(around, e.pos) >= 0, F.lit(False))


def nearest(els: Column, e: Column, around: Column) -> Column:
    """The closest ancestor of ``e`` that passes, null when none does."""
    place = F.get(around, e.pos)
    return F.when(place >= 0, F.get(els, place))


def value_of(texts: Column, e: Column) -> Column:
    """``content``, else ``datetime``, else the text of an element."""
    empty = F.lit("")
    return F.coalesce(
        F.nullif(attr(e, "content"), empty), F.nullif(attr(e, "datetime"), empty), F.nullif(text_of(texts, e), empty)
    )


def pick(texts: Column, elements: Column, tests: list[Test]) -> Column:
    """Tests are tried in order; of each only the first match counts.  '' when all are empty."""
    values = [let(first(elements, test), lambda e: F.when(e.isNotNull(), value_of(texts, e))) for test in tests]
    return F.coalesce(*values, F.lit(""))


def first_per(rows: Column, key: Callable[[Column], Column]) -> Column:
    """Keep the first row of every key, order unchanged.

    Rows are sorted by key and place, so that equal keys are neighbours, and sorted back.
    """
    def firsts(ordered: Column) -> Column:
        kept = F.filter(ordered, lambda e, i: (i == 0) | (e.key != F.get(ordered, i - 1)["key"]))
        return F.array_sort(F.transform(kept, lambda e: F.struct(e.place.alias("place"))))

    keyed = F.transform(rows, lambda row, i: F.struct(key(row).alias("key"), i.alias("place")))
    return let(
        F.struct(rows.alias("rows"), let(F.array_sort(keyed), firsts).alias("kept")),
        lambda v: F.transform(v.kept, lambda k: F.get(v.rows, k.place)),
    )

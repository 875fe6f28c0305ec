"""Pages to element trees: the one step that needs Python.

Each page becomes one row holding its elements in document order.  An element knows how
many descendants follow it (``span``) and which visible text pieces lie inside it
(``t0``, ``tn``), so a subtree or its text is an array slice.  All selection and field
logic is therefore done by Spark inside the row, without a join or a shuffle per page.
"""

from __future__ import annotations

import json
import sys
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ELEMENT = "struct<pos:int,tag:string,attrs:map<string,string>,up:int,span:int,t0:int,tn:int>"
DOM_SCHEMA = f"els array<{ELEMENT}>, texts array<string>, postings array<string>, error string"

# Tags without content, tags whose text is not visible, kept JSON-LD fields.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
UNSEEN_TAGS = frozenset("script style template rt rp".split())
POSTING_FIELDS = (
    "title", "hiringOrganization", "jobLocation", "jobLocationType", "url", "datePosted", "description",
)
PAGES_PER_BATCH = 128

# Ship this module with the task, so that executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def postings_of(script: str) -> list[str]:
    """JSON text of every job posting in one JSON-LD script, graphs unfolded in order."""
    try:
        root = json.loads(script or "{}", parse_constant=lambda _: None)
    except (ValueError, RecursionError):
        return []
    found = []
    todo = list(reversed(root)) if isinstance(root, list) else [root]
    while todo:
        item = todo.pop()
        if not isinstance(item, dict):
            continue
        graph = item.get("@graph")
        if isinstance(graph, list):
            todo.extend(reversed(graph))
        elif item.get("@type") == "JobPosting":
            found.append(json.dumps({k: item[k] for k in POSTING_FIELDS if k in item}))
    return found


def character(number: int) -> str:
    """Text of a numeric reference; 128 to 159 are meant as Windows-1252."""
    if 128 <= number < 160:
        return bytes([number]).decode("cp1252", "ignore") or chr(number)
    return chr(number) if number < 0xD800 or 0xDFFF < number < 0x110000 else "\ufffd"


class _Outline(HTMLParser):
    """Collects elements, visible texts and JSON-LD scripts of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.rows: list[list] = []  # tag, attrs, up, span, t0, tn
        self.texts: list[str] = []
        self.postings: list[str] = []
        self._open: list[int] = []
        self._open_tags: Counter[str] = Counter()
        self._unseen = 0
        self._data: list[str] = []

    def _flush(self) -> None:
        text, self._data = "".join(self._data), []
        if not self._unseen:
            text = text.strip()
            if text:
                self.texts.append(text)
        elif self._open:
            tag, attrs = self.rows[self._open[-1]][:2]
            if tag == "script" and attrs.get("type", "").lower() == "application/ld+json":
                self.postings.extend(postings_of(text))

    def _close_top(self) -> None:
        row = self.rows[self._open.pop()]
        self._open_tags[row[0]] -= 1
        row[3] = len(self.rows) - row[3] - 1
        row[5] = len(self.texts) - row[4]
        self._unseen -= row[0] in UNSEEN_TAGS

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        named = {name: value or "" for name, value in attrs}
        if "class" in named:
            named["class"] = " ".join(named["class"].split())
        up = self._open[-1] if self._open else -1
        self._open.append(len(self.rows))
        self._open_tags[tag] += 1
        self.rows.append([tag, named, up, len(self.rows), len(self.texts), 0])
        self._unseen += tag in UNSEEN_TAGS
        if tag in VOID_TAGS:
            self._close_top()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close_top()

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if self._open_tags[tag] > 0:
            while self.rows[self._open[-1]][0] != tag:
                self._close_top()
            self._close_top()

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def handle_data(self, data: str) -> None:
        self._data.append(data)

    def handle_entityref(self, name: str) -> None:
        self._data.append(html5.get(f"{name};", f"&{name}"))

    def handle_charref(self, name: str) -> None:
        self._data.append(character(int(name[1:], 16) if name[0] in "xX" else int(name)))

    def _break(self, _: str) -> None:
        self._flush()

    handle_comment = handle_decl = handle_pi = unknown_decl = _break

    def outline(self, html: str) -> None:
        self.feed(html)
        self.close()
        self._flush()
        while self._open:
            self._close_top()


def _offsets(sizes: list[int]) -> pa.Array:
    total, out = 0, [0]
    for size in sizes:
        total += size
        out.append(total)
    return pa.array(out, pa.int32())


def _dom_columns(pages: list[str | None]) -> list[pa.Array]:
    rows: list[list] = []
    texts: list[str] = []
    postings: list[str] = []
    row_sizes, text_sizes, posting_sizes, errors = [], [], [], []
    for html in pages:
        outline, error = _Outline(), None
        try:
            outline.outline(html or "")
        except Exception as exc:  # one bad page must not end the job
            outline, error = _Outline(), f"{type(exc).__name__}: {exc}"
        rows.extend([pos, *row] for pos, row in enumerate(outline.rows))
        texts.extend(outline.texts)
        postings.extend(outline.postings)
        row_sizes.append(len(outline.rows))
        text_sizes.append(len(outline.texts))
        posting_sizes.append(len(outline.postings))
        errors.append(error)
    pos, tags, attrs, up, span, t0, tn = zip(*rows) if rows else ((),) * 7
    keys = [k for a in attrs for k in a]
    values = [v for a in attrs for v in a.values()]
    maps = pa.MapArray.from_arrays(
        _offsets([len(a) for a in attrs]), pa.array(keys, pa.string()), pa.array(values, pa.string())
    )
    ints = {n: pa.array(v, pa.int32()) for n, v in
            (("pos", pos), ("up", up), ("span", span), ("t0", t0), ("tn", tn))}
    elements = pa.StructArray.from_arrays(
        [ints["pos"], pa.array(tags, pa.string()), maps, ints["up"], ints["span"], ints["t0"], ints["tn"]],
        names=["pos", "tag", "attrs", "up", "span", "t0", "tn"],
    )
    return [
        pa.ListArray.from_arrays(_offsets(row_sizes), elements),
        pa.ListArray.from_arrays(_offsets(text_sizes), pa.array(texts, pa.string())),
        pa.ListArray.from_arrays(_offsets(posting_sizes), pa.array(postings, pa.string())),
        pa.array(errors, pa.string()),
    ]


def with_dom(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the ``html`` column by ``els``, ``texts``, ``postings`` and ``error``."""
    kept = [c for c in pages.columns if c != html]

    def outline_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*kept, "els", "texts", "postings", "error"]
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_PER_BATCH):
                part = batch.slice(start, PAGES_PER_BATCH)
                columns = [part.column(i) for i in range(len(kept))]
                dom = _dom_columns(part.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*columns, *dom], names=names)

    narrow = pages.select(*kept, F.col(html))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != html)
    return narrow.mapInArrow(outline_batches, f"{fields}, {DOM_SCHEMA}" if fields else DOM_SCHEMA)


def elements(dom: DataFrame, *keys: str) -> DataFrame:
    """One row per element with its visible text."""
    text = F.expr("array_join(slice(texts, e.t0 + 1, e.tn), ' ')")
    return dom.select(*keys, "texts", F.explode("els").alias("e")).select(*keys, "e.*", text.alias("text"))

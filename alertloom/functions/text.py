"""Text and URL expressions.  Everything here stays inside the JVM."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only the blank."""
    return F.btrim(col, F.lit(SPACES))


def collapse(col: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.btrim(F.regexp_replace(text_or_empty(col), f"[{SPACE_CLASS}]+", " "), F.lit(" "))


def normalize_text(col: Column) -> Column:
    return F.lower(collapse(col))


def _clean_url(col: Column) -> Column:
    """Drop leading control characters and any tab or line break, as URL readers do."""
    bare = F.translate(text_or_empty(col), "\t\r\n", "")
    return F.regexp_replace(bare, r"^[\x00-\x20]+", "")


def normalize_url(col: Column) -> Column:
    """URL without query, fragment and closing slashes, in lower case."""
    bare = F.regexp_replace(_clean_url(col), r"[?#][\s\S]*$", "")
    return F.lower(F.regexp_replace(bare, r"/+(;[^/]*)?$", "$1"))


def detail_url(col: Column) -> Column:
    """URL without its fragment; query and case stay, offer ids live there."""
    return strip(F.split_part(text_or_empty(col), F.lit("#"), F.lit(1)))


def url_host(col: Column) -> Column:
    """Authority part including the port, case kept; '' when there is none."""
    return F.regexp_extract(text_or_empty(col), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def dedupe_key(url: Column, company: Column, title: Column) -> Column:
    parts = F.concat_ws("|", normalize_url(url), normalize_text(company), normalize_text(title))
    return F.sha2(parts, 256)


def form_encode(col: Column) -> Column:
    """Form encoding: blanks become '+', everything unsafe is percent-encoded UTF-8."""
    encoded = F.url_encode(text_or_empty(col))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def truncate(col: Column, limit: int) -> Column:
    """At most ``limit`` characters; a cut text ends in three dots."""
    text = strip(text_or_empty(col))
    cut = F.regexp_replace(F.substring(text, 1, limit - 3), f"[{SPACE_CLASS}]+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


# --- URL resolution -----------------------------------------------------------

_URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
# Schemes against which a relative reference can be resolved.
RELATIVE_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)


def _url_parts(url: Column) -> Column:
    names = ("scheme", "host", "path", "query", "fragment")
    return F.struct(*[F.regexp_extract(url, _URL_PARTS, i + 1).alias(n) for i, n in enumerate(names)])


def _build_url(scheme: Column, host: Column, path: Column, query: Column, fragment: Column) -> Column:
    loose = (host != "") & (path != "") & ~F.startswith(path, F.lit("/"))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        F.when(loose, "/").otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def _but_last(parts: Column) -> Column:
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def _walk(pieces: Column) -> Column:
    """Path of a list of pieces after following every '.' and '..'."""
    walked = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == "..", _but_last(out)).when(s == ".", out).otherwise(F.concat(out, F.array(s))),
    )
    ends_open = F.element_at(pieces, -1).isin(".", "..")
    whole = F.when(ends_open, F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return let(F.array_join(whole, "/"), lambda p: F.when(p == "", "/").otherwise(p))


def _merge_paths(base_path: Column, ref_path: Column) -> Column:
    def merge(dirs: Column) -> Column:
        kept = F.when(F.element_at(dirs, -1) == "", dirs).otherwise(_but_last(dirs))
        # a merged path keeps its first and last pieces and drops empty ones between
        return let(
            F.concat(kept, F.split(ref_path, "/")),
            lambda all_: F.filter(all_, lambda s, i: (s != "") | (i == 0) | (i == F.size(all_) - 1)),
        )

    pieces = F.when(F.startswith(ref_path, F.lit("/")), F.split(ref_path, "/")).otherwise(
        let(F.split(base_path, "/"), merge)
    )
    return let(pieces, _walk)


def url_join(base: Column, ref: Column) -> Column:
    """Resolve ``ref`` against the page address ``base`` (RFC 3986)."""

    def resolve(v: Column) -> Column:
        b, r = v.b, v.r
        own_scheme = F.lower(r.scheme)
        base_scheme = F.lower(b.scheme)
        scheme = F.when(own_scheme == "", base_scheme).otherwise(own_scheme)
        query = F.when(r.query == "", b.query).otherwise(r.query)
        foreign = (scheme != base_scheme) | ~scheme.isin(*RELATIVE_SCHEMES)
        return (
            F.when(v.base == "", v.ref)
            .when(v.ref == "", v.base)
            .when(foreign, v.ref)
            .when(r.host != "", _build_url(scheme, r.host, r.path, r.query, r.fragment))
            .when(r.path == "", _build_url(scheme, b.host, b.path, query, r.fragment))
            .otherwise(_build_url(scheme, b.host, _merge_paths(b.path, r.path), r.query, r.fragment))
        )

    return let(
        F.struct(_clean_url(base).alias("base"), _clean_url(ref).alias("ref")),
        lambda u: let(
            F.struct(
                u.base.alias("base"), u.ref.alias("ref"),
                _url_parts(u.base).alias("b"), _url_parts(u.ref).alias("r"),
            ),
            resolve,
        ),
    )


# --- HTML fragments -----------------------------------------------------------

def decode_entities(col: Column) -> Column:
    """Replace character references, each exactly once (``&amp;lt;`` gives ``&lt;``).

    The closing semicolon may be missing; of a name nobody knows only that is dropped.
    """
    table = {name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")}
    # numbers 128 to 159 are meant as Windows-1252
    old = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    table |= {f"#{n}": text for n, text in old.items() if text}
    names = F.from_json(F.lit(json.dumps(table)), "map<string,string>")  # folds to one literal
    tokens = F.regexp_extract_all(
        col, F.lit(r"(&#(?:[0-9]+|[xX][0-9a-fA-F]+);?|&[a-zA-Z][\-.a-zA-Z0-9]*;?|[^&]+|&)"), F.lit(1)
    )

    def number(digits: Column) -> Column:
        scalar = digits.between(0, 0xD7FF) | digits.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(scalar, digits)), 8, "0")), "UTF-32")
        known = F.try_element_at(names, F.concat(F.lit("#"), digits.cast("string")))
        return F.coalesce(known, char, F.lit("\ufffd"))

    def decode(name: Column) -> Column:
        hexa = F.conv(F.regexp_extract(name, r"^#[xX]0*([0-9a-fA-F]{1,8})$", 1), 16, 10)
        deci = F.regexp_extract(name, r"^#0*([0-9]{1,10})$", 1)
        digits = F.coalesce(hexa, F.nullif(deci, F.lit(""))).try_cast("long")
        return F.when(F.startswith(name, F.lit("#")), let(digits, number)).otherwise(
            F.coalesce(F.try_element_at(names, name), F.concat(F.lit("&"), name))
        )

    def replace(token: Column) -> Column:
        name = F.rtrim(F.substring(token, 2, 2_000_000_000), F.lit(";"))
        return F.when(token.rlike("^&."), let(name, decode)).otherwise(token)

    decoded = F.array_join(F.transform(tokens, replace), "")
    return F.when(F.contains(col, F.lit("&")), decoded).otherwise(col)


def strip_html(col: Column) -> Column:
    """Visible text of an HTML fragment: each piece between tags trimmed, one blank apart."""
    text = text_or_empty(col)
    bare = F.regexp_replace(
        text, r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>|<![^>]*>|<\?[^>]*>", "<>"
    )
    pieces = F.split(bare, r"<[^<>]*>")
    kept = F.filter(F.transform(pieces, lambda p: strip(decode_entities(p))), lambda p: p != "")
    return F.when(F.contains(text, F.lit("<")), F.array_join(kept, " ")).otherwise(
        strip(decode_entities(text))
    )

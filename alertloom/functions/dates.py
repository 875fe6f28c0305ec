"""Publication dates: a bounded grammar over English and French, as JVM expressions.

Every function takes ``as_of``, the clock of the run, so results can be repeated.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.functions.text import collapse, let

# --- Fixed values: month and unit names, places where a date may stand -------
MONTHS = {
    1: "january jan janvier janv",
    2: "february feb février fevrier févr fevr fév",
    3: "march mar mars",
    4: "april apr avril avr",
    5: "may mai",
    6: "june jun juin",
    7: "july jul juillet juil",
    8: "august aug août aout",
    9: "september sep sept septembre",
    10: "october oct octobre",
    11: "november nov novembre",
    12: "december dec décembre decembre déc",
}
UNIT_SECONDS = {
    "second": 1, "seconde": 1, "minute": 60, "hour": 3600, "heure": 3600, "day": 86400,
    "jour": 86400, "week": 604800, "semaine": 604800,
}
UNIT_MONTHS = {"month": 1, "mois": 1, "year": 12, "an": 12, "année": 12}
ZONE_HOURS = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
    "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AST": -4, "ADT": -3,
}
PHRASE = r"(?iuU)\b(?:posted|published|il y a|publi[ée]e?|date de publication)\s*[^\n,.]{0,60}"
AGO = r"(?iuU)\b\d+\s+(?:hours?|days?|heures?|jours?|weeks?|semaines?)\s+ago\b"
IL_Y_A = r"(?iuU)\bil y a\s+\d+\s+(?:heures?|jours?|semaines?|mois)\b"
DAY_MONTH_YEAR = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
YEAR_MONTH_DAY = r"\b\d{4}-\d{2}-\d{2}\b"
UNKNOWN_AGE = "Unknown Date"
# --- end of fixed values ------------------------------------------------------

_UNITS = "|".join(sorted((*UNIT_SECONDS, *UNIT_MONTHS), key=len, reverse=True))
_NAMED = r"([a-zéûô]+)\.?"
_CLOCK = r"(?:,?\s+(?:at|à|-)?\s*(\d{1,2})[:h](\d{2})(?::(\d{2}))?)?"


def _lookup(table: dict, key: Column) -> Column:
    """Value of a fixed table; the table becomes one literal when the plan is optimized."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,int>"), key)


def _month(name: Column) -> Column:
    return _lookup({n: number for number, names in MONTHS.items() for n in names.split()}, name)


def _int(col: Column) -> Column:
    return F.nullif(col, F.lit("")).try_cast("int")


def _stamp(year: Column, month: Column, day: Column, hour=None, minute=None, second=None) -> Column:
    """UTC timestamp, or null when the fields name no real moment."""
    zero = F.lit(0)
    fields = [zero if v is None else F.coalesce(v, zero) for v in (hour, minute, second)]
    return F.try_make_timestamp(
        year, month, day, fields[0], fields[1], fields[2].cast("decimal(8,6)"), F.lit("UTC")
    )


def _later(stamp: Column, seconds: Column) -> Column:
    """``stamp`` moved by whole seconds; null outside the years 1 to 9999."""
    moved = stamp.cast("long") + seconds
    kept = let(moved, lambda s: F.when(s.between(-62135596800, 253402300799), s))
    # keep the fraction of a second the clock may carry
    return F.timestamp_micros(kept * 1000000 + F.pmod(F.unix_micros(stamp), F.lit(1000000)))


def iso_parse(col: Column) -> Column:
    """ISO 8601 date or date-time, UTC unless it names a zone; null when unreadable."""
    return let(F.translate(collapse(col), ",", "."), _iso)


def _iso(text: Column) -> Column:
    day = r"^\d{4}-\d{2}-\d{2}$"
    moment = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?"
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})((?:Z|[+-][\d:]+)?)$", "$1:00$2")
    text = F.regexp_replace(text, r"(:\d{2}(?:\.\d+)?) ?([+-]\d{2})$", "$1$2:00")
    text = F.regexp_replace(text, r"(:\d{2}(?:\.\d+)?) ?([+-]\d{2}):?(\d{2})$", "$1$2:$3")
    text = F.regexp_replace(text, r"([T ]\d{2}:\d{2})((?:Z|[+-]\d{2}:\d{2})?)$", "$1:00$2")
    return let(
        text,
        lambda t: F.when(t.rlike(day), F.concat(t, F.lit("T00:00:00Z")))
        .when(t.rlike(moment + "$"), F.concat(t, F.lit("Z")))
        .when(t.rlike(moment + r"(?:Z|[+-]\d{2}:\d{2})$"), t),
    ).try_cast("timestamp")


def _full_year(year: Column) -> Column:
    """Two-digit years stand for 1969 to 2068."""
    return F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)


def _rfc2822(text: Column) -> Column:
    form = (
        r"(?i)^(?:[a-z]{3,9},?\s+)?(\d{1,2})[ -]([a-z]{3,9})[ -](\d{4}|\d{2})\s+"
        r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([+-]\d{4})|\s+([a-z]{1,4}))?$"
    )

    def part(i: int) -> Column:
        return F.regexp_extract(text, form, i)

    year = _int(part(3))
    year = let(year, _full_year)
    sign = F.when(F.startswith(part(7), F.lit("-")), -1).otherwise(1)
    offset = sign * (_int(F.substring(part(7), 2, 2)) * 3600 + _int(F.substring(part(7), 4, 2)) * 60)
    named = _lookup(ZONE_HOURS, F.upper(part(8))) * 3600
    zone = (
        F.when(part(7) != "", offset)
        .when(part(8) != "", named)
        .otherwise(F.lit(0))
    )
    stamp = _stamp(year, _month(F.lower(part(2))), _int(part(1)), _int(part(4)), _int(part(5)), _int(part(6)))
    return F.when(text.rlike(form), _later(stamp, -F.coalesce(zone, F.lit(0))))


def _numeric(text: Column, as_of: Column, day_first: bool) -> Column:
    form = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})$"
    first, second, year = (_int(F.regexp_extract(text, form, i)) for i in (1, 2, 3))
    year = let(year, _full_year)
    short = F.length(F.regexp_extract(text, form, 3)) == 2
    month_first, day_month = _stamp(year, first, second), _stamp(year, second, first)
    order = (day_month, month_first) if day_first else (month_first, day_month)
    century_back = lambda d: F.when(
        short & (d > as_of), F.add_months(d, -1200).cast("timestamp")
    ).otherwise(d)
    return F.when(text.rlike(form), let(F.coalesce(*order), century_back))


def _relative(text: Column, as_of: Column) -> Column:
    count = r"(\d{1,9}|an?|one|une?)"
    english = rf"^(?:about\s+)?{count}\s+({_UNITS})s?\s+ago$"
    french = rf"^il y a\s+(?:environ\s+)?{count}\s+({_UNITS})s?$"

    def part(i: int) -> Column:
        return F.coalesce(
            F.nullif(F.regexp_extract(text, english, i), F.lit("")),
            F.nullif(F.regexp_extract(text, french, i), F.lit("")),
        )

    def back(p: Column) -> Column:
        n = F.when(p.word.rlike(r"^\d"), p.word.try_cast("int")).when(p.word.isNotNull(), 1)
        months = let(n * _lookup(UNIT_MONTHS, p.unit), lambda m: F.when(m < 24000, m))
        return F.coalesce(
            _later(as_of, -(n.cast("long") * _lookup(UNIT_SECONDS, p.unit))),
            as_of - F.make_ym_interval(F.lit(0), months),
        )

    counted = let(F.struct(part(1).alias("word"), part(2).alias("unit")), back)
    named = (
        F.when(text.isin("now", "today", "aujourd'hui", "maintenant"), as_of)
        .when(text.isin("yesterday", "hier"), _later(as_of, F.lit(-86400)))
        .when(text == "avant-hier", _later(as_of, F.lit(-172800)))
    )
    return F.coalesce(named, counted)


def _named_month(text: Column, as_of: Column) -> Column:
    day_first = rf"^(?:[a-zé]+\.?,?\s+)??(\d{{1,2}})(?:er|st|nd|rd|th)?\s+(?:of\s+|de\s+)?{_NAMED},?(?:\s+(\d{{4}}))?{_CLOCK}$"
    month_first = rf"^(?:[a-zé]+\.?,?\s+)??{_NAMED}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?(?:\s+(\d{{4}}))?{_CLOCK}$"

    def read(form: str, d: int, m: int) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(text, form, i)

        clock = [_int(part(i)) for i in (4, 5, 6)]
        month, day, year = _month(part(m)), _int(part(d)), _int(part(3))
        this_year = _stamp(F.year(as_of), month, day, *clock)
        last_year = _stamp(F.year(as_of) - 1, month, day, *clock)
        undated = F.when(this_year <= as_of, this_year).otherwise(last_year)
        return F.when(
            text.rlike(form),
            F.when(year.isNotNull(), _stamp(year, month, day, *clock)).otherwise(undated),
        )

    return F.coalesce(read(day_first, 1, 2), read(month_first, 2, 1))


# every form holds a digit or is one of a few words
_MAYBE_DATE = (
    r"[0-9]|^(?:now|today|yesterday|hier|avant-hier|maintenant|aujourd'hui)$"
    r"|^(?:about )?(?:an?|one) |^il y a "
)
_LEAD = r"^(?:posted|published|publi[ée]e?|date de publication)\s*:?\s*(?:(?:on|le|the)\s+)?"


def parse_date(col: Column, as_of: Column, day_first: bool = False) -> Column:
    """One date written out in full; anything around it makes the result null."""

    def read(text: Column) -> Column:
        bare = F.regexp_replace(F.lower(text), _LEAD, "")
        return let(
            bare,
            lambda b: F.when(
                b.rlike(_MAYBE_DATE),
                F.coalesce(
                    _iso(F.upper(b)),
                    _relative(b, as_of),
                    _numeric(b, as_of, day_first),
                    _rfc2822(text),
                    _named_month(b, as_of),
                ),
            ),
        )

    return let(collapse(col), read)


def date_places(text: Column) -> Column:
    """The five places where running text may hold a date, in the order they are tried."""
    patterns = (PHRASE, AGO, IL_Y_A, DAY_MONTH_YEAR, YEAR_MONTH_DAY)
    return let(text, lambda t: F.array(*[F.regexp_extract(t, p, 0) for p in patterns]))


def first_date(texts: Column, as_of: Column, day_first: bool = False) -> Column:
    """First of several texts that can be read as a date."""
    dates = F.transform(texts, lambda t: parse_date(t, as_of, day_first))
    return F.get(F.array_compact(dates), F.lit(0))


def infer_date(col: Column, as_of: Column, day_first: bool = False) -> Column:
    """First date found in running text."""
    return first_date(date_places(F.coalesce(col, F.lit(""))), as_of, day_first)


def age_text(posted_at: Column, as_of: Column) -> Column:
    """How long ago, in words."""
    seconds = (F.unix_micros(as_of) - F.unix_micros(posted_at)) / F.lit(1000000)
    hours, days = F.floor(seconds / 3600), F.floor(seconds / 86400)
    plural = F.when(days == 1, " ago").otherwise("s ago")
    return (
        F.when(posted_at.isNull(), UNKNOWN_AGE)
        .when(seconds < 3600, "posted less than 1 hour ago")
        .when(seconds < 86400, F.concat(F.lit("posted "), hours.cast("string"), F.lit(" hours ago")))
        .otherwise(F.concat(F.lit("posted "), days.cast("string"), F.lit(" day"), plural))
    )

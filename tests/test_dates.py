from __future__ import annotations

import datetime as dt

from alertloom.functions import dates as D
from tests.clock import AS_OF

DAY = dt.timedelta(days=1)


def test_parse_date(evaluate, as_of):
    cases = {
        "Mon, 21 Aug 2026 10:00:00 +0000": dt.datetime(2026, 8, 21, 10),
        "21 Aug 2026 10:00:00 +0200": dt.datetime(2026, 8, 21, 8),
        "Fri, 21 Aug 2026 10:00 EST": dt.datetime(2026, 8, 21, 15),
        "2026-08-21": dt.datetime(2026, 8, 21),
        "2026-08-20T10:00:00+00:00": dt.datetime(2026, 8, 20, 10),
        "2026-08-20T10:00:00.5Z": dt.datetime(2026, 8, 20, 10, 0, 0, 500000),
        "2026-08-20 10:30 +0100": dt.datetime(2026, 8, 20, 9, 30),
        "il y a 3 jours": AS_OF - 3 * DAY,
        "Publiée il y a 2 semaines": AS_OF - 14 * DAY,
        "5 hours ago": AS_OF - dt.timedelta(hours=5),
        "an hour ago": AS_OF - dt.timedelta(hours=1),
        "il y a un mois": dt.datetime(2026, 7, 25, 12),
        "yesterday": AS_OF - DAY,
        "hier": AS_OF - DAY,
        "20 août 2026": dt.datetime(2026, 8, 20),
        "Jeudi 20 août 2026": dt.datetime(2026, 8, 20),
        "August 20, 2026": dt.datetime(2026, 8, 20),
        "1er septembre 2025": dt.datetime(2025, 9, 1),
        "20 décembre": dt.datetime(2025, 12, 20),
        "date de publication : 21/08/2026": dt.datetime(2026, 8, 21),
        "05/08/2026": dt.datetime(2026, 5, 8),
        "21-08-26": dt.datetime(2026, 8, 21),
        "2026-13-45": None, "31/02/2026": None, "99 foo ago": None, "": None, None: None,
        "Lorem ipsum dolor sit amet": None, "may": None, "2026": None,
        "il y a 999999999 jours": None,
    }
    got = evaluate(lambda c: D.parse_date(c, as_of), list(cases))
    assert dict(zip(cases, got)) == cases
    assert evaluate(lambda c: D.parse_date(c, as_of, day_first=True), ["05/08/2026"]) == [dt.datetime(2026, 8, 5)]


def test_infer_date(evaluate, as_of):
    cases = {
        "published 2 days ago apply now": AS_OF - 2 * DAY,
        "date de publication : 21/08/2026": dt.datetime(2026, 8, 21),
        "Publiée il y a 3 jours Stagiaire": AS_OF - 3 * DAY,
        "x 2026-08-19 y": dt.datetime(2026, 8, 19),
        "ref 12-2026-08-19": dt.datetime(2026, 8, 19),
        "no dates in here at all": None, "": None, None: None,
        "posted on friday, 3 days ago": AS_OF - 3 * DAY,
    }
    got = evaluate(lambda c: D.infer_date(c, as_of), list(cases))
    assert dict(zip(cases, got)) == cases


def test_age_text(evaluate, as_of):
    ages = [None, dt.timedelta(minutes=30), dt.timedelta(hours=-5), dt.timedelta(hours=1), dt.timedelta(hours=5),
            DAY, 3 * DAY, DAY + dt.timedelta(hours=23)]
    got = evaluate(lambda c: D.age_text(c, as_of), [a and AS_OF - a for a in ages], "v timestamp")
    assert got == ["Unknown Date", "posted less than 1 hour ago", "posted less than 1 hour ago",
                   "posted 1 hours ago", "posted 5 hours ago", "posted 1 day ago", "posted 3 days ago",
                   "posted 1 day ago"]


def test_iso_parse(evaluate):
    values = ["2026-08-01T00:00:00+00:00", "2026-11-28T01:49:54.832270+00:00", "2026-08-01", "2026-08-01T05",
              "not-a-date", None, "2026-08-01T05:00+02:00"]
    assert evaluate(D.iso_parse, values) == [
        dt.datetime(2026, 8, 1), dt.datetime(2026, 11, 28, 1, 49, 54, 832270), dt.datetime(2026, 8, 1),
        dt.datetime(2026, 8, 1, 5), None, None, dt.datetime(2026, 8, 1, 3)]

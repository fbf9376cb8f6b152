"""Date rules on text columns. The day that counts as today is always a parameter."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Statuses that close a request.
DONE = ("제출", "완료", "[삭제]", "업무설명")


def _date(y: Column, m: Column, d: Column) -> Column:
    """ISO text of a real calendar day, else null."""
    text = F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def _padded(c: Column, n: int) -> Column:
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def normalize_date(c: Column | str, end: bool = False) -> Column:
    """Year, month or day to the first day it covers, or the last with ``end``; dots count as hyphens.

    The last day of a month outside the calendar is that of the month's number, 28 for an unknown one.
    What doesn't begin with a number is empty.
    """
    parts = F.filter(F.split(F.replace(F.trim(F.coalesce(col(c), F.lit(""))), F.lit("."), F.lit("-")), "-"), lambda p: p != "")
    y, m, d = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    year, number = _padded(y, 4), _padded(m, 2)
    month = F.concat(year, F.lit("-"), number)
    fixed = F.when(number.isin("01", "03", "05", "07", "08", "10", "12"), "31").when(number.isin("04", "06", "09", "11"), "30").otherwise("28")
    last = F.coalesce(F.date_format(F.last_day(F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")), "yyyy-MM-dd"), F.concat(month, F.lit("-"), fixed))
    return (
        F.when(y.isNull() | ~y.rlike(r"^\d+$"), F.lit(""))
        .when(m.isNull(), F.concat(year, F.lit("-12-31" if end else "-01-01")))
        .when(d.isNull(), last if end else F.concat(month, F.lit("-01")))
        .otherwise(F.concat(month, F.lit("-"), _padded(d, 2)))
    )


#: Weekday in brackets after a date.
_WEEKDAY = r"(?:\(\s*[월화수목금토일](?:요일)?\s*\))?"


def normalize_ledger_date(c: Column | str, year: Column | str, as_of: datetime.date) -> Column:
    """Dates as people type them in a ledger, to ISO text; what can't be read stays as it is.

    An ISO beginning is taken as it stands. Years of two digits lie between 2010 and the year after ``as_of``.
    Days without a year get that of the sheet.
    """
    text, sheet = F.trim(col(c)), F.trim(col(year).cast("string"))
    full = rf"^(\d{{4}})\s*[.년/-]\s*(\d{{1,2}})\s*[.월/-]\s*(\d{{1,2}})\s*[.일]?\s*{_WEEKDAY}$"
    two = rf"^(\d{{2}})\s*\.\s*(\d{{1,2}})\s*\.\s*(\d{{1,2}})\s*\.?\s*{_WEEKDAY}$"
    short = rf"^(\d{{1,2}})\s*[./]\s*(\d{{1,2}})\s*\.?\s*{_WEEKDAY}$"
    g = lambda p, i: F.regexp_extract(text, p, i)
    at = lambda s, n: F.substring(digits, s, n)
    digits = F.regexp_replace(text, r"\D", "")
    recent = lambda y: F.when(y.between("2010", str(as_of.year + 1)), y)
    of_sheet = F.when(sheet.rlike(r"^\d+$") & (sheet.try_cast("int") > 0), sheet)
    by_digits = (
        F.when(F.length(digits) == 4, _date(of_sheet, at(1, 2), at(3, 2)))
        .when(F.length(digits) == 6, _date(recent(F.concat(F.lit("20"), at(1, 2))), at(3, 2), at(5, 2)))
        .when(F.length(digits) == 8, _date(at(1, 4), at(5, 2), at(7, 2)))
    )
    known = (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(text, F.lit(10)))
        .when(text.rlike(full), F.coalesce(_date(g(full, 1), g(full, 2), g(full, 3)), text))
        .when(text.rlike(two), F.coalesce(_date(recent(F.concat(F.lit("20"), g(two, 1))), g(two, 2), g(two, 3)), text))
        .otherwise(F.coalesce(F.when(text.rlike(short), _date(of_sheet, g(short, 1), g(short, 2))), by_digits))
    )
    return F.coalesce(known, text, F.lit(""))


def parse_document_date(c: Column | str) -> Column:
    """A 20YY date with separators, or what has 6 or 8 digits in all; empty text where there is no real day."""
    text = F.trim(F.coalesce(col(c), F.lit("")))
    full = r"^(20\d{2})[.\-/\s년]+([0-1]?\d)[.\-/\s월]+([0-3]?\d)일?$"
    digits = F.regexp_replace(text, r"\D", "")
    at = lambda s, n: F.substring(digits, s, n)
    known = (
        F.when(text.rlike(full), _date(*[F.regexp_extract(text, full, i) for i in (1, 2, 3)]))
        .when(F.length(digits) == 6, _date(F.concat(F.lit("20"), at(1, 2)), at(3, 2), at(5, 2)))
        .when(F.length(digits) == 8, _date(at(1, 4), at(5, 2), at(7, 2)))
    )
    return F.coalesce(known, F.lit(""))


def strict_date(c: Column | str, year: Column | str, as_of: datetime.date) -> Column:
    """Empty text for empty, null for what is not a real calendar day."""
    iso = normalize_ledger_date(c, year, as_of)
    return F.when(F.coalesce(F.trim(col(c)), F.lit("")) == "", "").otherwise(F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd"))


def parse_log_time(c: Column | str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")])


def days_left(deadline: Column | str, as_of: datetime.date) -> Column:
    """Days to a deadline that begins with year, month and day, joined by ``-``, ``.`` or ``/``; null if it doesn't."""
    text, form = F.trim(col(deadline)), r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})"
    day = _date(*[F.regexp_extract(text, form, i) for i in (1, 2, 3)])
    return F.datediff(F.try_to_date(F.when(text.rlike(form), day), "yyyy-MM-dd"), F.lit(as_of))


def due_state(deadline: Column | str, status: Column | str, as_of: datetime.date, done: tuple[str, ...] = DONE, soon: int = 7) -> Column:
    left = days_left(deadline, as_of)
    return (
        F.when(F.coalesce(F.trim(col(status)), F.lit("")).isin(*done), "done")
        .when(left.isNull(), "none")
        .when(left < 0, "overdue")
        .when(left <= soon, "soon")
        .otherwise("later")
    )


def due_label(state: Column | str, left: Column | str) -> Column:
    s, n = col(state), col(left)
    return (
        F.when(s == "overdue", F.concat(F.lit("D+"), (-n).cast("string")))
        .when(s.isin("soon", "later"), F.when(n == 0, "D-DAY").otherwise(F.concat(F.lit("D-"), n.cast("string"))))
        .otherwise("")
    )


def due_rank(state: Column | str) -> Column:
    """Order of deadlines: overdue, soon, later, none, done."""
    s = col(state)
    return F.when(s == "overdue", 0).when(s == "soon", 1).when(s == "later", 2).when(s == "none", 3).otherwise(4)


def status_label(status: Column | str) -> Column:
    """The status as shown; a blank one is not yet handed in."""
    s = F.coalesce(F.trim(col(status)), F.lit(""))
    return F.when(s == "", "미제출").otherwise(s)


def status_class(status: Column | str, done: tuple[str, ...] = DONE) -> Column:
    """Progress of a request: done, open (blank) or working."""
    s = F.coalesce(F.trim(col(status)), F.lit(""))
    return F.when(s.isin(*done), "done").when(s == "", "open").otherwise("working")

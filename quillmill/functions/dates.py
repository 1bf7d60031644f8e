"""Dates written in many ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import strip, text

# The range of spreadsheet day numbers that count as dates.
SERIAL_LEAST, SERIAL_MOST = 20000, 60000


def _at(x: Column, *formats: str) -> list[Column]:
    return [F.try_to_timestamp(x, F.lit(f)) for f in formats]


def _day(x: Column, pattern: str) -> Column:
    y, m, d = (F.regexp_extract(x, pattern, k).try_cast("int") for k in (1, 2, 3))
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), F.lit("yyyy-MM-dd"))


def parse_any_date(x: Column | str, serials: bool = False) -> Column:
    """A timestamp from mail dates, ISO dates, or a year, month and day anywhere in the text; without a zone it is UTC. Null if nothing fits.
    serials: spreadsheet day numbers count too."""
    t = strip(text(x))
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3,9},\s*", ""), r"\s+\([A-Za-z ]+\)$", "")
    mail = F.regexp_replace(mail, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    iso = F.regexp_replace(F.regexp_replace(t, " ", "T"), r"(\.\d{3})\d+", "$1")
    parts = [
        *_at(mail, "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss"),
        F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.coalesce(*_at(iso, "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSS]X", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy-MM-dd'T'HH:mm"))),
        _day(t, r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"),
    ]
    if serials:
        n = F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))
        parts.insert(0, F.when(n.between(SERIAL_LEAST, SERIAL_MOST), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")).cast("timestamp")))
    return F.coalesce(*parts)


def parse_page_date(x: Column | str) -> Column:
    """A date as pages give it: as parse_any_date, or with English month names."""
    t = F.regexp_replace(strip(text(x)), r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", "$1")
    return F.coalesce(parse_any_date(x), *_at(t, "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")).cast("date")


def date_in_path(path: Column) -> Column:
    """A date in an address's path: year, month and day with marks between them, or eight digits in a row."""
    return F.coalesce(_day(path, r"(?:^|[/-])(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:/|$|[-_])"), _day(path, r"(?:^|[/-])(\d{4})(\d{2})(\d{2})(?:/|$|[-_])")).cast("date")


def epoch_date(x: Column | str) -> Column:
    """A timestamp from seconds, or from milliseconds where the number is too large for seconds."""
    n = (F.col(x) if isinstance(x, str) else x).try_cast("double")
    return F.when(n > 1e11, F.timestamp_millis(n.cast("long"))).when(n > 0, F.timestamp_seconds(n.cast("long")))


def first_date(*columns: Column | str, serials: bool = False) -> Column:
    """The first of several columns that holds a date."""
    return F.coalesce(*[parse_any_date(c, serials) for c in columns])

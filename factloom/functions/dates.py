"""Dates inside text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed

_ISO = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
_DAY_MONTH_YEAR = r"(?<!\d)\d{1,2}\.\s?\d{1,2}\.\s?\d{4}(?!\d)"
_DAY_NAME_YEAR = rf"(?<!\d)\d{{1,2}}\.?\s+(?:{fixed.MONTH_NAMES})\.?,?\s+\d{{4}}(?!\d)"
_NAME_DAY_YEAR = rf"\b(?:{fixed.MONTH_NAMES})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}(?!\d)"
# A look-ahead consumes nothing, so a date that starts inside another form's match is still found
# ("Version 2.0. 2024-05-12").
ANY_DATE = rf"(?iuU)(?=({_ISO}|{_DAY_MONTH_YEAR}|{_DAY_NAME_YEAR}|{_NAME_DAY_YEAR}))"


def _month_number(text: Column) -> Column:
    name = F.lower(F.left(F.regexp_extract(text, rf"(?iu)({fixed.MONTH_NAMES})", 1), F.lit(3)))
    table = F.create_map(*[F.lit(x) for pair in fixed.MONTH_BY_PREFIX.items() for x in pair])
    return F.element_at(table, name).cast("string")


def _iso_of(match: Column) -> Column:
    def group(pattern: str, n: int) -> Column:
        return F.regexp_extract(match, pattern, n)

    def built(y: Column, m: Column, d: Column) -> Column:
        return F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")

    numeric = r"(?U)^(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})$"
    year_last = r"(?U)(\d{4})$"
    return (
        F.when(match.rlike(r"^\d{4}-"), match.try_cast("date"))
        .when(match.rlike(numeric), built(group(numeric, 3), group(numeric, 2), group(numeric, 1)))
        .when(match.rlike(r"^\d"), built(group(year_last, 1), _month_number(match), group(r"^(\d{1,2})", 1)))
        .otherwise(built(group(year_last, 1), _month_number(match), group(r"(?U)^\D+(\d{1,2})", 1)))
    )


def all_dates(text: Column, today: Column) -> Column:
    """Plausible dates in reading order: year 2000 or later, at most a month ahead of `today`."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY_DATE), 1), _iso_of)
    return F.filter(
        found,
        lambda d: d.isNotNull() & (F.year(d) >= fixed.FIRST_YEAR) & (F.datediff(d, today) <= fixed.DAYS_AHEAD),
    )


def first_date(text: Column, today: Column) -> Column:
    """The first plausible date, as YYYY-MM-DD."""
    return F.get(all_dates(text, today), F.lit(0)).cast("string")


def feed_date(text: Column) -> Column:
    """Day of an RSS (RFC 2822) or Atom (ISO 8601) timestamp, as YYYY-MM-DD."""
    mail = r"(?U)(?:^|,)\s*(\d{1,2})\s+([A-Za-z]{3})[a-z]*\.?\s+(\d{4})\b"
    month = F.element_at(
        F.create_map(*[F.lit(x) for pair in fixed.MONTH_BY_PREFIX.items() for x in pair]),
        F.lower(F.regexp_extract(text, mail, 2)),
    )
    posted = F.concat(
        F.regexp_extract(text, mail, 3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"),
        F.lpad(F.regexp_extract(text, mail, 1), 2, "0"),
    )
    iso = F.regexp_extract(text, r"(?U)^\s*(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(posted.try_cast("date").cast("string"), F.nullif(iso, F.lit("")))


def leading_day(text: Column) -> Column:
    """YYYY-MM-DD at the start of a timestamp string."""
    return F.nullif(F.regexp_extract(text, r"(?U)^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def claim_day(effective: Column, retrieved_at: Column) -> Column:
    """The day a claim stands for: its effective date, else the day it was read."""
    given = F.when(effective != "", F.left(effective, F.lit(10)))
    return F.coalesce(given, F.to_date(retrieved_at).cast("string"))


def feed_day(value: Column) -> Column:
    return F.when(F.length(value) >= 10, F.left(value, F.lit(10)))


def reporting_period(period_end: Column) -> Column:
    return F.when(period_end != "", F.concat(F.lit("FY"), F.substring_index(period_end, "-", 1)))


def latest_in_text(text: Column) -> Column:
    """The most recent ISO date a text carries."""
    return F.array_max(F.regexp_extract_all(text, F.lit(r"(?U)\d{4}-\d{2}-\d{2}"), 0))
